"""Decisions and redactions over DataFrames.

A row's text is analysed by one Arrow UDF that returns a struct; what a decision derives from it (checks, allowed, risk) are built-in
expressions. Over-long texts reach the UDF as null, since a condition around a UDF doesn't keep rows from it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import columns as c
from ..functions.batches import row_udf
from ..functions.engine import Engine, present_secrets, scrub, secrets
from ..policy import Policy

SECRET = "array<struct<category:string,matched:string,fingerprint:string,start:int,end:int>>"
RULE = "array<struct<rule:string,description:string,blocked:boolean,matched:string,fingerprint:string,start:int,end:int>>"
PATTERNS = "array<struct<role:string,match:string>>"
ANALYSIS = f"struct<pii:boolean,patterns:{PATTERNS},secrets:{SECRET},rules:{RULE}>"
REDACTION = f"struct<text:string,redacted:boolean,pii_detected:boolean,findings:{SECRET},policy_findings:{RULE}>"
LLM = "struct<injection_attempt:boolean,pii_detected:boolean,secret_leaked:boolean,risk_score:double,reason:string,error:string>"
CHECK = {
    "type": "string",
    "allowed": "boolean",
    "skipped": "boolean",
    "llm_flagged": "boolean",
    "detected": "boolean",
    "injection_attempt": "boolean",
    "patterns": PATTERNS,
    "leaked": "boolean",
    "violated": "boolean",
    "count": "int",
    "findings": RULE,
    "length": "int",
    "max_length": "int",
    "error": "boolean",
}
FLAGS = ("injection_attempt", "pii_detected", "secret_leaked")


class Blocked(Exception):
    """Content that a policy doesn't allow; summary holds no content."""

    def __init__(self, message: str, summary: dict):
        super().__init__(message)
        self.summary = summary


class LlmProviderError(RuntimeError):
    """A provider failed under the mode raise."""


@lru_cache(64)
def _engine(policy: Policy) -> Engine:
    return Engine(policy)


def analysis(text: Column, policy: Policy) -> Column:
    def make():
        engine = _engine(policy)
        return lambda t: None if t is None else engine.analyse(t)

    return row_udf(ANALYSIS, make).asNondeterministic()(text)  # so that no filter above computes it once more


def _message_analysis(text: Column, messages: Column, policy: Policy) -> Column:
    def make():
        engine = _engine(policy)
        return lambda t, ms: None if t is None else engine.analyse(t, [(x["role"], x["text"] or "") for x in ms])

    return row_udf(ANALYSIS, make).asNondeterministic()(text, messages)


def provider_analysis(text: Column, context: Column, provider: Callable) -> Column:
    """What provider(text, context) says of each row: its flags, score and reason, or its error in 201 characters at most."""
    return row_udf(LLM, lambda: lambda t, x: {} if t is None else call_provider(provider, t, x))(text, context)


def call_provider(provider: Callable, text: str, context: dict) -> dict:
    try:
        got = provider(text, context)
        got = got.model_dump() if hasattr(got, "model_dump") else got
        if not isinstance(got, dict):
            raise TypeError("llm_provider must return a mapping")
        got = {str(k): v for k, v in got.items()}
        for flag in FLAGS:
            if got.get(flag) is not None and not isinstance(got[flag], bool):
                raise TypeError(f"llm_provider {flag} must be true or false")
        score = got.get("risk_score")
        ok = isinstance(score, (int, float)) and not isinstance(score, bool) and score == score and abs(score) != float("inf")
        reason = got.get("reason")
        return {f: got.get(f) for f in FLAGS} | {"risk_score": min(1.0, max(0.0, float(score))) if ok else None, "reason": None if reason is None else str(reason)[:500], "error": None}
    except Exception as e:
        return {"error": str(e)[:201]}


def _check(kind: str, **values) -> Column:
    fields = {k: values.get(k) for k in CHECK} | {"type": kind}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(CHECK[k]).alias(k) for k, v in fields.items()])


def decide(df: DataFrame, text: str, policy: Policy, found: Column, provider: Callable | None = None) -> DataFrame:
    """df with the decision's columns; text: a column without nulls; found: the analysis, null for over-long texts."""
    ok = F.length(text) <= policy.max_input_length
    df = df.withColumn("__a", found).withColumn("__ok", ok)
    a = F.col("__a")
    flags = {
        "pii": F.coalesce(a["pii"], F.lit(False)),
        "injection": F.coalesce(F.size(a["patterns"]) > 0, F.lit(False)) & ok,
        "secret": F.coalesce(F.size(a["secrets"]) > 0, F.lit(False)) & ok,
        "policy": F.coalesce(F.size(a["rules"]) > 0, F.lit(False)) & ok,
    }
    if provider:
        context = F.struct(flags["pii"].alias("pii_detected"), flags["injection"].alias("injection_attempt"), flags["secret"].alias("secret_leaked"), flags["policy"].alias("policy_violated"), F.transform(a["rules"], lambda r: r["rule"]).alias("policy_rules"))
        df = df.withColumn("llm_analysis", F.when(ok, provider_analysis(F.when(ok, F.col(text)), context, provider)))
        if policy.llm_failure_mode == "raise":
            df = df.withColumn("llm_analysis", F.when(F.col("llm_analysis.error").isNotNull(), F.raise_error(F.concat(F.lit("LlmProviderError: "), F.col("llm_analysis.error"))).cast(LLM)).otherwise(F.col("llm_analysis")))
        llm = {k: F.coalesce(F.col(f"llm_analysis.{f}"), F.lit(False)) for k, f in (("pii", "pii_detected"), ("injection", "injection_attempt"), ("secret", "secret_leaked"))}
    else:
        df = df.withColumn("llm_analysis", F.lit(None).cast(LLM))
        llm = {k: F.lit(False) for k in ("pii", "injection", "secret")}
    hit = {k: flags[k] | llm.get(k, F.lit(False)) for k in flags}
    blocks = {"pii": policy.block_pii, "injection": policy.block_injections, "secret": policy.block_secrets}
    allowed = {k: (~hit[k]) | F.lit(not b) for k, b in blocks.items()}
    allowed["policy"] = ~F.coalesce(F.exists(a["rules"], lambda r: r["blocked"]), F.lit(False))
    skipped = F.when(~ok, True)
    mark = {k: F.when(llm[k], True) for k in llm}
    none = lambda kind: F.array().cast(kind)
    checks = [
        _check("pii", allowed=allowed["pii"], skipped=skipped, llm_flagged=mark["pii"], detected=hit["pii"]),
        _check("injection", allowed=allowed["injection"], skipped=skipped, llm_flagged=mark["injection"], injection_attempt=hit["injection"], patterns=F.coalesce(a["patterns"], none(PATTERNS))),
        _check("secret", allowed=allowed["secret"], skipped=skipped, llm_flagged=mark["secret"], leaked=hit["secret"], count=F.greatest(F.coalesce(F.size(a["secrets"]), F.lit(0)), F.when(llm["secret"], 1).otherwise(0))),
        _check("policy", allowed=allowed["policy"], skipped=skipped, violated=hit["policy"], count=F.coalesce(F.size(a["rules"]), F.lit(0)), findings=F.coalesce(a["rules"], none(RULE))),
        _check("length", allowed=ok, length=F.length(text), max_length=policy.max_input_length),
    ]
    every = F.array(*checks)
    if provider and policy.llm_failure_mode == "block":
        every = F.when(F.col("llm_analysis.error").isNotNull(), F.concat(every, F.array(_check("llm", allowed=False, error=True)))).otherwise(every)
    df = df.withColumn("checks", every)
    df = df.withColumn("allowed", F.forall("checks", lambda x: x["allowed"]))
    score = c.risk(hit["injection"], hit["secret"], hit["policy"], hit["pii"], ~F.col("allowed"))
    df = df.withColumns(
        {
            "pii_detected": hit["pii"],
            "injection_attempt": hit["injection"],
            "secret_leaked": hit["secret"],
            "policy_name": F.lit(policy.name),
            "policy_violated": hit["policy"],
            "policy_findings": F.coalesce(a["rules"], none(RULE)),
            "risk_score": F.greatest(score, F.coalesce(F.col("llm_analysis.risk_score"), F.lit(0.0))),
        }
    )
    return df.drop("__a", "__ok")


def check(df: DataFrame, text: str = "text", policy: Policy | None = None, provider: Callable | None = None) -> DataFrame:
    """df with a decision on the text of each row."""
    policy = policy or Policy()
    df = df.withColumn("__t", c.text_of(F.col(text)))
    short = F.when(F.length("__t") <= policy.max_input_length, F.col("__t"))
    return decide(df, "__t", policy, analysis(short, policy), provider).drop("__t")


check_output = check


def check_columns(df: DataFrame, names: list[str], policy: Policy | None = None) -> DataFrame:
    """df with a decision for each of the named columns, as a struct <name>_decision."""
    for name in names:
        done = check(df.withColumn("__in", F.col(name)), "__in", policy)
        made = [x for x in done.columns if x not in df.columns and x != "__in"]
        df = done.withColumn(f"{name}_decision", F.struct(*made)).drop("__in", *made)
    return df


def transcripts(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: messages in order of turn, and their texts joined by newlines. text: a string, or an array of content blocks."""
    content = block_text(F.col(text)) if isinstance(df.schema[text].dataType, ArrayType) else c.text_of(F.col(text))
    message = F.struct(F.col(turn).alias("turn"), F.lower(F.col(role).cast("string")).alias("role"), content.alias("text"))
    grouped = df.groupBy(conversation).agg(F.array_sort(F.collect_list(message)).alias("messages"))
    return grouped.withColumn("joined", F.array_join(F.transform("messages", lambda m: m["text"]), "\n"))


def block_text(content: Column) -> Column:
    """Text of content blocks (array of structs with text), joined by blanks; null blocks are left out."""
    return F.coalesce(F.array_join(F.transform(F.filter(content, lambda b: b.isNotNull()), lambda b: F.coalesce(b["text"], F.lit(""))), " "), F.lit(""))


def check_messages(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", policy: Policy | None = None, provider: Callable | None = None) -> DataFrame:
    """A decision per conversation: length and all but injections on the joined text, injections on each message and on adjacent user and assistant turns."""
    policy = policy or Policy()
    whole = transcripts(df, conversation, turn, role, text)
    short = F.when(F.length("joined") <= policy.max_input_length, F.col("joined"))
    return decide(whole, "joined", policy, _message_analysis(short, F.col("messages"), policy), provider)


def redact(df: DataFrame, text: str = "text", policy: Policy | None = None, on_oversize: str = "raise") -> DataFrame:
    """df with redaction: text, redacted, pii_detected, secret_leaked, policy_violated, findings. Over-long texts raise an error, or give null."""
    policy = policy or Policy()

    def make():
        engine = _engine(policy)
        return lambda x: None if x is None else engine.redact(x)

    run = row_udf(REDACTION, make)
    t = c.text_of(F.col(text))
    long = F.length(t) > policy.max_input_length
    given = F.when(long, F.raise_error(F.lit("input exceeds max_input_length")).cast("string") if on_oversize == "raise" else F.lit(None).cast("string")).otherwise(t)
    r = F.col("__r")
    out = F.struct(
        r["text"].alias("text"),
        r["redacted"].alias("redacted"),
        r["pii_detected"].alias("pii_detected"),
        (F.size(r["findings"]) > 0).alias("secret_leaked"),
        F.lit(policy.name).alias("policy_name"),
        (F.size(r["policy_findings"]) > 0).alias("policy_violated"),
        r["policy_findings"].alias("policy_findings"),
        r["findings"].alias("findings"),
    )
    return df.withColumn("__r", run(given)).withColumn("redaction", F.when(r["text"].isNotNull(), out)).drop("__r")


def scrub_messages(df: DataFrame, conversation: str = "conv_id", text: str = "text") -> DataFrame:
    """df with text scrubbed of personal data, and whether its conversation held any."""
    from pyspark.sql import Window as W

    if isinstance(df.schema[text].dataType, ArrayType):  # content blocks keep their other fields
        texts = F.transform(text, lambda b: b["text"])

        # one kind needs Python, and a lambda function may hold none
        each = row_udf("array<string>", lambda: lambda ts: None if ts is None else [None if t is None else scrub(t) for t in ts])
        df = df.withColumn("__n", each(texts))
        out = df.withColumn("__s", F.zip_with(text, "__n", lambda b, t: F.when(b.isNotNull(), b.withField("text", t))))
        changed = ~F.col("__n").eqNullSafe(texts)
        out = out.withColumn("__c", changed).drop("__n")
        changed = F.col("__c")
    else:
        out = df.withColumn("__s", c.scrub(F.col(text)))
        changed = F.col("__s") != F.col(text)
    out = out.withColumn("detected", F.bool_or(F.coalesce(changed, F.lit(False))).over(W.partitionBy(conversation)))
    return out.withColumn(text, F.col("__s")).drop("__s", "__c")


def scan_secrets(df: DataFrame, text: str = "text", policy: Policy | None = None) -> DataFrame:
    """df with secrets: the findings of whole texts of any length; a null text has none."""
    policy = policy or Policy()

    def make():
        engine = _engine(policy)
        return lambda t: [] if t is None else present_secrets(t, secrets(t, engine.custom))

    return df.withColumn("secrets", row_udf(SECRET, make).asNondeterministic()(F.col(text)))  # so that explode() doesn't have it computed once more


def scan_rules(df: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """df with policy_findings: what the policy's rules find in whole texts of any length; a null text has none."""

    def make():
        engine = _engine(policy)
        return lambda t: [] if t is None else engine.present(t, engine.findings(t))

    return df.withColumn("policy_findings", row_udf(RULE, make).asNondeterministic()(F.col(text)))


def violation_labels() -> Column:
    """Labels of a decision row, in fixed order."""
    long = F.exists("checks", lambda x: (x["type"] == "length") & ~x["allowed"])
    error = F.exists("checks", lambda x: x["type"] == "llm")
    pairs = (("injection_attempt", F.col("injection_attempt")), ("secret_leaked", F.col("secret_leaked")), ("pii_detected", F.col("pii_detected")), ("restricted_content", F.col("policy_violated")), ("input_length_exceeded", long), ("provider_error", error))
    return F.array_compact(F.array(*[F.when(flag, F.lit(label)) for label, flag in pairs]))


def summary(df: DataFrame, *keep: str) -> DataFrame:
    """Decisions without content: for telemetry and errors."""
    rules = F.array_distinct(F.transform("policy_findings", lambda f: f["rule"]))
    return df.select(*keep, "policy_name", "allowed", "risk_score", violation_labels().alias("violations"), rules.alias("policy_rules"))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Allowed rows and blocked rows of decisions."""
    return df.where("allowed"), df.where("not allowed")


def enforce(df: DataFrame) -> DataFrame:
    """df if each row is allowed; else Blocked is raised with the summary of one row that isn't."""
    bad = summary(df.where("not allowed")).limit(1).collect()
    if bad:
        raise Blocked("content blocked by guardrail policy", bad[0].asDict(True))
    return df


def enforce_no_secrets(df: DataFrame) -> DataFrame:
    bad = summary(df.where("secret_leaked")).limit(1).collect()
    if bad:
        raise Blocked("Response blocked: secret leakage detected", bad[0].asDict(True))
    return df
