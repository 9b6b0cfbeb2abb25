"""Violation events: sanitized, without content of findings, handed to at most 20 named handlers, each isolated from the others' faults."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import row_udf
from ..functions.engine import Engine
from ..policy import NAME, Policy, require
from .decision import _engine, violation_labels

WINDOW, FIELD, NAME_FIELD, ENTRIES, KEY = 2000, 300, 100, 20, 50
EVENT = "schema_version:int,event:string,policy_name:string,allowed:boolean,risk_score:double,violations:array<string>,policy_rule_count:int,metadata:map<string,string>,llm_reason:string,input_preview:string"


def sanitize(engine: Engine, text: str, most: int = FIELD) -> str:
    return re.sub(r"[\r\n\t]+", " ", engine.redact(str(text)[:WINDOW])["text"])[:most]


def preview(engine: Engine, text: str) -> str:
    clean = engine.redact(text[:WINDOW])["text"]
    return clean[:FIELD] + ("…" if len(clean) > FIELD or len(text) > WINDOW else "")


def metadata(engine: Engine, pairs: Iterable[tuple]) -> dict[str, str]:
    """The first 20 entries: keys redacted, reduced to word characters and .-, told apart by _2, _3 within 50 characters; values sanitized."""
    out: dict[str, str] = {}
    for k, v in list(pairs)[:ENTRIES]:
        base = re.sub(r"[^A-Za-z0-9_.-]", "_", engine.redact(str(k)[:WINDOW])["text"])[:KEY]
        base = base if base.strip() else "metadata"
        key, n = base, 2
        while key in out:
            key, n = f"{base[: KEY - len(str(n)) - 1]}_{n}", n + 1
        out[key] = sanitize(engine, "" if v is None else v)
    return out


def _mapper(policy: Policy, kind: str, body: Callable):
    def make():
        engine = _engine(policy)
        return lambda x: None if x is None else body(engine, x)

    return row_udf(kind, make)


def events(decisions: DataFrame, policy: Policy | None = None, text: str | None = None, meta: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """An event for each decision of a risk above 0. meta: a map column; text: the column that a preview is taken from."""
    policy = policy or Policy()
    labels = violation_labels()
    empty = F.create_map().cast("map<string,string>")
    clean = _mapper(policy, "map<string,string>", lambda e, m: metadata(e, m.items() if isinstance(m, Mapping) else m))
    event = F.struct(
        F.lit(1).alias("schema_version"),
        F.lit("guardrail.violation").alias("event"),
        F.lit(sanitize(Engine(policy), policy.name, NAME_FIELD)).alias("policy_name"),
        F.col("allowed"),
        F.col("risk_score"),
        F.when(F.size(labels) == 0, F.array(F.lit("policy_violation"))).otherwise(labels).alias("violations"),
        F.size("policy_findings").alias("policy_rule_count"),
        (clean(meta) if meta is not None else empty).alias("metadata"),
        _mapper(policy, "string", lambda e, t: sanitize(e, t))(F.col("llm_analysis.reason")).alias("llm_reason"),
        (_mapper(policy, "string", preview)(F.col(text)) if text else F.lit(None).cast("string")).alias("input_preview"),
    )
    return decisions.where("risk_score > 0").select(*keep, event.alias("event"))


def queue_handler(put: Callable[[str], object]) -> Callable[[dict], None]:
    """A handler that puts each event, as JSON, into a queue for a worker elsewhere: put is a queue's method for that. What put raises counts as this handler's failure."""

    def handle(event: dict) -> None:
        put(json.dumps(event, ensure_ascii=False, sort_keys=True, default=str))

    return handle


class Notifier:
    """Handlers by name; each gets each event as a dictionary, in order."""

    def __init__(self, handlers: Mapping[str, Callable] | Iterable[tuple[str, Callable]], policy: Policy | None = None):
        pairs = list(handlers.items() if isinstance(handlers, Mapping) else handlers)
        require(1 <= len(pairs) <= 20, "1 to 20 handlers are needed")
        for name, call in pairs:
            require(isinstance(name, str) and bool(NAME.match(name)) and len(name) <= 100, "handler names must start with a letter and hold letters, digits and _.:- only")
            require(callable(call), "handlers must be callable")
        require(len({n for n, _ in pairs}) == len(pairs), "handler names must be unique")
        self.handlers, self.policy = tuple(pairs), policy or Policy()

    def dispatch(self, event: dict) -> dict:
        engine, out = _engine(self.policy), []
        for name, call in self.handlers:
            try:
                call(event)
                out.append({"handler": name, "success": True})
            except Exception as e:
                out.append({"handler": name, "success": False, "error": sanitize(engine, str(e)) or "notification failure"})
        return {"success": all(d["success"] for d in out), "event": event, "deliveries": out}

    def notify(self, decision: dict, meta: Mapping | None = None) -> dict | None:
        """One decision: None at risk 0; a decision that no event can be made of gives a failure summary, and no handler runs."""
        risk = decision.get("risk_score") if isinstance(decision, Mapping) else None
        require(isinstance(risk, (int, float)) and not isinstance(risk, bool) and 0 <= risk <= 1, "risk_score must be a number from 0 to 1")
        require(meta is None or isinstance(meta, Mapping), "metadata must be a mapping")
        if risk == 0:
            return None
        try:
            engine = _engine(self.policy)
            names = (("injection_attempt",) * 2, ("secret_leaked",) * 2, ("pii_detected",) * 2, ("policy_violated", "restricted_content"))
            labels = [label for key, label in names if decision.get(key)]
            labels += ["input_length_exceeded" for x in decision["checks"] if x["type"] == "length" and not x["allowed"]]
            labels += ["provider_error" for x in decision["checks"] if x["type"] == "llm"]
            event = {
                "schema_version": 1,
                "event": "guardrail.violation",
                "policy_name": sanitize(engine, self.policy.name, NAME_FIELD),
                "allowed": bool(decision["allowed"]),
                "risk_score": float(risk),
                "violations": labels or ["policy_violation"],
                "policy_rule_count": len(decision.get("policy_findings") or ()),
                "metadata": metadata(engine, (meta or {}).items()),
            }
        except Exception:
            return {"success": False, "event": None, "deliveries": [], "error": "notification failure"}
        return self.dispatch(event)

    def deliver(self, made: DataFrame) -> dict:
        """All events of a DataFrame, partition by partition as they arrive on the driver; counts of deliveries."""
        total = {"events": 0, "failed": 0}
        for row in made.select("event").toLocalIterator():
            total["events"] += 1
            total["failed"] += not self.dispatch(row["event"].asDict(True))["success"]
        return total
