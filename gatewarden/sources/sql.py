"""SQL names for the operators: scalar functions and a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions.batches import row_udf
from ..functions.engine import normalise, present_secrets, scrub, secrets, single
from ..operators.decision import _engine
from ..policy import Policy


def register(spark: SparkSession, policy: Policy | None = None) -> None:
    """guard_scrub(text), guard_normalise(text), guard_redact(text), guard_is_injection(text), and the table function guard_findings(text)."""
    policy = policy or Policy()

    def scalar(kind, body):
        def make():
            engine = _engine(policy)
            return lambda t: None if t is None else body(engine, t)

        return row_udf(kind, make)

    spark.udf.register("guard_scrub", scalar("string", lambda e, t: scrub(t)))
    spark.udf.register("guard_normalise", scalar("string", lambda e, t: normalise(t)))
    spark.udf.register("guard_redact", scalar("string", lambda e, t: e.redact(t)["text"]))
    spark.udf.register("guard_is_injection", scalar("boolean", lambda e, t: bool(single("user", t))))

    @udtf(returnType="kind string, name string, matched string, fingerprint string, start int, end int")
    class Findings:
        def eval(self, text: str):
            engine, text = _engine(policy), text or ""
            for x in present_secrets(text, secrets(text, engine.custom)):
                yield "secret", x["category"], x["matched"], x["fingerprint"], x["start"], x["end"]
            for x in engine.present(text, engine.findings(text)):
                yield "policy", x["rule"], x["matched"], x["fingerprint"], x["start"], x["end"]

    spark.udtf.register("guard_findings", Findings)
