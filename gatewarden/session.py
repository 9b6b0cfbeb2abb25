"""A configured session: one policy, handlers and provider for checks, redactions, telemetry and notifications."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .operators import decision as d
from .operators.notify import Notifier, events
from .policy import ConfigurationError, Policy, load_policy_file, require

DEFAULT_FILTERS = ("prompt", "system_prompt", "llm_input")


class GuardSession:
    """Set options, then finalize() or the first use fixes them. A disabled session refuses all work."""

    OPTIONS = ("policy", "policy_path", "environment", "filter_parameters", "notifier_handlers", "enabled", "llm_provider", "subscriber")

    def __init__(self, **options):
        self._fixed = False
        self._options = {"policy": None, "policy_path": None, "environment": "production", "filter_parameters": DEFAULT_FILTERS, "notifier_handlers": None, "enabled": True, "llm_provider": None, "subscriber": None}
        self.configure(**options)

    def configure(self, **options) -> GuardSession:
        require(not self._fixed, "the session is final")
        require(set(options) <= set(self.OPTIONS), f"unknown option: {sorted(set(options) - set(self.OPTIONS))[:1]}")
        self._options |= options
        return self

    def finalize(self) -> GuardSession:
        if self._fixed:
            return self
        o = self._options
        require(o["policy"] is None or o["policy_path"] is None, "give policy or policy_path, not both")
        require(isinstance(o["enabled"], bool), "enabled must be true or false")
        require(o["llm_provider"] is None or callable(o["llm_provider"]), "llm_provider must be callable")
        self.policy = load_policy_file(o["policy_path"], o["environment"]) if o["policy_path"] else o["policy"] or Policy()
        require(isinstance(self.policy, Policy), "policy must be a Policy")
        self.notifier = Notifier(o["notifier_handlers"], self.policy) if o["notifier_handlers"] else None
        self._fixed = True
        return self

    def _ready(self) -> None:
        self.finalize()
        if not self._options["enabled"]:
            raise ConfigurationError("the session is disabled")

    def _finish(self, df: DataFrame, kind: str, began: float, direction: str | None, metadata: Mapping | None, text: str | None) -> DataFrame:
        """Telemetry of what an action on df will count, and notifications of what it holds."""
        if self._options["subscriber"]:
            seen = Observation()
            bad = F.count(F.when(~F.col("allowed"), 1)).alias("blocked") if "allowed" in df.columns else F.count(F.when(F.col("redaction.redacted"), 1)).alias("redacted")
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"), bad)
            try:
                self._options["subscriber"](kind, {"policy_name": self.policy.name, "planning_ms": round((time.monotonic() - began) * 1000, 3)}, seen)
            except Exception:  # a subscriber's fault must not change a result
                pass
        if self.notifier and kind == "check":
            extra = dict(metadata or {}) | ({"direction": direction} if direction else {})
            meta = F.create_map(*[F.lit(str(x)) for p in extra.items() for x in p]) if extra else None
            self.last_delivery = self.notifier.deliver(events(df, self.policy, meta=meta))
        return df

    def check(self, df: DataFrame, text: str = "text", metadata: Mapping | None = None) -> DataFrame:
        self._ready()
        began = time.monotonic()
        return self._finish(d.check(df, text, self.policy, self._options["llm_provider"]), "check", began, None, metadata, text)

    def check_output(self, df: DataFrame, text: str = "text", metadata: Mapping | None = None) -> DataFrame:
        self._ready()
        began = time.monotonic()
        return self._finish(d.check(df, text, self.policy, self._options["llm_provider"]), "check", began, "output", metadata, text)

    def check_messages(self, df: DataFrame, metadata: Mapping | None = None, **columns) -> DataFrame:
        self._ready()
        began = time.monotonic()
        return self._finish(d.check_messages(df, policy=self.policy, provider=self._options["llm_provider"], **columns), "check", began, None, metadata, None)

    def redact(self, df: DataFrame, text: str = "text", on_oversize: str = "raise") -> DataFrame:
        self._ready()
        began = time.monotonic()
        return self._finish(d.redact(df, text, self.policy, on_oversize), "redact", began, None, None, None)

    def hide(self, df: DataFrame) -> DataFrame:
        """df with columns whose names are filter parameters masked: for show() and logs."""
        self._ready()
        names = re.compile("|".join(map(re.escape, self._options["filter_parameters"])), re.I)
        return df.withColumns({c: F.lit("[FILTERED]") for c in df.columns if names.search(c)})


def upload_check(df: DataFrame, content: str, extractor: Callable, policy: Policy | None = None) -> DataFrame:
    """A decision on what extractor, a function from Column to Column, makes of a column of files or pages."""
    require(callable(extractor), "extractor must be callable")
    return d.check(df.withColumn("__x", extractor(F.col(content))), "__x", policy).drop("__x")
