"""Detectors as Column expressions: built-in functions, and one Arrow UDF where no built-in has the semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import engine
from . import grammar as g
from .batches import row_udf


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def matches(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return c.rlike(("(?iu)" if ignore_case else "") + pattern)


def any_of(c: Column, patterns, ignore_case: bool = True) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(c, p, ignore_case)
    return out


# normal form and decoders


def strip_invisible(c: Column) -> Column:
    return F.translate(c, engine.INVISIBLE, "")


def fold_lookalikes(c: Column) -> Column:
    return F.translate(c, *engine.LOOKALIKES)


_normalise = row_udf(T.StringType(), lambda: lambda t: None if t is None else engine.normalise(t))


def normalise(c: Column) -> Column:
    """Built-in functions do for ASCII, which is its own normal form; the UDF sees null there."""
    plain = ~c.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_normalise(F.when(~plain, c)), c)


def url_decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


detection_variants = row_udf(T.ArrayType(T.StringType()), lambda: lambda t: engine.variants(t or ""))


# personal data


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_valid(m: Column) -> Column:
    return F.call_function("luhn_check", _digits(m))


def ipv4_valid(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)


def ssn_valid(m: Column) -> Column:
    return ~m.rlike("^(000|666|9)") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")


def iban_valid(m: Column) -> Column:
    c = F.upper(F.replace(m, F.lit(" "), F.lit("")))
    turned = F.filter(F.split(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4)), ""), lambda x: x != "")
    step = lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + x.cast("int")) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97)
    rest = F.aggregate(turned, F.lit(0).cast("long"), lambda a, x: step(a, x).cast("long"))
    return F.length(c).between(15, 34) & (rest == 1)


def birth_valid(m: Column) -> Column:
    nums = F.regexp_extract_all(m, F.lit("[0-9]+"), 0)
    n = lambda k: F.get(nums, F.lit(k)).cast("int")
    day = lambda y, mo, d: F.try_make_timestamp(y, mo, d, F.lit(0), F.lit(0), F.lit(0)).isNotNull()
    year = n(2) + F.when(F.length(F.get(nums, F.lit(2))) == 2, 2000).otherwise(0)
    numeric = F.when(F.length(F.get(nums, F.lit(0))) == 4, day(n(0), n(1), n(2))).otherwise(day(year, n(1), n(0)) | day(year, n(0), n(1)))
    word = F.lower(F.regexp_extract(m, rf"([A-Za-z]+)\.?{g.ONE}[0-9]{{1,2}},?{g.ONE}[0-9]{{4}}$", 1))
    month = F.array_position(F.array(*[F.lit(x[:3].lower()) for x in g.MONTHS]), F.substring(word, 1, 3))
    whole = F.length(word).isin(3) | word.isin(*[x.lower() for x in g.MONTHS])
    return F.when(m.rlike("[0-9][/-][0-9]"), numeric).otherwise((month > 0) & whole & day(n(1), month.cast("int"), n(0)))


_scrub_ip6 = row_udf(T.StringType(), lambda: lambda t: None if t is None else engine.scrub_kind(t, "IP6"))


VALID = {"SSN": ssn_valid, "SIN": luhn_valid, "IBAN": iban_valid, "DOB": birth_valid, "IP": ipv4_valid, "CARD": luhn_valid}


def pattern_of(kind: str) -> str:
    return next(("(?iu)" if i else "") + p for name, p, i in g.PII if name == kind)


def replace_kind(c: Column, kind: str) -> Column:
    """Matches that pass the kind's test become its token. The test isn't part of the pattern: what fails it is consumed all the same."""
    pattern, token = pattern_of(kind), f"[{kind.rstrip('6')}]"
    if kind not in VALID and kind != "IP6":
        return F.regexp_replace(c, pattern, token)
    if kind == "IP6":
        return _scrub_ip6(c)

    def zipped(x: Column) -> Column:
        new = F.transform(F.regexp_extract_all(x, F.lit(pattern), 0), lambda m: F.when(VALID[kind](m), token).otherwise(m))
        joined = F.array_join(F.zip_with(F.split(x, pattern, -1), new, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
        return F.when(x.rlike(pattern), joined).otherwise(x)

    return bound(c, zipped)


def bound(c: Column, f) -> Column:
    """f(c), with c computed once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def scrub(c: Column, kinds=None) -> Column:
    """All kinds in the catalogue's order, each over what the former left. Strings only; null stays null."""
    for name, _, _ in g.PII:
        if kinds is None or name in kinds:
            c = replace_kind(c, name)
    return c


# injection, secrets


def is_injection(c: Column) -> Column:
    """Whether any variant of the text holds a pattern. Variants are those of its start, so no more of it goes to the UDF."""
    return F.exists(detection_variants(F.substring(text_of(c), 1, engine.WINDOW)), lambda v: any_of(v, g.INJECTION))


def has_marker(c: Column) -> Column:
    return F.lower(c).rlike("|".join(g.MARKERS))


def fingerprint(full: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(full, 256), 1, 12))


def mask(full: Column) -> Column:
    return F.when(F.length(full) < 12, "[REDACTED]").otherwise(F.concat(F.substring(full, 1, 4), F.lit("…"), F.substring(full, -4, 4)))


def risk(injection: Column, secret: Column, policy: Column, pii: Column, blocked: Column) -> Column:
    part = lambda flag, w: F.when(flag, F.lit(w)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), part(injection, 0.5) + part(secret, 0.25) + part(policy, 0.25) + part(pii, 0.1) + part(blocked, 0.15)), 4)
