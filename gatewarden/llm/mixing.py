"""Mixing sources to target weights by subset-sum budget fitting.

Targets come from weights per source. Documents are counted by exact length; whole passes over a source are taken first, then a
bounded knapsack over (length, count) fills what remains of the budget, and the documents of each length are picked in the order of a seeded hash.

A null text has size 0 and is never taken. Repeated rows are documents of their own; among equal hashes doc_id decides, and rows
equal in both are interchangeable. A null source is one more source, last in order. An empty table gives an empty result.
Columns of the names that the result adds are replaced; others are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, table

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = 1.5, repeats: float = 2.0) -> dict[str | None, float]:
    """Target of each source: share of all sizes dealt by weight, none above repeats times its size, the excess dealt anew."""
    order = sorted((s for s, _ in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for s, _ in sizes)
    size = dict(sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(size.values()), list(order), {s: 0.0 for s in order}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > repeats * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = repeats * size[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, room: int = 1 << 18) -> np.ndarray:
    """How many documents of each length to take so that the words come as near to budget as can be, never above it.

    Lengths get their even share first; then what was taken is given back, evenly again, until room words (32 of the longest documents at least) or all of the budget are open. Over these a
    subset-sum runs on all documents that aren't taken: exact where the budget is within the room, and otherwise over so many sums that it is filled but for gaps that lengths leave in any
    case, such as a common divisor. For each sum that can be reached the first bundle (a power of two of one length) that reached it is kept, so memory is a few
    bytes for each open word, however many lengths there are.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    open_ = max(room, 32 * int(lengths.max()))
    part = max(0, budget - open_)
    take = np.array([c * part // total for c in counts.tolist()], np.int64)
    left = budget - int((take * lengths).sum())
    bundles = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n, bundle = min(int(counts[k] - take[k]), left // int(lengths[k])), 1
        while n > 0:
            bundles.append((k, min(bundle, n)))
            n, bundle = n - bundle, bundle * 2
    first = np.full(left + 1, -1, np.int32)  # -1: not reached
    reach = np.zeros(left + 1, bool)
    reach[0] = True
    for b, (k, m) in enumerate(bundles):
        w = m * int(lengths[k])
        if w > left:
            continue
        new = np.flatnonzero(reach[: left + 1 - w] & ~reach[w:]) + w
        first[new] = b
        reach[new] = True
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:  # each step back leads to a sum that an earlier bundle reached first
        k, m = bundles[first[at]]
        take[k] += m
        at -= m * int(lengths[k])
    return take


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights=WEIGHTS,
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 17,
    group: int = 100_000,
    small_rows: int = 50_000,
) -> DataFrame:
    """docs with size, source_size, target (of the source) and taken (words: a multiple of size from 0 to repeats).

    Only a row per source (its name and size) reaches the driver. Counts by length are summed before the shuffle, and one task holds
    the counts of one source: as many rows as it has lengths. Documents of one length are ranked in groups of about so many, cut by
    their hash, so that no task ranks all documents of a common length. The plan (a row per source and length) is broadcast where it has small_rows rows
    at most.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    sized = docs.withColumns(
        {
            "size": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long"),
            "__h": F.xxhash64(F.lit(seed), F.col(key)),
            "__s": F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source))),
        }
    )
    counts = cut(sized.groupBy("__s", F.col("size").alias("__l")).agg(F.count("*").alias("__c")))
    totals = {r[0]: int(r[1]) for r in counts.groupBy("__s").agg(F.sum(F.col("__l") * F.col("__c"))).collect()}
    named = targets([(None if s == "-" else s[1:], n) for s, n in totals.items()], weights, share, repeats)
    goal = {s: named[None if s == "-" else s[1:]] for s in totals}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf["__s"].iloc[0]
        size, target = totals[s], goal[s]
        passes = min(int(target // size), repeats) if size else 0
        words = pdf["__l"].to_numpy() > 0
        rest = np.zeros(len(pdf), np.int64)
        if size and passes < repeats:
            rest[words] = knapsack(pdf["__l"].to_numpy()[words], pdf["__c"].to_numpy()[words], int(round(target)) - passes * size)
        return pdf.assign(__p=passes, __k=rest, __g=-(-pdf["__c"] // group), target=target, source_size=size)

    plan = cut(counts.groupBy("__s").applyInPandas(fit, "__s string, __l long, __c long, __p long, __k long, __g long, target double, source_size long"))
    few = (lambda df: F.broadcast(df)) if plan.count() <= small_rows else (lambda df: df)
    dealt = sized.join(few(plan.withColumnRenamed("__l", "size")), ["__s", "size"]).withColumn("__b", F.pmod("__h", "__g"))
    # documents of one length stand in order of group, then hash, then key; the first __k of them are taken once more
    groups = cut(dealt.where("__k > 0 and __k < __c and __g > 1").groupBy("__s", "size", "__b").agg(F.count("*").alias("__n")))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__s", "size").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.join(groups.select("__s", "size", "__b", before.alias("__before")), ["__s", "size", "__b"], "left")
    place = F.row_number().over(W.partitionBy("__s", "size", "__b").orderBy("__h", key)) + F.coalesce("__before", F.lit(0))
    return (
        dealt.withColumn("__place", place)
        .withColumn("taken", (F.col("size") * (F.col("__p") + F.when(F.col("__place") <= F.col("__k"), 1).otherwise(0))).cast("long"))
        .select(*docs.columns, "size", "source_size", "target", "taken")
    )


def op8(spark, sf_dir: str) -> DataFrame:
    """The words that the mix takes from each row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
