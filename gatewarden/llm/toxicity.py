"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, all other texts are unlabelled: some of them are toxic too, though fewer than of all texts. A linear classifier over hashed words is
trained in numpy on the class-prior-corrected risk: prior * R_p(+) + (1 - prior) / (1 - left) * max(0, R_u(-) - left * R_p(-)), with the logistic loss, left being the positives' share among unlabelled texts; where the bracket
falls below 0 its gradient is reversed, so that it is not fitted below what unlabelled text can have.

The training sample is bounded by the parameters positives and unlabelled; scoring covers every whole text. A text without words gets the score
of the bias alone. Null labels are no labels, nor are labels of keys that no document has. Repeated rows are scored each, but learned from once. An empty table gives an empty result. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, table, tidied
from .linear import word_features


def fold(key: Column, parts: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % parts


def _csr(rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(n + 1))


def _unlike(texts: list[np.ndarray], rare: np.ndarray) -> list[np.ndarray]:
    """texts without near copies of earlier ones, whose words would pass for marks of the class: two of four minimum hashes of rare features agree."""
    seen, out = [set() for _ in range(4)], []
    for t in texts:
        own = mix(t[rare[t]].astype(np.uint64)) if len(t) else np.zeros(0, np.uint64)
        keys = [int(mix(own + np.uint64(k)).min()) for k in range(4)] if len(own) else []
        if sum(k in s for k, s in zip(keys, seen)) < 2:
            out.append(t)
            for k, s in zip(keys, seen):
                s.add(k)
    return out


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, left: float | None = None, bits: int = 18, epochs: int = 12, rate: float = 0.05, decay: float = 3e-4, least_z: float = 6.0, batch: int = 512, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights of features and bias. positive, unlabelled: the features of each text; prior: the share of positives to decide for; left: their share in unlabelled, if it is another.

    Only features whose share among positives lies so many standard deviations from that among negatives, as the prior tells it, get a weight: the others can't be
    told from chance, and long texts would gather their noise.
    """
    size = 1 << bits
    if not positive or not unlabelled:
        return np.zeros(size), -2.0
    left = prior if left is None else left
    scale = (1 - prior) / (1 - left)
    among = lambda side: np.bincount(np.concatenate([np.zeros(0, np.int64), *side]), minlength=size)
    share = (among(unlabelled) + 0.5) / (len(unlabelled) + 1)
    positive = _unlike(positive, share < 0.01)
    seen = among(positive)
    spread = np.sqrt(share * (1 - share) * len(positive))
    # among negatives: what unlabelled texts hold less the positives' part of it
    share = np.maximum(share - left * seen / len(positive), 0) / (1 - left)
    use = (np.abs(seen - share * len(positive)) >= least_z * spread) & (seen >= 3)
    texts = [t[use[t]] for t in [*positive, *unlabelled]]
    length = np.array([len(t) for t in texts])
    flat, at = np.concatenate([np.zeros(0, np.int64), *texts]), np.concatenate([[0], np.cumsum(length)])
    n_pos = len(positive)
    w, v, bias, bias_v = np.zeros(size), np.zeros(size), np.log(prior / (1 - prior)), 0.0
    rng = np.random.default_rng(seed)

    def gather(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = length[ids]
        owner = np.repeat(np.arange(len(ids)), n)
        feats = flat[np.repeat(at[ids], n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)]
        return owner, feats, np.bincount(owner, w[feats], len(ids)) + bias

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    steps = max(1, (len(texts) - n_pos) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts) - n_pos) + n_pos
        for s in range(steps):
            p = rng.integers(0, n_pos, min(batch, n_pos))
            u = order[s * batch : (s + 1) * batch]
            po, pf, ps = gather(p)
            uo, uf, us = gather(u)
            negative = np.log1p(np.exp(np.clip(us, -40, 40))).mean() - left * np.log1p(np.exp(np.clip(ps, -40, 40))).mean()
            if negative >= 0:
                gu, gp = scale * sigmoid(us) / len(u), (-prior * sigmoid(-ps) - scale * left * sigmoid(ps)) / len(p)
            else:
                gu, gp = -scale * sigmoid(us) / len(u), scale * left * sigmoid(ps) / len(p)
            grad = np.bincount(pf, gp[po], size) + np.bincount(uf, gu[uo], size) + decay * w
            v = 0.99 * v + 0.01 * grad**2
            w -= rate * grad / (np.sqrt(v) + 1e-6)
            g = gp.sum() + gu.sum()
            bias_v = 0.99 * bias_v + 0.01 * g * g
            bias -= rate * g / (np.sqrt(bias_v) + 1e-6)
    return w, float(bias)


def features(docs: DataFrame, text: str, bits: int) -> DataFrame:
    """(confirmed, features) of (confirmed, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature = word_features(batch.column(1), bits)
            at = _csr(row, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature, pa.int32()))], names=["confirmed", "f"])

    return docs.select("confirmed", text).mapInArrow(tidied(run), "confirmed boolean, f array<int>")


def labelled(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, parts: int, out: int) -> DataFrame:
    """(key, __t, __l): each different pair of key and text (by hash) of the training folds, with its label; keys whose rows are all unlabelled have none.

    Labels that no document has are left out, and repeated rows count once. No text is shuffled.
    """
    known = labels.where(fold(F.col(key), parts) != out).groupBy(key).agg(F.max(label).alias("__l")).where("__l is not null")
    rows = docs.where(fold(F.col(key), parts) != out).select(key, F.xxhash64(text).alias("__t")).distinct()
    return rows.join(known, key, "left")


def fetched(docs: DataFrame, picked: DataFrame, text: str, key: str) -> DataFrame:
    """(__l, text) of picked (key, __t, __l), once each. picked is bounded by a sample's size, so it may be broadcast."""
    rows = docs.select(key, F.xxhash64(text).alias("__t"), F.col(text)).join(F.broadcast(picked), [key, "__t"])
    return rows.dropDuplicates([key, "__t"]).select("__l", text)


def share(most: int, of: int) -> int:
    """Of 1 000 003 equally likely values of a hash, how many to take so that about most of so many rows are left."""
    return int(min(1.0, most / max(of, 1)) * 1_000_003) + 1


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", parts: int = 5, out: int = 0, positives: int = 3000, unlabelled: int = 9000, bits: int = 18, prior: float | None = None, cost: float = 4.0) -> tuple[np.ndarray, float]:
    """The classifier, from rows of the training folds only.

    At most about positives confirmed texts and unlabelled other texts are taken, those of the smallest seeded hashes. The prior is the share of label 1 among labelled documents, unless
    given; cost is what a toxic text that is missed weighs against a false alarm (it raises the prior to decide for; training folds alone chose it). What is left of the prior among texts that aren't confirmed is what the risk takes off theirs. Without a confirmed text nothing is learned: all weights are 0 and all scores the same, under 0.5.
    """
    rows = labelled(docs, labels, text, key, label, parts, out)
    total, n, hit = rows.agg(F.count("*"), F.count("__l"), F.coalesce(F.sum("__l"), F.lit(0))).first()
    if not hit:
        return np.zeros(1 << bits), -2.0
    prior = min(0.9, max(0.01, hit / n if prior is None else prior))
    left = min(prior, max(0.0, (prior * total - hit) / max(total - hit, 1)))
    pick, other = (F.pmod(F.xxhash64(F.lit(k), F.col(key), "__t"), F.lit(1_000_003)) for k in (11, 12))
    pos = rows.where((F.col("__l") == 1) & (pick < share(positives, hit))).select(key, "__t", F.lit(True).alias("__l"))
    rest = rows.where((F.coalesce("__l", F.lit(0)) != 1) & (other < share(unlabelled, total - hit))).select(key, "__t", F.lit(False).alias("__l"))
    both = fetched(docs, pos, text, key).unionByName(fetched(docs, rest, text, key))
    got = features(both.select(F.col("__l").alias("confirmed"), text), text, bits).toArrow()
    confirmed = got["confirmed"].to_numpy()
    lists = got["f"].combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)
    texts = [flat[at[i] : at[i + 1]] for i in range(len(confirmed))]
    order = sorted(range(len(texts)), key=lambda i: texts[i].tobytes())  # whatever order rows came in
    return train_nnpu([texts[i] for i in order if confirmed[i]], [texts[i] for i in order if not confirmed[i]], cost * prior / (cost * prior + 1 - prior), left, bits)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", key: str = "doc_id", parts: int = 5, out: int = 0) -> DataFrame:
    """(key, held_out, score, predicted) for each row; one pass, no shuffle. The model is a fixed number of weights."""
    w, bias = model[0].astype(np.float32), model[1]
    shared = docs.sparkSession.sparkContext.broadcast(w)
    bits = int(len(w)).bit_length() - 1
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            row, feature = word_features(batch.column(2), bits)
            s = np.bincount(row, weight[feature], batch.num_rows) + bias
            s = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    held = F.coalesce(fold(F.col(key), parts) == out, F.lit(False)).alias("held_out")
    return docs.select(key, held, text).mapInArrow(tidied(run), f"`{key}` {kind}, held_out boolean, score double, predicted int")


def op7(spark, sf_dir: str) -> DataFrame:
    """Toxicity of each row of documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
