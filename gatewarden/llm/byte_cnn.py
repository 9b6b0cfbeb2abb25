"""Quality by a byte-level convolutional network in numpy.

Learned filters over windows of bytes run over overlapping chunks that cover the whole document. Each chunk keeps the largest response of each
filter; the largest and the mean over chunks enter a logistic layer. A filter's response is a sum of table rows, one for each byte of the window, so
that a convolution over one-hot bytes is a few look-ups.

The training sample is bounded by the parameter sample; scoring covers every whole text. A text without bytes has responses of 0. Null labels are no labels,
nor are labels of keys that no document has. Repeated rows are scored each, but learned from once. An empty table gives an empty result. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, tidied, utf8
from .toxicity import fetched, fold, labelled, share

WIDTH, FILTERS, CHUNK, STRIDE = 5, 12, 512, 448


def chunks(offsets: np.ndarray, chunk: int = CHUNK, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of chunks of so many bytes, each overlapping the next, that cover each row; an empty row has none."""
    size = np.diff(offsets)
    n = np.where(size > 0, np.maximum(1, -(-(size - (chunk - stride)) // stride)), 0)
    row = np.repeat(np.arange(len(size)), n)
    start = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * stride
    return row, start, np.minimum(start + chunk, offsets[1:][row])


def pooled(data: np.ndarray, offsets: np.ndarray, tables: np.ndarray, where: bool = False):
    """(chunks, filters): the largest response of each filter in each chunk, and the chunks' rows; with where, also its place.

    A window may run past the end of its text: bytes there count as byte 0.
    """
    width, _, filters = tables.shape
    row, start, end = chunks(offsets)
    if not len(row):
        return np.zeros((0, filters), np.float32), row, np.zeros((0, filters), np.int64)
    length = int((end - start).max())
    at = start[:, None] + np.arange(length)
    inside = at < end[:, None]
    padded = np.concatenate([data, np.zeros(length + width, np.uint8)])
    stop = offsets[1:][row][:, None]
    reply = np.zeros((*at.shape, filters), np.float32)
    for k in range(width):
        b = np.where(at + k < stop, padded[np.minimum(at + k, len(padded) - 1)], 0)
        reply += tables[k][b]
    reply[~inside] = -np.inf
    best = reply.argmax(axis=1)
    top = np.take_along_axis(reply, best[:, None, :], axis=1)[:, 0]
    return top, row, start[:, None] + best if where else best


def summary(top: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(rows, 2 * filters): the largest and the mean over a row's chunks of relu(top)."""
    top = np.maximum(top, 0)
    n = np.bincount(row, minlength=rows)
    out = np.zeros((rows, 2 * top.shape[1]), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        first = np.concatenate([[0], np.cumsum(n)])[:-1][some]
        out[some, : top.shape[1]] = np.maximum.reduceat(top, first)
        out[some, top.shape[1] :] = np.add.reduceat(top, first) / n[some][:, None]
    return out


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 6, rate: float = 0.02, batch: int = 48, seed: int = 3) -> dict[str, np.ndarray]:
    """Filter tables, weights and bias, by Adam on the logistic loss; the rarer label weighs up to three times as much."""
    rng = np.random.default_rng(seed)
    p = {"tables": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), "w": rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32), "b": np.zeros(1, np.float32)}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    y = labels.astype(np.float32)
    share = min(max(y.mean(), 0.05), 0.95)
    weight = np.where(y > 0, min(1.5, 0.5 / share), min(1.5, 0.5 / (1 - share)))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            ids = order[s : s + batch]
            data = np.frombuffer(b"".join(texts[i] for i in ids), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in ids])])
            top, row, place = pooled_in_parts(data, offsets, p["tables"])
            x = summary(top, row, len(ids))
            z = x @ p["w"] + p["b"][0]
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[ids]) * weight[ids] / len(ids)
            grad = {"w": x.T @ d, "b": np.array([d.sum()], np.float32), "tables": np.zeros_like(p["tables"])}
            n = np.bincount(row, minlength=len(ids))
            dx = d[:, None] * p["w"]
            dtop = dx[row, FILTERS:] / n[row][:, None] + dx[row, :FILTERS] * (top >= x[row, :FILTERS])
            dtop = dtop * (top > 0)
            padded, stop = np.concatenate([data, np.zeros(WIDTH, np.uint8)]), offsets[1:][row][:, None]
            f = np.broadcast_to(np.arange(FILTERS), place.shape)
            for k in range(WIDTH):
                b = np.where(place + k < stop, padded[place + k], 0).astype(np.int64)
                grad["tables"][k] = np.bincount((b * FILTERS + f).ravel(), dtop.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def pooled_in_parts(data: np.ndarray, offsets: np.ndarray, tables: np.ndarray, part: int = 1 << 17):
    """pooled() with places, over parts of so many bytes at most: memory grows neither with the rows nor with a long row."""
    tops, rows, places = [np.zeros((0, tables.shape[2]), np.float32)], [np.zeros(0, np.int64)], [np.zeros((0, tables.shape[2]), np.int64)]
    for a, b in slices(offsets, part):
        low, high = int(offsets[a]), int(offsets[b])
        if b - a > 1 or high - low <= 2 * part:
            top, row, place = pooled(data[low:high], offsets[a : b + 1] - low, tables, True)
            tops.append(top), rows.append(row + a), places.append(place + low)
            continue
        for s in range(low, max(low + 1, high - (CHUNK - STRIDE)), STRIDE * 256):  # 256 chunks of one long row at a time
            end = min(high, s + STRIDE * 255 + CHUNK + WIDTH)
            top, _, place = (x[:256] for x in pooled(data[s:end], np.array([0, end - s]), tables, True))
            tops.append(top), rows.append(np.full(len(top), a)), places.append(place + s)
    return np.concatenate(tops), np.concatenate(rows), np.concatenate(places)


def predict(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row."""
    top, row, _ = pooled_in_parts(data, offsets, p["tables"])
    return 1 / (1 + np.exp(-np.clip(summary(top, row, len(offsets) - 1) @ p["w"] + p["b"][0], -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", parts: int = 3, out: int = 1, sample: int = 2400) -> dict[str, np.ndarray] | None:
    """The network, from at most about sample labelled documents of the training folds, half of each label where there are enough.

    The documents are those of the smallest seeded hashes. Without documents of both labels there is no network: None.
    """
    rows = labelled(docs, labels, text, key, label, parts, out).where("__l is not null")
    counts = {int(r[0]): r[1] for r in rows.groupBy("__l").count().collect()}
    if len(counts) < 2:
        return None
    pick = F.pmod(F.xxhash64(F.lit(23), F.col(key), "__t"), F.lit(1_000_003))
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col("__l") == value) & (pick < share(sample // 2, n)))
    got = fetched(docs, rows.where(keep), text, key).select("__l", F.coalesce(F.col(text), F.lit("")).alias("t")).toArrow()
    rows = sorted(zip([t.encode() for t in got["t"].to_pylist()], got["__l"].to_pylist(), strict=True))
    y = np.array([v for _, v in rows])
    return train([t for t, _ in rows], y) if len(set(y.tolist())) == 2 else None


def score(docs: DataFrame, model: dict[str, np.ndarray] | None, text: str = "text", key: str = "doc_id", parts: int = 3, out: int = 1) -> DataFrame:
    """(key, held_out, score, predicted) for each row; one pass, no shuffle. Without a network each score is 0.5."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            s = predict(model, data, offsets).astype(np.float64) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    held = F.coalesce(fold(F.col(key), parts) == out, F.lit(False)).alias("held_out")
    return docs.select(key, held, text).mapInArrow(tidied(run), f"`{key}` {kind}, held_out boolean, score double, predicted int")


def filter_rows(docs: DataFrame, model: dict[str, np.ndarray] | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs without rows that score under least; whole rows pass through one worker, so nothing is joined, and leave it in batches of some 4 MB."""
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
            good = predict(model, data, offsets) >= least
            for a, b in slices(offsets, 4 << 20):
                yield batch.slice(a, b - a).filter(pa.array(good[a:b]))

    return docs.mapInArrow(tidied(run), docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """Quality of each row of documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
