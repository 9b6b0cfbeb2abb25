"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 16 bytes has its marked bits at 0, so chunks follow the content: what is inserted before a passage shifts no chunk
boundary inside it. Chunks are deduplicated by digest over all documents. Side by side, a document's repeated chunks form
runs; a run is a repeated passage if it has enough words. Of each chunk the first occurrence (smallest key, then hash of the text, then place) is kept.

With chunks of 16 bytes in the mean a passage loses about 30 bytes at its ends, so passages of over 50 words leave runs of over 30 as a rule; min_words is 20. In simulations with the given texts passages of 30 words leave such
runs in 78 % of all cases, of 36 words in 95 %, of 45 and more in 97 to 99 %; shorter ones are mostly missed. A chunk alone is no evidence, since
a few words recur by chance: digests are taken over windows of GRAM consecutive chunks, and a repeated window marks all its chunks.

A null or empty text has no chunks. A document is known by its key and the hash of its text, so rows that share a key with different texts are told apart, and rows alike in both are
one document. What one document alone repeats is no repeated passage unless that is asked for. Documents without a key come first in order and are reported with a null key. A text that copies another whole is one
repeated passage. Columns other than the key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, prefix_hash, slices, span_hash, table, utf8, words

GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
BITS, LONGEST, GRAM = 4, 256, 6
#: Bytes of text that are worked on at once; arrays take some 60 times as much.
PART = 1 << 19


def boundaries(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, longest: int = LONGEST) -> np.ndarray:
    """Ends of chunks: after bytes where the gear hash h = 2h + gear[byte] has 0 in bits 12 to 12 + bits, at the end of each row, and after so many bytes.

    Only bits below 16 are looked at, on which the last 16 bytes alone bear; h is built by doubling in four steps.
    """
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    hit = np.flatnonzero(((h >> np.uint32(12)) & np.uint32((1 << bits) - 1)) == 0) + 1
    ends = np.unique(np.concatenate([hit, offsets[1:]]))
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]])
    more = (ends - starts - 1) // longest
    if more.any():
        extra = np.repeat(starts, more) + longest * (1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
        ends = np.unique(np.concatenate([ends, extra]))
    return ends


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and digest of each chunk. Chunks near the start of a row may depend on what stands before it in data, so rows are parted by zeros."""
    n = len(offsets) - 1
    gap = 16
    size = np.diff(offsets)
    wide = np.zeros(len(data) + gap * n, np.uint8)
    to = np.arange(len(data)) + gap * (np.repeat(np.arange(n), size) + 1)
    wide[to] = data
    off = np.concatenate([[0], np.cumsum(size + gap)])
    inner = np.concatenate([off[:-1] + gap, off[1:]])
    ends = np.unique(np.concatenate([boundaries(wide, np.sort(inner)), inner]))
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]])
    row = np.searchsorted(off, starts, "right") - 1
    keep = starts >= off[row] + gap
    row, starts, ends = row[keep], starts[keep], ends[keep]
    digest = span_hash(prefix_hash(wide), starts, ends)
    shift = gap * (row + 1)
    return row, starts - shift, ends - shift, digest


def windows(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first chunk, digest) of all windows of gram chunks; and the chunks' row, start, end, digest.

    Windows depend on content alone, so a repeated passage has the same ones in each place. None is left out: a run of a short passage would lose its ends, and its words with them.
    """
    row, start, end, digest = chunked(data, offsets)
    full = np.flatnonzero((row[: len(row) - gram + 1] == row[gram - 1 :]) if len(row) >= gram else np.zeros(0, bool))
    h = np.zeros(len(full), np.uint64)
    for k in range(gram):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + digest[full + k])
    return row[full], full, h, (row, start, end, digest)


def _digests(docs: DataFrame, hot: np.ndarray, only: bool = False, low: tuple[list, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(id, th, at, words, digest) of each window of (id, th, t), in four numbers besides the digest: at is its first byte and its length (12 bits), words how many words start before it and how
    many more end in it. Digests in hot (sorted) are left out, or nothing but them is given.

    low: key, hash of the text and place of the first occurrence of each of hot. With it, (id, th, lo, hi, before, after, from, kept): windows of hot that follow each other in a text, and are all
    first occurrences or all aren't, are one row, as they will be in the end.
    """
    names = ["id", "th", "lo", "hi", "before", "after", "from", "kept"] if low else ["id", "th", "at", "words", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in slices(offsets, PART):
                off = offsets[a : b + 1] - offsets[a]
                own = data[offsets[a] : offsets[b]]
                row, first, h, (_, start, end, _) = windows(own, off)
                k = np.zeros(len(h), np.int64)
                if len(hot):
                    k = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    take = (hot[k] == h) == only
                    row, first, h, k = row[take], first[take], h[take], k[take]
                elif only:
                    continue
                _, w_start, w_end = words(own, off)
                lo, hi = start[first], end[first + GRAM - 1] if len(first) else start[:0]
                base = np.searchsorted(w_start, off[row], "left")
                before = np.searchsorted(w_start, lo, "left")
                after = np.maximum(np.searchsorted(w_end, hi, "right"), before)
                lo, hi, before, after = lo - off[row], hi - off[row], before - base, after - base
                ids, th = (batch.column(c).slice(a, b - a).take(pa.array(row)) for c in range(2))
                if not low:
                    columns = [ids, th, pa.array(lo << 12 | (hi - lo)), pa.array(before << 12 | (after - before)), pa.array(h.view(np.int64))]
                elif not len(row):
                    continue
                else:
                    source = pa.array(low[0], pa.int64()).take(pa.array(k))
                    same = pc.or_kleene(pc.equal(ids, source), pc.and_(pc.is_null(ids), pc.is_null(source))).fill_null(False).to_numpy(zero_copy_only=False)
                    kept = same & (th.to_numpy() == low[1][k]) & ((lo << 12 | (hi - lo)) == low[2][k])
                    at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1) | (kept[1:] != kept[:-1])))
                    last = np.append(at[1:], len(row)) - 1
                    one = pa.array(at)
                    columns = [ids.take(one), th.take(one), *(pa.array(x) for x in (lo[at], hi[last], before[at], after[last])), source.take(one), pa.array(kept[at])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("id", "th", "t").mapInArrow(run, ", ".join(f"{x} {'boolean' if x == 'kept' else 'long'}" for x in names))


def _hot(rows: DataFrame, one_in: int, least: int, most: int = 10_000) -> np.ndarray:
    """Sorted digests that so many windows of a sample of documents have; the commonest of them, if they are more than most.

    Only the way that their rows take depends on it, never the result.
    """
    some = _digests(rows.where(F.pmod(F.xxhash64("id", "th"), F.lit(one_in)) == 0), np.zeros(0, np.uint64))
    counts = some.groupBy("digest").count().where(F.col("count") >= least)
    return np.sort(np.array([r[0] for r in counts.orderBy(F.desc("count"), "digest").limit(most).collect()], np.int64).view(np.uint64))


def passages(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = 20, within: bool = False, hot_one_in: int = 32, hot_least: int = 32) -> DataFrame:
    """(key, start, end, n_words, first_doc_id, kept) of each repeated passage: bytes of the text in UTF-8, its words, the document with the first occurrence.

    within: whether what a single document repeats counts too. kept marks first occurrences: what stays when the others are cut out. Only windows' digests are shuffled, once, and no text. Hot digests, known from a sample, aren't: their
    first occurrences, 10 000 at most, are found before a shuffle and handed to them. A document's repeated windows come back to it as one list.
    """
    blank = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.lit(2), blank).alias("th"), blank.alias("t"))
    hot = _hot(rows, hot_one_in, hot_least)
    place = F.struct("id", "th", "at")
    group = Window.partitionBy("digest")
    repeated = (F.col("n") > 1) if within else ~(F.col("low.id").eqNullSafe(F.col("high.id")) & (F.col("low.th") == F.col("high.th")))
    ends = {"low": F.min(place), "high": F.max(place), "n": F.count("*")}
    found = _digests(rows, hot).withColumns({k: f.over(group) for k, f in ends.items()}).where(repeated)
    lo, before = F.shiftright("at", 12), F.shiftright("words", 12)
    window = {"lo": lo, "hi": lo + F.col("at").bitwiseAND(4095), "before": before, "after": before + F.col("words").bitwiseAND(4095), "from": F.col("low.id"), "kept": place.eqNullSafe(F.col("low"))}
    found = found.select("id", "th", *(c.alias(k) for k, c in window.items()))
    if len(hot):
        held = _digests(rows, hot, only=True).groupBy("digest").agg(*(f.alias(k) for k, f in ends.items()))
        low = {r.digest: r.low for r in held.where(repeated).collect()}  # as many rows as hot has
        hot = hot[np.isin(hot.view(np.int64), np.array(list(low), np.int64))]
        firsts = [low[d] for d in hot.view(np.int64).tolist()]
        known = [x[0] for x in firsts], np.array([x[1] for x in firsts]), np.array([x[2] for x in firsts])
        found = found.unionByName(_digests(rows, hot, only=True, low=known))  # of no rows if all hot digests are of single documents
    marked = found.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi", "before", "after", "from", "kept")).alias("hits"))
    names = ["id", "start", "end", "n_words", "first_doc_id", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            if not len(flat):
                continue
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            lo, hi, before, after, is_first = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 5))
            source = flat.field(4)
            rank = np.argsort(np.argsort(source.fill_null(np.iinfo(np.int64).min).to_numpy(), kind="stable"), kind="stable")
            order = np.lexsort((rank, is_first, lo, doc))
            doc, lo, hi, before, after, is_first, source = *(x[order] for x in (doc, lo, hi, before, after, is_first)), source.take(pa.array(order))
            # a run goes on while windows of one kind (first or not) touch; what ended furthest before decides, in each document anew
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (is_first[1:] != is_first[:-1]) | (lo[1:] > hi[:-1])
            start = np.flatnonzero(new)
            top, n = np.maximum.reduceat(hi, start), np.maximum.reduceat(after, start) - before[start]
            some = n >= min_words
            start, top, n = start[some], top[some], n[some]
            columns = [batch.column(0).take(pa.array(doc[start])), pa.array(lo[start]), pa.array(top), pa.array(n), source.take(pa.array(start)), pa.array(is_first[start])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    got = marked.select("id", "hits").mapInArrow(run, "id long, start long, end long, n_words long, first_doc_id long, kept boolean")
    return got.withColumnRenamed("id", key)


def op2(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of documents."""
    return passages(table(spark, sf_dir, "documents"))
