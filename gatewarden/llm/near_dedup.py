"""Near-duplicate documents by BagMinHash signatures, banding and exact verification of multiset overlap.

Documents are multisets of runs of five words. BagMinHash gives each multiset a signature whose registers agree with a probability
equal to the weighted Jaccard similarity: the weight axis is cut into levels; over dyadic blocks of levels, each element has a seeded
Poisson process of marked points, of which those whose mark lies below the element's weight count; register r keeps the earliest point that falls on it.

Equal texts are one class from the start, named by two 64-bit hashes. Signatures are cut into bands; classes that agree on a band meet in a bucket, and buckets that share classes
form a group, outside of which none of its members has a candidate. A group's texts are shipped once, to one task, which holds every two of them that aren't connected yet against
each other by the exact overlap of their multisets and lets only a forest of links leave. Groups too large for a task are taken apart bucket by bucket, in blocks of
bounded size. So no bucket is capped, no pair leaves a task, and a group of thousands of near copies costs one row for each member. All that can be missed are pairs that no band
brings together: at a similarity of 0.8 exactly (1 - 0.8 ** 5) ** 27, 2 in 100 000, where nothing else connects the two.

A null text, and one without words, is similar to nothing: a class of its own, kept. A text of fewer than five words has one run
of all its words. Repeated rows with one key are copies of each other, and each is marked as kept where the class keeps their key and text. Where different texts share a key, class_id
may be equal for two classes; of one class the text of the smallest key and then of the smallest hash stays. A row without a key belongs to the class of its text but isn't
kept if a row of the class has a key; in a class without keys class_id is null and one text's rows are kept. Columns other than the key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, discard, mix, shingles, slices, table, tidied, utf8, written

BANDS, ROWS = 27, 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def multisets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash (of 44 bits) and count of each different run of k words; under 2 ** 20 rows at a time."""
    row, h = shingles(data, offsets, k)
    key = np.sort(row.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key = key[at]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), np.diff(np.append(at, len(new)))


def bagminhash(row: np.ndarray, h: np.ndarray, count: np.ndarray, rows: int, m: int) -> np.ndarray:
    """(rows, m) registers as 64-bit numbers; two registers are equal with the weighted Jaccard similarity of their multisets.

    Each point of a process has a gap to the one before it (exponential with mean 1 over the rate), a register and a mark (0 to 1), all from one seeded hash.
    Points are drawn up to a time by which all registers of a row are filled with a probability of 95 %; for rows where some are not, that time is doubled.
    """
    out = np.zeros((rows, m), np.uint64)
    weight = np.bincount(row, count, rows)
    bound = np.where(weight > 0, (np.log(m) + 3) / np.maximum(weight, 1), 0)
    # level blocks (0, 1], (1, 2], (2, 4], (4, 8] ... that start below the count; the first of all elements, then the others of those with more
    more = np.flatnonzero(count > 1)
    blocks = np.ceil(np.log2(count[more])).astype(np.int64)
    item = np.repeat(more, blocks)
    j = np.arange(len(item)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = (1 << j).astype(np.int64)
    seed = mix(np.concatenate([h + np.uint64(0xA24BAED4963EE407), h[item] + (j.astype(np.uint64) + np.uint64(2)) * np.uint64(0xA24BAED4963EE407)]))
    owner = np.concatenate([row, row[item]])
    part = np.concatenate([np.ones(len(h)), np.minimum(count[item] - low, low) / low])
    scale = 1.0 / (m * np.concatenate([np.ones(len(h)), low]))
    live = np.arange(len(owner))
    best = np.full(rows * m, np.inf)
    while len(live):
        kept = []
        todo, n, x, many = live, np.zeros(len(live), np.uint64), np.zeros(len(live)), np.ones(len(live), np.int64)
        while len(todo):
            single = bool((many == 1).all())
            who = todo if single else np.repeat(todo, many)
            nth = n if single else np.repeat(n, many) + (np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)).astype(np.uint64)
            a = mix(seed[who] + (nth + np.uint64(1)) * _STEP)
            gap = np.log(((a >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) * -scale[who]
            if single:
                when = last = x + gap
            else:
                sums = np.cumsum(gap)
                first = np.cumsum(many) - many
                when = sums + np.repeat(x - (sums[first] - gap[first]), many)
                last = when[first + many - 1]
            good = np.flatnonzero(when <= bound[owner[who]])
            partial = part[who[good]]
            cut_ = np.flatnonzero(partial < 1)
            if len(cut_):
                mark = (mix(a[good[cut_]] ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.float64) * 2.0**-24
                good = np.delete(good, cut_[mark >= partial[cut_]])
            who, a, when = who[good], a[good], when[good]
            cell = owner[who] * m + ((a & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
            np.minimum.at(best, cell, when)
            kept.append((cell, when, a + seed[who]))
            rest = bound[owner[todo]] - last
            on = np.flatnonzero(rest >= 0)
            n, x = n[on] + many[on].astype(np.uint64), last[on]
            todo = todo[on]
            many = np.maximum(1, np.ceil(rest[on] / scale[todo])).astype(np.int64)
        for cell, when, bits in kept:
            won = np.flatnonzero(when == best[cell])
            out.ravel()[cell[won]] = mix(bits[won]) | np.uint64(1)
        short = np.zeros(rows, bool)
        short[np.unique(owner[live])] = True
        short &= (out == 0).any(axis=1)
        bound = np.where(short, bound * 2, 0)
        live = np.flatnonzero(short[owner])
    return out


def _signed(docs: DataFrame, text: str, k: int) -> DataFrame:
    """(h1, h2, bucket) for each band of each row of (h1, h2, text); the last five bits of a bucket are its band's number.

    Of equal texts in one batch one is signed. Slices are bounded by bytes and by rows, so that memory follows neither long nor many texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            order = np.lexsort((h2, h1))
            new = np.ones(len(order), bool)
            new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
            one = np.sort(order[new])
            h1, h2 = h1[one], h2[one]
            size = pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False)[one]
            for a, b in slices(np.append(0, np.cumsum(size, dtype=np.int64)), 1 << 20, 256):
                row, h, count = multisets(*utf8(batch.column(2).take(pa.array(one[a:b]))), k)
                sig = bagminhash(row, h, count, b - a, BANDS * ROWS)
                some = np.flatnonzero((sig != 0).any(axis=1))
                key = np.zeros((len(some), BANDS), np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(0x9FB21C651E98DF25) + sig[some][:, r::ROWS])
                number = np.arange(BANDS, dtype=np.uint64)
                key = mix(key + number) & ~np.uint64(31) | number
                columns = [np.repeat(h1[a:b][some], BANDS), np.repeat(h2[a:b][some], BANDS), key.ravel().view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "bucket"])

    return docs.select("h1", "h2", text).mapInArrow(tidied(run, "powers"), "h1 long, h2 long, bucket long")


def forest(row: np.ndarray, h: np.ndarray, count: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (i, j) between rows of a unit that join all that links of at least threshold connect; row: of each element, ascending.

    Rows are taken as pivots, those with the most widespread elements first. A pivot is held against all other rows of other components whose weights
    allow the threshold, by the exact overlap of their multisets: nothing is estimated. Only rows of left are held against rows of right.
    """
    n = len(comp)
    size = np.bincount(row, minlength=n)
    start = np.cumsum(size) - size
    weight = np.bincount(row, count, n).astype(np.int64)
    words, e = np.unique(h, return_inverse=True)
    spread = np.bincount(row, np.bincount(e)[e], n) / np.maximum(size, 1)
    comp, todo, out = comp.copy(), np.ones(n, bool), []
    mine = np.zeros(len(words), np.int64)
    for i in np.argsort(-spread, kind="stable"):
        todo[i] = False
        ok = todo & (comp != comp[i]) & (np.minimum(weight, weight[i]) >= threshold * np.maximum(weight, weight[i])) & (left[i] & right | right[i] & left)
        j = np.flatnonzero(ok)
        if not len(j) or not weight[i]:
            continue
        own = slice(start[i], start[i] + size[i])
        mine[e[own]] = count[own]
        many = size[j]
        first = np.cumsum(many) - many
        at = np.repeat(start[j] - first, many) + np.arange(int(many.sum()))
        shared = np.add.reduceat(np.minimum(mine[e[at]], count[at]), first)
        mine[e[own]] = 0
        j = j[shared / (weight[i] + weight[j] - shared) >= threshold]
        if len(j):
            parts, one = np.unique(comp[j], return_index=True)
            out += [(int(i), int(j[k])) for k in one]
            comp[np.isin(comp, parts)] = comp[i]
    return out


def settle(rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b): links that join what is similar within each unit; rows: (unit, rep, comp, left, right, text).

    A unit's rows stand side by side after one shuffle of their texts. Many small units are worked on at once, a large one alone; units are bounded by whoever makes them.
    """

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        units = t["unit"].to_numpy()
        reps = t["rep"].to_pylist()
        number: dict = {}
        same = np.array([number.setdefault(r, len(number)) for r in reps], np.int64)
        comp = np.array([number.setdefault(c, len(number)) for c in t["comp"].to_pylist()], np.int64)
        left, right = t["left"].to_numpy(zero_copy_only=False), t["right"].to_numpy(zero_copy_only=False)
        data, offsets = utf8(t["text"])
        parts, base = [], 0
        for a, b in slices(offsets, 1 << 20):
            row, h, count = multisets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
            parts.append((row + a, h, count))
        row, h, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        edge = np.append(np.flatnonzero(np.append(True, units[1:] != units[:-1])), len(units))
        at = np.searchsorted(row, edge)
        links = []
        for u in range(len(edge) - 1):
            (a, b), (p, q) = edge[u : u + 2], at[u : u + 2]
            _, c = np.unique(np.where(comp[a:b] < 0, same[a:b], comp[a:b]), return_inverse=True)
            links += [(base + a + i, base + a + j) for i, j in forest(row[p:q] - a, h[p:q], count[p:q], c, left[a:b], right[a:b], threshold)]
        return pa.RecordBatch.from_arrays([pa.array([reps[x[s]] for x in links], pa.binary()) for s in range(2)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            units = batch.column(0).to_numpy()
            last = int(np.searchsorted(units, units[-1]))  # rows are sorted by unit
            if last:
                whole = pa.concat_tables([*held, pa.Table.from_batches([batch.slice(0, last)])])
                yield from pieces(whole)
                held = []
            elif held and held[-1]["unit"][-1].as_py() != units[0]:
                yield from pieces(pa.concat_tables(held))
                held = []
            held.append(pa.Table.from_batches([batch.slice(last)]))
        if held:
            yield from pieces(pa.concat_tables(held))

    def pieces(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole units, about a megabyte of them at once."""
        size = np.cumsum(pc.binary_length(t["text"]).to_numpy())
        units = t["unit"].to_numpy()
        ends = np.append(np.flatnonzero(units[1:] != units[:-1]) + 1, len(units))
        a, done = 0, 0
        for end in ends:
            if size[end - 1] - done >= 1 << 20 or end == len(units):
                yield solve(t.slice(a, end - a))
                a, done = end, size[end - 1]

    rows = rows.select("unit", "rep", "comp", "left", "right", "text")
    return rows.repartition("unit").sortWithinPartitions("unit", "rep").mapInArrow(tidied(run, "powers"), "a binary, b binary")


def _of_units(links: DataFrame | None, rows: DataFrame) -> DataFrame:
    """rows with comp: what links connect so far, of a row without any itself."""
    if links is None:
        return rows.withColumn("comp", F.col("rep"))
    comp = components(links, "a", "b").select(F.col("id").alias("rep"), F.col("component").alias("comp"))
    return rows.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _by_bucket(member: DataFrame, texts: DataFrame, k: int, threshold: float, rows: int, size: int) -> DataFrame | None:
    """Links among members of groups too large for one unit, bucket by bucket.

    Bands are taken a few at a time (1, 2, 4 ...), and buckets of one component are left out from then on. A bucket over the bounds is dealt to parts by hash; each
    part is settled alone first. Then rows outside the bucket's largest component, few as a rule, are held against each part: all that is open yet, and nothing of what is
    connected already. Every two rows of a bucket are thus in one component or compared exactly.
    """
    links, low, step = None, 0, 1
    shape = texts.select("rep", F.octet_length("text").alias("bytes"))
    band = F.col("bucket").bitwiseAND(F.lit(31))
    while low < BANDS:
        mine = member.where((band >= low) & (band < low + step))
        low, step = low + step, step * 2
        for turn in ("own", "rest"):
            of = _of_units(links, mine)
            seen = of.join(shape, "rep").groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
            seen = seen.withColumn("g", F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("bytes") / size)).cast("int")).where("lo < hi")
            if turn == "rest":
                seen = seen.where("g > 1")
            of = cut(of.join(seen.select("bucket", "g"), "bucket").withColumn("p", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")))
            if of.isEmpty():
                break
            if turn == "own":
                units = of.select("rep", "comp", F.xxhash64("bucket", "p").alias("unit"), F.lit(True).alias("left"), F.lit(True).alias("right"))
            else:
                most = of.groupBy("bucket", "comp").count().groupBy("bucket").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
                of = cut(of.join(most, "bucket").withColumn("open", F.col("comp") != F.col("main")).drop("main"))
                q = of.where("open").groupBy("bucket").agg(F.count("*").alias("m")).select("bucket", F.ceil(F.col("m") / rows).cast("int").alias("gq"))
                of = of.join(q, "bucket").withColumn("q", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("gq")).cast("int"))
                # each row in its own part, beside each part of the open rows; each open row beside each part of all rows
                as_left = of.select("*", F.explode(F.sequence(F.lit(0), F.col("gq") - 1)).alias("y")).select("bucket", "rep", "comp", F.col("p").alias("x"), "y", F.lit(True).alias("left"), F.lit(False).alias("right"))
                as_right = of.where("open").select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("x")).select("bucket", "rep", "comp", "x", F.col("q").alias("y"), F.lit(False).alias("left"), F.lit(True).alias("right"))
                units = as_left.unionByName(as_right).select("rep", "comp", F.xxhash64("bucket", "x", "y").alias("unit"), "left", "right")
            got = cut(settle(units.join(texts, "rep"), k, threshold))
            links = got if links is None else cut(links.unionByName(got))
    return links


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8, k: int = 5, block: int = 4096, block_bytes: int = 8 << 20, small_rows: int = 100_000) -> DataFrame:
    """(key, copy_of, class_id, kept): the smallest key with the same text, the smallest key of the class, and whether it is this row.

    A class holds what links of similarity >= threshold connect. block, block_bytes: rows and bytes of text that one task compares at most. The list of texts to
    fetch is broadcast where it has small_rows rows at most. Only counts reach the driver.
    """
    return _classes(docs, text, key, threshold, k, block, block_bytes, small_rows).drop("h1", "h2")


def _classes(docs: DataFrame, text: str, key: str, threshold: float, k: int, block: int, block_bytes: int, small_rows: int) -> DataFrame:
    blank = F.coalesce(F.col(text), F.lit(""))
    mine = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(blank).alias("h1"), F.xxhash64(F.lit(1), blank).alias("h2"), blank.alias("text"))
    wordy = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    rows = cut(mine.select("id", "h1", "h2", wordy.alias("wordy")))
    copies = cut(rows.where("wordy").groupBy("h1", "h2").agg(F.min("id").alias("low")))
    bands = written(_signed(mine.where(wordy), "text", k))
    met = bands.groupBy("bucket").agg(*(f(c).alias(f"{n}{c}") for c in ("h1", "h2") for n, f in (("a", F.min), ("b", F.max)))).where("ah1 < bh1 or ah2 < bh2").select("bucket")
    rep = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("h1", "h2")))).alias("rep")
    member = cut(bands.join(met, "bucket").select("bucket", "h1", "h2", rep).distinct())
    discard(bands)
    names = cut(member.select("rep", "h1", "h2").distinct())
    # texts that buckets connect, one group each: what is similar lies within a group
    lowest = member.groupBy("bucket").agg(F.min("rep").alias("low"))
    group = components(member.join(lowest, "bucket"), "rep", "low").select(F.col("id").alias("rep"), F.col("component").alias("grp"))
    wanted = cut(names.join(group, "rep").join(copies, ["h1", "h2"]))
    few = F.broadcast(wanted) if wanted.count() <= small_rows else wanted
    at = few.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), "low", "rep", "grp")
    fetched = mine.where(wordy).join(at, (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")) & F.col("id").eqNullSafe(F.col("low"))).select("rep", "grp", "text")
    shared = rows.join(wanted.select("h1", "h2", "low"), ["h1", "h2"]).where(F.col("id").eqNullSafe(F.col("low"))).groupBy("h1", "h2").count().where("count > 1")
    texts = written(fetched if shared.isEmpty() else fetched.dropDuplicates(["rep"]))
    sizes = cut(texts.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")))
    fits = (F.col("n") <= block) & (F.col("bytes") <= block_bytes)
    whole = texts.join(sizes.where(fits), "grp").select(F.xxhash64("grp").alias("unit"), "rep", F.col("rep").alias("comp"), F.lit(True).alias("left"), F.lit(True).alias("right"), "text")
    links = cut(settle(whole, k, threshold))
    large = cut(group.join(sizes.where(~fits), "grp").select("rep"))
    if not large.isEmpty():
        more = _by_bucket(cut(member.select("bucket", "rep").join(large, "rep")), texts.select("rep", "text").join(large, "rep"), k, threshold, max(1, block // 2), max(1, block_bytes // 2))
        links = links if more is None else links.unionByName(more)
    comp = components(links, "a", "b").withColumnRenamed("id", "rep")
    discard(texts)
    first = F.struct(F.col("low").isNull().alias("keyless"), "low", "h1", "h2")
    linked = cut(comp.join(names, "rep").join(copies, ["h1", "h2"]).select("component", "h1", "h2", "low"))
    best = linked.groupBy("component").agg(F.min(first).alias("best"))
    known = copies.join(linked.join(best, "component").select("h1", "h2", "best"), ["h1", "h2"], "left").withColumn("best", F.coalesce("best", first))
    out = rows.join(known, ["h1", "h2"], "left")
    low, top = (F.when(F.col("wordy"), F.col(c)).otherwise(F.col("id")) for c in ("low", "best.low"))
    kept = ~F.col("wordy") | (F.col("id").eqNullSafe(F.col("best.low")) & (F.col("h1") == F.col("best.h1")) & (F.col("h2") == F.col("best.h2")))
    return out.select(F.col("id").alias(key), low.alias("copy_of"), top.alias("class_id"), kept.alias("kept"), "h1", "h2")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8, k: int = 5, block: int = 4096, block_bytes: int = 8 << 20, small_rows: int = 100_000) -> DataFrame:
    """docs without all but one row of each class: of rows that classes() marks as kept and that are alike in key and text, one stays. Rows of null or blank texts that differ in key all stay."""
    marked = _classes(docs, text, key, threshold, k, block, block_bytes, small_rows).where("kept")
    stay = cut(marked.groupBy(F.col(key).alias("__k"), F.col("h1").alias("__1"), F.col("h2").alias("__2")).agg(F.count("*").alias("__n")))
    blank = F.coalesce(F.col(text), F.lit(""))
    same = F.col(key).cast("long").eqNullSafe(F.col("__k")) & (F.xxhash64(blank) == F.col("__1")) & (F.xxhash64(F.lit(1), blank) == F.col("__2"))
    single = docs.join(stay.where("__n = 1"), same, "left_semi")
    often = stay.where("__n > 1")
    if often.isEmpty():
        return single
    return single.unionByName(docs.join(often, same).dropDuplicates(["__k", "__1", "__2"]).select(*docs.columns))


def op1(spark, sf_dir: str) -> DataFrame:
    """Class of each row of documents: doc_id, copy_of, class_id, kept."""
    return classes(table(spark, sf_dir, "documents"))
