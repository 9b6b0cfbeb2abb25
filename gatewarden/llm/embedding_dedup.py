"""Near-duplicate embeddings of one label by a robust-pruned flat graph.

Equal vectors of one label are one node with a count. Labels of more than a few hundred nodes are cut into cells around centroids, each fitted on a bounded sample of what is cut; a node
goes to the nearest few cells, so shards overlap, and shards that are still too large are cut again. Shards keep one size however many nodes there are. On each shard a graph is built by
inserting nodes in batches: a greedy search from the medoid finds candidates, which are robustly pruned, so that the edges kept point in different directions. The
adjacency lists that a node got in its shards are joined into one. Then each node is searched for in each of its shards over the joined lists: a greedy search with a bounded beam from
the medoid and from the node's own place, which goes on expanding while nodes within range are left. Whatever is found is verified by its cosine in double precision. A pair that
several shards see counts in the first of them alone.

Dense groups don't cost their square: a centre whose surroundings hold many of a label's sample is a ball. Any two nodes within half the range's angle of it are linked for certain, so
these, the core, are counted and leave the shards. What lies near enough to a ball to be linked with its core without belonging to it is compared with the core in blocks, exactly. A shard that no
centroids cut any smaller is compared in blocks too. No pairs leave a task: only counts and, of each shard, a forest of its links.

Vectors that are null, zero, or hold null or non-finite components, and those without a label, link with nothing. So do vectors of different lengths with each other. Repeated rows
are vectors of their own and link with each other. A row without a key takes part; where no row of a component has one, component_id is null and all its rows are kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, mix, table

DEGREE, BEAM, ALPHA = 16, 24, 1.2
#: Nodes of a sample that must lie around a centre to make it a ball, and balls of a label at most: which way a node takes depends on them, not the result.
DENSE, BALLS = 8, 256


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # very large and very small components neither overflow nor vanish
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k unit centroids at most, starting from points far from each other."""
    centre = [x[0]]
    far = x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        i = int(far.argmin())
        centre.append(x[i])
        far = np.maximum(far, x @ x[i])
    c = np.stack(centre)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            s = x[own == j].sum(axis=0)
            if (n := np.sqrt((s * s).sum())) > 0:
                c[j] = s / n
    return c


def dense_centres(x: np.ndarray, half: float, least: int = DENSE, most: int = BALLS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres that have at least so many of x at a cosine of at least half, the fullest first, and which of x lie around none."""
    f, free, out = x.astype(np.float32), np.ones(len(x), bool), []
    near = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 512):
        near[a : a + 512] = (f[a : a + 512] @ f.T >= half).sum(axis=1)
    for i in np.argsort(-near, kind="stable"):
        if near[i] < least or len(out) == most:
            break
        if free[i] and (mine := free & (x @ x[i] >= half)).sum() >= least:
            s = x[mine].sum(axis=0)
            out.append(s / np.sqrt((s * s).sum()))
            free &= x @ out[-1] < half
            free[i] = False
    return np.stack(out) if out else np.zeros((0, x.shape[1])), free


def _prune(x: np.ndarray, node: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(len(node), degree) of cand (-1: none), robustly pruned: from near to far, each dropping those alpha times nearer to it than to the node."""
    out = np.full((len(node), degree), -1, np.int64)
    for a in range(0, len(node), 128):
        part, c = node[a : a + 128], cand[a : a + 128]
        v = x[c]
        s = np.where((c >= 0) & (c != part[:, None]), np.matmul(v, x[part][:, :, None])[:, :, 0], -3.0)
        order = np.argsort(-s, axis=1, kind="stable")
        c, s, v = np.take_along_axis(c, order, axis=1), np.take_along_axis(s, order, axis=1), np.take_along_axis(v, order[:, :, None], axis=1)
        alive = s > -2
        alive[:, 1:] &= c[:, 1:] != c[:, :-1]
        rows = np.arange(len(part))
        for k in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            out[a : a + 128, k][some] = c[rows, first][some]
            alive[rows, first] = False
            alive &= alpha * (1 - np.matmul(v, v[rows, first][:, :, None])[:, :, 0]) > 1 - s
    return out


def _beam(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int, wide: int = 4) -> np.ndarray:
    """(len(q), beam) nodes nearest to each query that a greedy search from start finds (-1: none); wide nodes are expanded at a step."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for "no node"
    seen[:, start] = seen[:, -1] = True
    ids, done = np.full((n, beam), -1, np.int64), np.ones((n, beam), bool)
    sims = np.full((n, beam), -3.0, x.dtype)
    ids[:, 0], done[:, 0], sims[:, 0] = start, False, q @ x[start]
    live = np.arange(n)
    while len(live):
        rank = np.where(done[live], -4.0, sims[live])
        pick = np.argsort(-rank, axis=1, kind="stable")[:, :wide]
        ok = np.take_along_axis(rank, pick, axis=1) > -3
        keep = ok.any(axis=1)
        live, pick, ok = live[keep], pick[keep], ok[keep]
        if not len(live):
            break
        done[live[:, None], pick] = True
        at = np.where(ok, ids[live[:, None], pick], -1)
        new = np.where(at[:, :, None] >= 0, graph[at], -1).reshape(len(live), -1)
        new = np.sort(new, axis=1)
        fresh = ~seen[live[:, None], new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        seen[live[:, None], new] = True
        s = np.where(fresh, np.matmul(x[new], q[live][:, :, None])[:, :, 0], -3.0)
        all_s = np.concatenate([sims[live], s], axis=1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[live] = np.take_along_axis(all_s, top, axis=1)
        ids[live] = np.where(sims[live] > -3, np.take_along_axis(np.concatenate([ids[live], new], axis=1), top, axis=1), -1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), top, axis=1) | (ids[live] < 0)
    return ids


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def robust_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 256) -> np.ndarray:
    """(n, degree) neighbours, -1 where there are fewer, by inserting nodes in batches that double up to a bound.

    A node's candidates are what a greedy search from the medoid finds among those inserted before, and the nearest of its own batch. Edges are given back to
    the nodes that they point at, whose lists are pruned anew when full.
    """
    n, x = len(x), x.astype(np.float32)
    graph = np.full((n, degree), -1, np.int64)
    start = medoid(x)
    order = np.concatenate([[start], np.delete(np.random.default_rng(7).permutation(n), np.flatnonzero(np.random.default_rng(7).permutation(n) == start))])
    at = 0
    while at < n:
        new = order[at : at + min(max(at, 32), batch)]
        own = x[new] @ x[new].T
        np.fill_diagonal(own, -3)
        few = min(12, len(new))
        cand = new[np.argsort(-own, axis=1, kind="stable")[:, :few]]
        if at:
            cand = np.concatenate([_beam(x, graph, start, x[new], beam), cand], axis=1)
        graph[new] = _prune(x, new, cand, degree, alpha)
        source, k = np.nonzero(graph[new] >= 0)
        to, source = graph[new][source, k], new[source]
        order_ = np.lexsort((-np.einsum("ij,ij->i", x[to], x[source]), to))
        to, source = to[order_], source[order_]
        who, first, many = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, many)
        some = place < 2 * degree  # of a hub's new edges the nearest
        back = np.full((len(who), 2 * degree), -1, np.int64)
        back[np.repeat(np.arange(len(who)), many)[some], place[some]] = source[some]
        graph[who] = _prune(x, who, np.concatenate([graph[who], back], axis=1), degree, alpha)
        at += len(new)
    return graph


def both_ways(node: np.ndarray, near: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each node's list, and the lists, of edges taken in both directions."""
    edge = np.unique(np.concatenate([node * n + near, near * n + node]))
    return np.searchsorted(edge // n, np.arange(n + 1)), edge % n


def range_search(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray], radius: float, beam: int = BEAM, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, with x[i] . x[j] >= radius that the search finds, from the medoid and each query's own place.

    First a beam of bounded width goes on while it improves; then whatever lies within range is expanded until nothing new within range comes up.
    """
    n, f = len(x), x.astype(np.float32)
    degree = int(np.diff(graph[0]).max(initial=1))
    lists = np.full((n, max(degree, 1)), -1, np.int64)
    size = np.diff(graph[0])
    lists[np.repeat(np.arange(n), size), np.arange(len(graph[1])) - np.repeat(graph[0][:-1], size)] = graph[1]
    lists = lists[:, : 4 * DEGREE] if degree > 4 * DEGREE else lists  # for the beam alone; expansion takes whole lists
    start, left, right = medoid(x), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n, block):
        q = np.arange(a, min(a + block, n))
        tested, hit = np.zeros((len(q), n), bool), np.zeros((len(q), n), bool)
        best = _beam(f, lists, start, f[q], beam)
        who, node = np.nonzero(best >= 0)
        node = best[who, node]
        who, node = np.concatenate([who, np.arange(len(q))]), np.concatenate([node, q])
        expand = True  # the query's own place, whatever the beam found
        while len(who):
            new = ~tested[who, node]
            code = np.unique(who[new] * n + node[new])
            who, node = code // n, code % n
            tested[who, node] = True
            good = np.zeros(len(who), bool)
            for s in range(0, len(who), 1 << 16):
                part = slice(s, s + (1 << 16))
                good[part] = np.einsum("ij,ij->i", x[q[who[part]]], x[node[part]]) >= radius
            hit[who[good], node[good]] = True
            who, node = who[good], node[good]
            if expand and len(q):
                own = np.arange(len(q))
                who, node, expand = np.concatenate([who, own]), np.concatenate([node, q]), False
            many = size[node]
            who = np.repeat(who, many)
            node = graph[1][np.repeat(graph[0][node] - np.cumsum(many) + many, many) + np.arange(len(who))]
        i, j = np.nonzero(hit)
        left.append(q[i])
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    both = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
    i, j = both // n, both % n
    return i[i < j], j[i < j]


def tally(node: list, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """(nid, links, root): links found here, weighed by copies, and the smallest node that they reach."""
    order = sorted(range(len(node)), key=node.__getitem__)
    low = np.empty(len(node), np.int64)
    low[order] = np.arange(len(node))
    links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
    a, b = i, j
    while len(a):
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        if (new == low).all():
            break
        low = new
    keep = np.flatnonzero(links > 0)
    return pd.DataFrame({"nid": [node[k] for k in keep], "links": links[keep].astype(np.int64), "root": [node[order[low[k]]] for k in keep]})


def _first_shared(lists, me: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether shard me is the first of those that both ends of each pair are in."""
    sets = [np.asarray(x, np.int64) for x in lists]
    width = max(map(len, sets), default=1)
    m = np.full((len(sets), width), np.iinfo(np.int64).max)
    for k, s in enumerate(sets):
        m[k, : len(s)] = np.sort(s)
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 17):
        a, b = m[i[s : s + (1 << 17)]], m[j[s : s + (1 << 17)]]
        both = (a[:, :, None] == b[:, None, :]).any(axis=2)
        out[s : s + (1 << 17)] = np.where(both, a, np.iinfo(np.int64).max).min(axis=1) == me
    return out


def valid_vectors(df: DataFrame, vector: str, label: str) -> DataFrame:
    ok = F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.where(ok & finite & F.exists(vector, lambda v: v != 0))


def _split(member: DataFrame, sizes: DataFrame, target: int, overlap: int, sample: int, radius: float, balls: bool, turn: int) -> DataFrame:
    """(nid, copies, v, to, role): rows of member, whose shards are all cut, in their new shards (role 0), the ball whose core they are (1), or the balls near which they lie (2).

    Centroids are fitted on about sample nodes of each shard at most, those of the smallest hashes; each shard's rows are dealt to tasks by hash, and meet its centroids there.
    """
    half = float(np.cos(np.arccos(radius) / 2 - 1e-9))
    around = float(np.cos(min(np.pi, np.arccos(radius) * 1.5 + 1e-9)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nid", ignore_index=True)
        x, n = np.stack(pdf["v"].to_list()), int(pdf["size"].iloc[0])
        dense, free = dense_centres(x, half) if balls else (np.zeros((0, x.shape[1])), np.ones(len(x), bool))
        rest = x[free] if free.any() else x[:1]
        k = max(2, min(128, round(n * free.mean() / target)))
        c = spherical_kmeans(rest, k)
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "j": np.arange(len(dense) + len(c)), "ball": [True] * len(dense) + [False] * len(c), "c": [*dense, *c]})

    picked = member.join(sizes, "shard").where(F.pmod(F.xxhash64(F.lit(turn), "nid"), F.greatest("size", F.lit(1))) < sample).select("shard", "nid", "v", "size")
    model = cut(picked.groupBy("shard").applyInPandas(fit, "shard long, j long, ball boolean, c array<double>"))
    parts = F.ceil(F.col("size") / 10_000).cast("int")
    rows = member.join(sizes, "shard").select("shard", F.pmod(F.xxhash64(F.lit(3), "nid"), parts).cast("int").alias("part"), "nid", "copies", "v")
    dealt = model.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("size")

    def assign(pdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"nid": [], "copies": [], "v": [], "to": [], "role": []})
        cdf = cdf.sort_values("j", ignore_index=True)
        c, ball = np.stack(cdf["c"].to_list()), cdf["ball"].to_numpy(bool)
        x = np.stack(pdf["v"].to_list())
        shard = np.uint64(int(pdf["shard"].iloc[0]) & ((1 << 64) - 1))
        name = mix(mix(np.full(len(c), shard, np.uint64)) + np.arange(len(c), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        s = x @ c.T
        d, p = np.flatnonzero(ball), np.flatnonzero(~ball)
        core = np.full(len(x), -1)
        row, to, role = [], [], []
        if len(d):
            best = s[:, d].argmax(axis=1)
            core = np.where(s[np.arange(len(x)), d[best]] >= half, best, -1)
            r = np.flatnonzero(core >= 0)
            row.append(r), to.append(name[d[core[r]]]), role.append(np.full(len(r), 1))
            r, b = np.nonzero(s[:, d] >= around)
            out = (core[r] < 0) | (core[r] > b)  # of two cores one is held against the other
            r, b = r[out & (core[r] != b)], b[out & (core[r] != b)]
            row.append(r), to.append(name[d[b]]), role.append(np.full(len(r), 2))
        r = np.flatnonzero(core < 0)
        near = np.argsort(-s[r][:, p], axis=1, kind="stable")[:, :overlap]
        row.append(np.repeat(r, near.shape[1])), to.append(name[p[near.ravel()]]), role.append(np.zeros(near.size, np.int64))
        row = np.concatenate(row)
        return pd.DataFrame({"nid": pdf["nid"].to_numpy()[row], "copies": pdf["copies"].to_numpy()[row], "v": [pdf["v"].iloc[k] for k in row], "to": np.concatenate(to), "role": np.concatenate(role)})

    pair = rows.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part"))
    return pair.applyInPandas(assign, "nid binary, copies long, v array<double>, to long, role int")


def link(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", radius: float = 0.93, overlap: int = 3, target: int = 128, most: int = 1024, sample: int = 3000, block: int = 4096) -> DataFrame:
    """(key, n_links, component_id, kept) for each row.

    target: nodes of a centroid's own cell, a label being cut if it has four times as many; most: nodes of a shard, which is cut again beyond; sample: nodes that centroids of
    one shard are fitted on at most; block: nodes of a block where nodes are compared whole.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    at = F.when(F.col("label").isNotNull(), F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(k), "label", "v")), 16, "0") for k in (0, 1)))))
    good = valid_vectors(rows, "v", "label").withColumn("nid", at)
    group = F.xxhash64("label", F.size("v")).alias("shard")

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["v"].map(len)):
                yield part.assign(v=list(unit(np.stack(part["v"].to_list()))))

    nodes = good.groupBy("nid").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label"))
    nodes = cut(nodes.select("nid", "low", "copies", group, "v").mapInPandas(scaled, "nid binary, low long, copies long, shard long, v array<double>"))
    member, limit, settled, near_balls = nodes.select("shard", "nid", "copies", "v"), 4 * target, None, None
    stuck = None
    for turn in range(8):
        sizes = cut(member.groupBy("shard").agg(F.count("*").alias("size")))
        large = sizes.where(F.col("size") > limit)
        fine = member.join(sizes.where(F.col("size") <= limit).select("shard"), "shard", "left_semi")
        settled = fine if settled is None else settled.unionByName(fine)
        if large.isEmpty():
            break
        if turn == 7:
            stuck = member.join(large, "shard")
            break
        made = cut(_split(member.join(large.select("shard"), "shard", "left_semi"), large, target, overlap if turn == 0 else 2, sample, radius, turn == 0, turn))
        if turn == 0:
            near_balls = made.where("role > 0")
        member, limit = made.where("role = 0").select(F.col("to").alias("shard"), "nid", "copies", "v"), most

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("nid").sort_values("nid", ignore_index=True)
        nid = pdf["nid"].to_numpy()
        graph = robust_graph(np.stack(pdf["v"].to_list()))
        return pd.DataFrame({"nid": nid, "shard": pdf["shard"].iloc[0], "near": [list(nid[g[g >= 0]]) for g in graph]})

    lists = settled.groupBy("shard").applyInPandas(build, "nid binary, shard long, near array<binary>")
    if stuck is not None:
        lists = lists.unionByName(stuck.select("nid", "shard", F.array().cast("array<binary>").alias("near")))
    joined = cut(lists.groupBy("nid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_set("shard").alias("shards")))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("nid").sort_values("nid", ignore_index=True)
        nid = pdf["nid"].to_list()
        x, place = np.stack(pdf["v"].to_list()), {v: k for k, v in enumerate(nid)}
        edges = np.array([(k, place[o]) for k, near in enumerate(pdf["near"]) for o in near if o in place], np.int64).reshape(-1, 2)
        i, j = range_search(x, both_ways(edges[:, 0], edges[:, 1], len(nid)), radius)
        first = _first_shared(pdf["shards"], int(pdf["shard"].iloc[0]), i, j)
        return tally(nid, pdf["copies"].to_numpy(), i[first], j[first])

    out = "nid binary, links long, root binary"
    found = settled.join(joined, "nid").groupBy("shard").applyInPandas(search, out)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of left against rows of right; whoever is on both sides meets each other once."""
        left, right = np.flatnonzero(pdf["left"]), np.flatnonzero(pdf["right"])
        x, nid = np.stack(pdf["v"].to_list()), pdf["nid"].to_list()
        own = bool((pdf["left"] & pdf["right"]).all())
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(left), 512):
            r, c = np.nonzero(x[left[a : a + 512]] @ x[right].T >= radius)
            r = r + a
            ok = left[r] < right[c] if own else np.ones(len(r), bool)
            i.append(left[r[ok]])
            j.append(right[c[ok]])
        i, j = np.concatenate(i), np.concatenate(j)
        if "shards" in pdf:
            first = _first_shared(pdf["shards"], int(pdf["shard"].iloc[0]), i, j)
            i, j = i[first], j[first]
        return tally(nid, pdf["copies"].to_numpy(), i, j)

    if stuck is not None:
        big = stuck.join(joined.select("nid", "shards"), "nid").withColumn("g", F.ceil(2 * F.col("size") / block).cast("int"))
        big = big.withColumn("me", F.pmod(F.xxhash64("nid"), F.col("g")).cast("int"))
        to = F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.least(o, "me").alias("x"), F.greatest(o, "me").alias("y"))))
        big = big.withColumn("to", to).select("*", "to.x", "to.y").withColumns({"left": F.col("me") == F.col("x"), "right": F.col("me") == F.col("y")})
        found = found.unionByName(big.groupBy("shard", "x", "y").applyInPandas(compare, out))
    if near_balls is not None:
        core = near_balls.where("role = 1")
        ball = cut(core.groupBy("to").agg(F.sum("copies").alias("all"), F.min("nid").alias("root"), F.count("*").alias("n")))
        found = found.unionByName(core.join(ball, "to").select("nid", (F.col("all") - F.col("copies")).alias("links"), "root"))
        fringe = near_balls.where("role = 2")
        shape = cut(fringe.groupBy("to").agg(F.ceil(F.count("*") / block).cast("int").alias("gy")).join(ball, "to").select("to", "gy", F.ceil(F.col("n") / block).cast("int").alias("gx")))
        if not shape.isEmpty():
            span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            part = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
            one = core.join(shape, "to").select("to", "nid", "copies", "v", part("gx").alias("x"), span("gy").alias("y"), F.lit(True).alias("left"), F.lit(False).alias("right"))
            two = fringe.join(shape, "to").select("to", "nid", "copies", "v", span("gx").alias("x"), part("gy").alias("y"), F.lit(False).alias("left"), F.lit(True).alias("right"))
            found = found.unionByName(one.unionByName(two).groupBy("to", "x", "y").applyInPandas(compare, out))
    found = cut(found)
    counts = found.groupBy("nid").agg(F.sum("links").alias("links"))
    comp = components(found.where("root <> nid"), "nid", "root").withColumnRenamed("id", "nid")
    known = nodes.select("nid", "low", "copies").join(counts, "nid", "left").join(comp, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    known = cut(known.select("nid", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"))
    top = known.groupBy("component").agg(F.min("low").alias("component_id"))
    back = rows.withColumn("nid", at).join(known.join(top, "component").select("nid", "n_links", "component_id"), "nid", "left")
    top = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return back.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), top.alias("component_id"), top.eqNullSafe(F.col("id")).alias("kept"))


def audit(df: DataFrame, linked: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", radius: float = 0.93, share: int = 50, most: int = 1024) -> float:
    """Links found over links that brute force finds, for the queries whose key is divisible by share, each against all rows in blocks.

    Beyond most queries, about so many of the smallest hashes stand for them, so that what each task holds, and the work, stay in proportion to the rows.
    """
    rows = valid_vectors(df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.transform(vector, lambda v: v.cast("double")).alias("v")), "v", "label")
    asked = rows.where(F.col("id") % share == 0)
    n = asked.count()
    if n > most:
        asked = asked.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1_000_003)) < int(most / n * 1_000_003))
    got = asked.collect()
    if not got:
        return 1.0
    sides = {}
    for w in {len(r.v) for r in got}:
        own = [r for r in got if len(r.v) == w]
        sides[w] = unit(np.array([r.v for r in own])), np.array([str(r.label) for r in own]), np.array([r.id for r in own])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w, part in pdf.groupby(pdf["v"].map(len)):
                if w in sides:
                    q, own, keys = sides[w]
                    hit = (unit(np.stack(part["v"].to_list())) @ q.T >= radius) & (part["label"].to_numpy()[:, None] == own)
                    yield pd.DataFrame({key: keys, "n": hit.sum(axis=0)})

    true = rows.select(F.col("label").cast("string").alias("label"), "v").mapInPandas(count, f"{key} long, n long").groupBy(key).agg((F.sum("n") - 1).alias("n"))
    found, want = true.join(linked.where(F.col(key) % share == 0), key).agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return 1.0 if not want else found / want


def op4(spark, sf_dir: str) -> DataFrame:
    """Links and component of each row of embeddings, and the recall of links that the audit finds, alike in each row."""
    df = table(spark, sf_dir, "embeddings")
    linked = cut(link(df))
    return linked.withColumn("recall", F.lit(float(audit(df, linked))))
