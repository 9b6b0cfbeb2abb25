"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatewarden.llm import bpe, byte_cnn, embedding_dedup, mixing, near_dedup, quality_rules, substring_dedup, surrogates, toxicity, url_filter
from gatewarden.llm.common import components
from tests.llm.test_numpy_parts import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rep long, n_words long, entities string"


def documents(spark, texts, sources=None):
    rows = [(k, t, "en", (sources or ["a"] * len(texts))[k], 0, 1, 2, 3, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def edge_texts():
    rng = random.Random(1)
    long = prose(rng, 30_000)
    a = prose(rng, 80)
    near = " ".join(["changed", *a.split()[1:]])
    return [a, a, near, "", None, "   ", "one two", "one two", long, long + " tail", prose(rng, 80)]


def test_near_duplicates_against_brute_force(spark):
    texts = edge_texts()
    rng = random.Random(2)
    base = prose(rng, 100).split()
    for _ in range(60):  # a large group of near copies, more than a small bucket
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else None for t in texts]
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(bags):
            for j, y in enumerate(bags[:i]):
                if x and y and low[i] != low[j]:
                    shared = sum((x & y).values())
                    if shared >= 0.8 * (sum(x.values()) + sum(y.values()) - shared):
                        low[i] = low[j] = min(low[i], low[j])
                        changed = True
    docs = documents(spark, texts)
    got = near_dedup.classes(docs).orderBy("doc_id").collect()
    assert [r.class_id for r in got] == low
    assert [r.kept for r in got] == [k == c for k, c in enumerate(low)]
    parts = near_dedup.classes(docs, block=8).collect()  # large groups, in parts of four rows
    assert {r.doc_id: r.class_id for r in parts} == dict(enumerate(low))
    twice = near_dedup.keep_one(docs.unionByName(docs))
    assert twice.count() == len(set(low)) and twice.columns == docs.columns


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.classes(documents(spark, ["x"]).limit(0)).count() == 0


def test_passages(spark):
    rng = random.Random(3)
    p = prose(rng, 70)
    texts = [prose(rng, 60) + " " + p, prose(rng, 90), p + " " + prose(rng, 30), None, "", "a" * 3000]
    got = substring_dedup.passages(documents(spark, texts)).collect()
    assert {r.doc_id for r in got if not r.kept} == {2} and {r.doc_id for r in got} <= {0, 2, 5}
    for r in got:
        if r.doc_id == 2:
            assert texts[2].encode()[r.start : r.end].decode() in p and r.first_doc_id == 0
    assert substring_dedup.passages(documents(spark, ["x"]).limit(0)).count() == 0


def test_passages_of_shared_and_missing_keys(spark):
    rng = random.Random(31)
    p, q = prose(rng, 60), prose(rng, 70)
    rows = [(0, f"{prose(rng, 200)} {p}"), (0, prose(rng, 30)), (1, f"{p} {prose(rng, 40)}"), (None, f"{q} {prose(rng, 5)}"), (None, f"{prose(rng, 9)} {q}"), (7, f"{prose(rng, 5)} " + f"{prose(rng, 50)} " * 3), (8, prose(rng, 90)), (8, prose(rng, 90))]
    rows += [rows[6], (9, rows[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (32, 1):  # the usual way, and all by the way of hot digests
        got = substring_dedup.passages(docs, hot_one_in=1, hot_least=hot).collect()
        assert {(r.doc_id, r.first_doc_id, r.kept) for r in got} == {(0, 0, True), (1, 0, False), (9, 1, False), (1, 1, True), (None, None, True), (None, None, False)}
        texts = {(k, t) for k, t in rows}
        assert all(any(t.encode()[r.start : r.end] in w.encode() for k, t in texts if k == r.doc_id for w in (p, q, rows[2][1])) for r in got)
    alone = substring_dedup.passages(docs, within=True).where("doc_id = 7").collect()
    assert [(r.kept, r.first_doc_id) for r in sorted(alone, key=lambda r: r.start)] == [(True, 7), (False, 7)]


def test_passages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.text or "").split() for r in docs.select("doc_id", "text").collect()}

    def sharing(n):
        held = {}
        for k, w in texts.items():
            for i in range(len(w) - n + 1):
                held.setdefault(" ".join(w[i : i + n]), set()).add(k)
        return set().union(*(v for v in held.values() if len(v) > 1))

    got = {r.doc_id for r in substring_dedup.passages(docs).collect()}
    assert len(got & sharing(51)) >= 0.99 * len(sharing(51)) and got <= sharing(15)


def test_short_passages_are_found(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 6)))
    some = lambda n: " ".join(word() for _ in range(n))
    texts = []
    for _ in range(1500):
        p = some(51)
        texts += [f"{some(20)} {p} {some(20)}", f"{some(9)} {p} {some(30)}"]
    docs = documents(spark, texts)
    got = substring_dedup.passages(docs)
    assert got.where("not kept and n_words <= 51").select("doc_id").distinct().count() >= 0.99 * 1500
    hot = substring_dedup.passages(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000)), hot_one_in=1, hot_least=3)  # by the way of hot digests
    plain = substring_dedup.passages(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000)))
    assert sorted(hot.collect()) == sorted(plain.collect())


def test_bpe(spark):
    got = bpe.encode(documents(spark, ["Hello there", None, "", "x" * 9000, "Hello there"]), bpe.default_path()).orderBy("doc_id").collect()
    assert got[0].ids == got[4].ids and got[1].n_tokens == got[2].n_tokens == 0 and got[1].ids_sha256 == got[2].ids_sha256
    assert got[0].decoded == "hello</w> there</w>"
    assert bpe.encode(documents(spark, ["x"]).limit(0), bpe.default_path()).count() == 0


def test_embeddings(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(0, e, 1, 7), (1, e, 1, 7), (2, [0.99, 0.05, 0.0], 1, 7), (3, e, 2, 7), (4, e, None, 7), (5, None, 1, 7), (6, [0.0, 0.0, 0.0], 1, 7), (7, [1.0, None, 0.0], 1, 7), (8, [float("nan"), 1.0, 0.0], 1, 7), (9, [], 1, 7), (10, [0.0, 1.0, 0.0], 1, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(df).collect()}
    assert got[0] == (2, 0, True) and got[1] == (2, 0, False) and got[2] == (2, 0, False)
    assert all(got[k] == (0, k, True) for k in range(3, 11))
    hot = embedding_dedup.link(df, most=1)  # blocks in place of the graph
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hot.collect()} == got
    assert embedding_dedup.link(df.limit(0)).count() == 0
    assert embedding_dedup.audit(df, embedding_dedup.link(df), share=1) == 1.0


def test_embeddings_of_many_shards_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    unit = lambda n: rng.normal(size=(n, 24))
    hot = unit(1)
    rows = []
    for label in ("a", "b"):
        groups = [c + 0.12 * rng.normal(size=(rng.integers(2, 9), 24)) for c in unit(20)]
        x = np.concatenate([*groups, unit(150), hot + 0.02 * rng.normal(size=(60, 24)), hot + 0.33 * rng.normal(size=(25, 24))])
        rows += [(label, v.tolist()) for v in rng.permutation(np.concatenate([x, x[:5]]))]
    rows += [("a", [1.0, 0.1]), ("a", [1.0, 0.11]), ("a", [1.0, 0.1]), ("b", [1e200] * 24), ("b", [1e-200] * 24)]
    df = spark.createDataFrame([(k, v, label) for k, (label, v) in enumerate(rows)], "vec_id long, embedding array<double>, label string")
    linked = embedding_dedup.link(df, target=16, most=64, block=16).cache()
    got = {r.vec_id: r for r in linked.collect()}
    low, degree = list(range(len(rows))), [0] * len(rows)
    for width in (2, 24):
        for label in ("a", "b"):
            ids = [k for k, (n, v) in enumerate(rows) if n == label and len(v) == width]
            if ids:
                u = embedding_dedup.unit(np.array([rows[k][1] for k in ids]))
                near = u @ u.T >= 0.93
                for i, k in enumerate(ids):
                    degree[k] = int(near[i].sum()) - 1
                for _ in range(len(ids)):
                    new = [min(low[ids[j]] for j in np.flatnonzero(near[i])) for i in range(len(ids))]
                    if new == [low[k] for k in ids]:
                        break
                    for i, k in enumerate(ids):
                        low[k] = new[i]
    found = sum(min(got[k].n_links, degree[k]) for k in got)
    assert all(got[k].n_links <= degree[k] for k in got) and found >= 0.99 * sum(degree)
    assert sum(got[k].component_id == low[k] for k in got) >= 0.99 * len(rows)
    assert [got[len(rows) - k].n_links for k in (5, 4, 3)] == [2, 2, 2] and got[len(rows) - 2].n_links >= 1
    assert embedding_dedup.audit(df, linked, share=1) >= 0.99


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, trust string")


def test_urls_against_brute_force(spark):
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [
        (0, "https://A.Example.com/en/7?x", link("good.org"), "?", "?"),
        (1, "http://b.com/en/1", link("b.com"), "?", "?"),
        (2, "http://bad.io/", link("b.com", "c.io"), "?", "?"),
        (3, "http://good.org/x", link("fine.io"), "?", "?"),
        (4, "http://fine.io#top", None, "?", "?"),
        (5, None, "x", "?", "?"),
        (6, "no scheme", link("b.com"), "?", "?"),
        (7, "http://x.net/de/1", link("bad.io"), "?", "?"),
        (8, "http://example.net/de/8", "", "?", "?"),
        (9, "http://evil.io/", link("b.com"), "?", "?"),
        (9, "http://evil.io/", link("b.com"), "?", "?"),
    ]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, rows)).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1].rule == "com/en/" and got[1].verdict == "block" and got[8].verdict == "block" and got[7].verdict == "allow"
    assert (got[5].host, got[5].verdict, got[6].host, got[6].verdict) == ("", "allow", "", "allow")
    assert got[9].verdict == "block" and got[3].verdict == got[4].verdict == "allow" and got[4].host == "fine.io" and got[4].path == ""
    # brute force: distrust walks against links from the seeds b.com and example.net
    edges = {("a.example.com", "good.org"): 1, ("bad.io", "b.com"): 1, ("bad.io", "c.io"): 1, ("good.org", "fine.io"): 1, ("x.net", "bad.io"): 1, ("evil.io", "b.com"): 2}
    back = Counter()
    for (_, t), n in edges.items():
        back[t] += n
    rank = base = {"b.com": 0.15 * 0.5, "example.net": 0.15 * 0.5}
    for _ in range(8):
        new = Counter(base)
        for (s, t), n in edges.items():
            new[s] += 0.85 * rank.get(t, 0) * n / back[t]
        rank = new
    assert got[9].distrust == pytest.approx(rank["evil.io"]) and got[2].distrust == pytest.approx(rank["bad.io"])
    assert url_filter.judge(pages(spark, rows).limit(0)).count() == 0


def test_url_verdicts_of_any_size(spark):
    link = lambda host: f'<a href="http://{host}/x">'
    near = [(0, "http://b.com/en/1", "", "?", "?"), (1, "http://h1.io/", link("b.com"), "?", "?")] + [(k, f"http://h{k}.io/", link(f"h{k - 1}.io"), "?", "?") for k in range(2, 13)]
    more = [(k, f"http://k{k}.com/en/1", "", "?", "?") for k in range(100, 600)]
    for rows in (near, near + more):
        got = {r.page_id: r for r in url_filter.judge(pages(spark, rows), threshold=1e-3).collect()}
        assert all(got[k].verdict == "block" for k in range(13))  # twelve links from the seed too
        assert got[12].distrust == pytest.approx(0.15 * 0.85**12 / (len(rows) - 12))


def test_quality_rules(spark):
    rng = random.Random(4)
    boiler = "all rights are reserved by the owner of this page"
    texts = [f"{prose(rng, 12)}\n{boiler}\n{boiler} " for _ in range(12)] + [prose(rng, 60) for _ in range(8)] + ["a b c d e f g h " * 6, None, "", "x " * 70_000]
    got = quality_rules.judge(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [False] * 12 + [True] * 8 + [False] * 4
    assert got[0].lost_words == 20 and got[20].n_repeat_words == 48 and got[21].n_words == 0 and got[23].n_repeat_words == 70_000
    assert quality_rules.judge(documents(spark, ["x"]).limit(0)).count() == 0


def test_classifiers(spark):
    rng = random.Random(5)
    texts = [prose(rng, 50) + (" grr hiss" if k % 4 == 0 else "") if k % 3 else "### ".join(prose(rng, 50).split()) for k in range(240)] + [None, ""]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 4 == 0 and k % 3 > 0)) for k in range(240)] + [(0, None, None)], "doc_id long, quality int, toxic int")
    got = byte_cnn.score(docs, byte_cnn.fit(docs, labels)).collect()
    right = [r.predicted == int(r.doc_id % 3 > 0) for r in got if r.held_out and r.doc_id < 240]
    assert len(got) == 242 and sum(right) >= 0.95 * len(right) and all(0 <= r.score <= 1 for r in got)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 242 and all(0 <= r.score <= 1 for r in got)
    unmatched = labels.withColumn("doc_id", F.col("doc_id") + 1000)
    assert byte_cnn.score(docs, byte_cnn.fit(docs, unmatched)).where("score = 0.5").count() == 242
    assert toxicity.score(docs, toxicity.fit(docs, unmatched)).where("predicted = 0").count() == 242
    empty = docs.limit(0)
    assert byte_cnn.score(empty, byte_cnn.fit(empty, labels)).count() == toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    none = labels.limit(0)
    assert byte_cnn.score(docs, byte_cnn.fit(docs, none)).where("score = 0.5").count() == 242
    assert toxicity.score(docs, toxicity.fit(docs, none)).where("predicted = 0").count() == 242


def test_mixing(spark):
    rng = random.Random(6)
    sources = [rng.choice(["a", "b", "c", None]) for _ in range(400)]
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(398)] + [None, " "]
    docs = documents(spark, texts, sources)
    got = mixing.mix(docs, group=10).collect()
    again = mixing.mix(docs.repartition(3), group=10).collect()
    assert len(got) == 400 and {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    sums, target = Counter(), {}
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").split()) and r.taken in (0, r.size, 2 * r.size)
        sums[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(sums[s] - t) <= 1 for s, t in target.items())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_surrogates(spark):
    texts = ["mail a.b@Mail7.example.com and A.B@mail7.example.com", "call +1 (743) 555-3824", "card 4111 1111 1111 1111 or 4111111111111111", "ip 43.21.141.162", "iban GB29NWBK60161331926819", "Mrs. Anna Smith", "", None, "nothing 12 here", "ip 43.21.141.162 again"]
    got = {r.doc_id: r for r in surrogates.replace(documents(spark, texts)).collect()}
    assert got[7].text is None and got[6].text == "" and got[8].text == texts[8] and got[8].n_entities == 0
    first, second = got[0].text.split(" ")[1], got[0].text.split(" ")[3]
    assert first == second and "mail7" not in got[0].text
    assert got[3].text.split()[1] == got[9].text.split()[1] != "43.21.141.162"
    import re

    from gatewarden.functions.engine import luhn

    a, b = re.findall("[0-9 ]{16,}", got[2].text)
    assert a.replace(" ", "") == b.replace(" ", "") and luhn(b.strip()) and re.fullmatch(r"call \+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", got[1].text)
    assert re.fullmatch(r"Mrs\. [A-Z][a-z]+ [A-Z][a-z]{4}", got[5].text) and got[5].text.split()[1] in surrogates.GIVEN["f"]
    rows = [(f"{k}.{k}.1.{k}",) for k in range(1, 200)]
    found = spark.createDataFrame(rows, "entity string").select(F.lit("ip").alias("kind"), "entity", F.concat(F.lit("ip:"), "entity").alias("same"))
    assert surrogates.collisions(found, "k").count() <= 5
    assert surrogates.replace(documents(spark, ["x"]).limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    good = [prose(rng, 60) for _ in range(60)]
    bad = ["### ".join(prose(rng, 60).split()) for _ in range(60)]
    docs = documents(spark, good + bad + [good[0], None], [f"s{k % 3}" for k in range(122)]).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 60)) for k in range(120)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {*range(60), 121} and max(Counter(r.doc_id for r in got).values()) == 2


def test_components(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(1, 30)] + [(3000, 3000)]
    low = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: c for x, c in low.items() if x != 3000}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
