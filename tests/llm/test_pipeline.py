"""Each stage of the pipeline on what the stage before it kept, against a plain Python version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline as cp
from gatewarden.llm import bpe, byte_cnn, common, mixing
from tests.llm.test_numpy_parts import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(11)
    good = [prose(rng, rng.randint(40, 90)) for _ in range(70)]
    near = [" ".join([*t.split()[:-1], "other"]) for t in good[:8]]
    private = [f"{prose(rng, 40)} write to ann{k}@mail.example.com or call +1 (743) 555-01{k}2 {prose(rng, 20)}" for k in range(6)]
    bad = ["### ".join(prose(rng, 60).split()) for _ in range(50)]
    texts = [*good, *near, *private, *bad, good[0], good[0], "", None]
    return [(k, t, "en", None if k % 9 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_stages(spark, tmp_path):
    data = rows()
    documents = spark.createDataFrame(data, SCHEMA)
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], int("###" not in (r[1] or ""))) for r in data if r[0] < 130]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, docs = str(tmp_path), common.table(spark, str(tmp_path), "documents")

    kept = cp.quality(spark, docs, sf)
    model = byte_cnn.fit(docs, common.table(spark, sf, "labels"))
    p = byte_cnn.predict(model, *common.utf8(pa.array([r[1] for r in data])))
    first = texts_of(kept)
    assert kept.columns == list(cp.COLUMNS) and set(first) == {r[0] for r, x in zip(data, p) if x >= 0.5}
    assert sum("###" in (t or "") for t in first.values()) <= 2 and len(first) >= 80

    kept = common.cut(cp.near_duplicates(spark, kept, sf))
    bags, low = {k: bag(t) for k, t in first.items()}, {k: k for k in first}
    for _ in range(4):
        for a in sorted(first):
            for b in sorted(first):
                shared = sum((bags[a] & bags[b]).values()) if a < b else 0
                if shared and shared >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - shared):
                    low[a] = low[b] = min(low[a], low[b])
    second = texts_of(kept)
    assert set(second) == set(low.values()) and all(second[k] == first[k] for k in second)

    kept = common.cut(cp.personal_data(spark, kept, sf))
    third = texts_of(kept)
    assert kept.columns == list(cp.COLUMNS) and set(third) == set(second)
    for k, t in second.items():
        if t and "@" in t:
            old, new = t.split(), third[k].split()
            assert len(old) == len(new) and "@mail.example.com" not in third[k] and "@" in third[k]
            assert sum(a != b for a, b in zip(old, new)) == 3  # address, area code, number; the country stays
        else:
            assert third[k] == t
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)

    mixed = common.cut(cp.mixture(spark, kept, sf))
    taken = {r.doc_id: (r.size, r.taken, r.source, r.target) for r in mixing.mix(kept).collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert all(times[k] == (t // n if n else 0) for k, (n, t, _, _) in taken.items()) and max(times.values()) <= 2
    words = Counter()
    for _, t, s, _ in taken.values():
        words[s] += t
    assert all(abs(words[s] - target) <= 10 for _, _, s, target in taken.values())

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    got = cp.tokens(spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in got) == times
    for r in got:
        ids = np.array(library.encode(third[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and list(r.ids) == ids.tolist()
