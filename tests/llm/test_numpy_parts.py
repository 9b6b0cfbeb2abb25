"""The parts of the operators that need no session, against brute force."""

import array
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gatewarden.llm import bpe, byte_cnn, common, embedding_dedup, mixing, near_dedup, substring_dedup, toxicity


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_words_and_shingles():
    texts = ["one two\tthree", "", None, " a ", "x", "\n\x0b", "é b c d e f"]
    data, offsets = common.utf8(pa.array(texts))
    row, start, end = common.words(data, offsets)
    got = [[] for _ in texts]
    for r, s, e in zip(row, start, end):
        got[r].append(bytes(data[s:e]).decode())
    assert got == [(t or "").split() for t in texts]
    owner, h = common.shingles(data, offsets)
    assert Counter(owner.tolist()) == {0: 1, 3: 1, 4: 1, 6: 2}
    assert len(set(h.tolist())) == 5


def test_bagminhash_is_unbiased():
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        base = prose(rng, 120).split()
        other = list(base)
        for _ in range(rng.randint(0, 12)):
            other[rng.randrange(len(other))] = "zz"
        texts += [" ".join(base + base[:30]), " ".join(other + other[:10])]
    data, offsets = common.utf8(pa.array(texts))
    sig = near_dedup.bagminhash(*near_dedup.multisets(data, offsets, 5), len(texts), 140)
    gaps = []
    for k in range(0, len(texts), 2):
        a, b = (Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts[k : k + 2])
        shared = sum((a & b).values())
        gaps.append((sig[k] == sig[k + 1]).mean() - shared / (sum(a.values()) + sum(b.values()) - shared))
    assert abs(np.mean(gaps)) < 0.02 and np.abs(gaps).max() < 0.2
    assert (near_dedup.bagminhash(*near_dedup.multisets(*common.utf8(pa.array([""])), 5), 1, 140) == 0).all()


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.default_path())


def test_bpe_agrees_with_the_library(codec):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(2)
    parts = list("aAbe'sS tT|é́İΣς​ 　日本ñ1234½ⅷ😀\t\n\x00\x85 don't") + ["<|endoftext|>", "<|startoftext|>", "'ll", "abcdefghij" * 8]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["", "ab" * 5000]
    for want, (n, raw, decoded) in zip(library.encode_batch(texts, add_special_tokens=False), codec.encode_batch(texts)):
        ids = array.array("I", raw).tolist()
        assert ids == want.ids and n == len(ids)
        assert decoded == library.decode(want.ids, skip_special_tokens=False) == codec.decode(ids)


def test_segment_tree_merges_leftmost_lowest(codec):
    ranks = {(0, 1): (1, 3), (1, 1): (0, 4), (3, 4): (2, 5)}
    assert bpe.merge([0, 1, 1, 1], ranks) == [0, 4, 1]
    assert bpe.merge([0, 1, 0, 1], ranks) == [3, 3]
    assert bpe.merge([7], ranks) == [7] and bpe.merge([], ranks) == []


def test_chunks_resist_shifts():
    rng = random.Random(4)
    hit = 0
    for _ in range(100):
        p = prose(rng, 60)
        data, offsets = common.utf8(pa.array([prose(rng, rng.randint(0, 50)) + " " + p + " " + prose(rng, 40), prose(rng, rng.randint(0, 50)) + " " + p]))
        row, _, h, _ = substring_dedup.windows(data, offsets)
        hit += bool(set(h[row == 0].tolist()) & set(h[row == 1].tolist()))
    assert hit >= 98
    data, offsets = common.utf8(pa.array([prose(rng, 500), prose(rng, 500), "", "a" * 5000]))
    row, start, end, _ = substring_dedup.chunked(data, offsets)
    for k in range(4):
        s, e = start[row == k], end[row == k]
        assert not len(s) and k == 2 or s[0] == offsets[k] and e[-1] == offsets[k + 1] and (s[1:] == e[:-1]).all() and (e - s).max() <= 256
    row, _, h, _ = substring_dedup.windows(data, offsets)
    assert not set(h[row == 0].tolist()) & set(h[row == 1].tolist())


def test_knapsack():
    rng = random.Random(5)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 6) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()) + 5)
        take = mixing.knapsack(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * lengths).sum())
        assert got <= budget and (budget - got < lengths.max() or (take == counts).all())
    lengths = np.array(sorted(rng.sample(range(40, 200), 20)))
    assert sum(b - int((mixing.knapsack(lengths, np.ones(20, np.int64), b) * lengths).sum()) for b in range(500, 1500, 50)) <= 20


def test_knapsack_against_exhaustive_search():
    rng = random.Random(15)
    for _ in range(300):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 6))))
        counts = np.array([rng.randint(1, 4) for _ in lengths])
        budget, sums = rng.randint(0, int((lengths * counts).sum())), {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        take = mixing.knapsack(lengths, counts, budget)
        assert int((take * lengths).sum()) == max(s for s in sums if s <= budget) and (take <= counts).all()
    lengths = np.arange(7, 3000, 7)
    counts = np.array([rng.randint(1, 90) for _ in lengths])
    for budget in (10_000_003, 20_000_002, int((lengths * counts).sum()) - 5):
        take = mixing.knapsack(lengths, counts, budget)
        assert int((take * lengths).sum()) == budget // 7 * 7 and (take >= 0).all() and (take <= counts).all()


def test_long_texts_are_learned_from_in_parts():
    rng = np.random.default_rng(2)
    tables = rng.normal(size=(5, 256, 12)).astype("f4")
    data, offsets = rng.integers(0, 255, 700_000).astype(np.uint8), np.array([0, 500, 500_500, 500_500, 700_000])
    for a, b in zip(byte_cnn.pooled(data, offsets, tables, True), byte_cnn.pooled_in_parts(data, offsets, tables)):
        assert np.allclose(a, b)


def test_targets():
    got = mixing.targets([("b", 100), ("a", 10), (None, 50), ("c", 0)])
    assert sum(got.values()) == pytest.approx(240) and got["a"] == 20 and got["c"] == 0
    assert all(v <= 2 * s for v, s in ((got["b"], 100), (got[None], 50)))
    assert mixing.targets([]) == {}


def test_range_search_against_brute_force():
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(40, 32))
    x = embedding_dedup.unit(np.concatenate([c + 0.04 * rng.normal(size=(rng.integers(1, 40), 32)) for c in centre] + [centre[0] + 0.01 * rng.normal(size=(300, 32))]))
    g = embedding_dedup.robust_graph(x)
    node, k = np.nonzero(g >= 0)
    i, j = embedding_dedup.range_search(x, embedding_dedup.both_ways(node, g[node, k], len(x)), 0.93)
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.93)) if a < b}
    got = set(zip(i.tolist(), j.tolist()))
    assert got <= want and len(got) >= 0.95 * len(want)


def test_long_texts_score_alike_in_parts():
    rng = np.random.default_rng(1)
    p = {"tables": rng.normal(size=(5, 256, 12)).astype("f4"), "w": rng.normal(size=24).astype("f4") * 0.1, "b": np.zeros(1, "f4")}
    for n in (0, 1, 511, 513, (1 << 18) + 5, 448 * 256 * 3 + 65):
        d = rng.integers(0, 255, n).astype(np.uint8)
        top, row, _ = byte_cnn.pooled(d, np.array([0, n]), p["tables"])
        want = 1 / (1 + np.exp(-(byte_cnn.summary(top, row, 1) @ p["w"])))
        assert np.allclose(byte_cnn.predict(p, d, np.array([0, n])), want, atol=1e-5)


def test_cnn_learns():
    rng = random.Random(6)
    good, bad = [prose(rng, 60) for _ in range(150)], ["### ".join(prose(rng, 60).split()) for _ in range(150)]
    texts, y = [t.encode() for t in good + bad], np.array([1] * 150 + [0] * 150)
    data, offsets = common.utf8(pa.array([t.decode() for t in texts]))
    assert ((byte_cnn.predict(byte_cnn.train(texts, y, epochs=4), data, offsets) >= 0.5) == y).mean() > 0.97


def test_nnpu_learns_from_positives_and_unlabelled():
    rng = random.Random(7)
    toxic = lambda: prose(rng, 40) + " " + rng.choice(["grr", "hiss", "boo"]) + " " + prose(rng, 20)
    pos, rest = [toxic() for _ in range(200)], [toxic() if k % 8 == 0 else prose(rng, 60) for k in range(1600)]
    row, f = toxicity.word_features(pa.array(pos + rest), 16)
    at = np.searchsorted(row, np.arange(len(pos + rest) + 1))
    feats = [f[at[i] : at[i + 1]] for i in range(len(pos + rest))]
    w, b = toxicity.train_nnpu(feats[:200], feats[200:], 0.125, bits=16)
    hit = np.array([w[x].sum() + b >= 0 for x in feats[200:]])
    truth = np.arange(1600) % 8 == 0
    assert hit[truth].mean() > 0.9 and hit[~truth].mean() < 0.05
