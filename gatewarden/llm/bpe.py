"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

The symbols of a word are the leaves of a linked list; leaf i of the tree holds the rank of the pair that starts at symbol i. The root
yields the leftmost pair of lowest rank; merging it updates three leaves, each in logarithmic time, until no pair can be merged. Many words are
merged side by side, a tree in each row of an array. A word's ids are kept in a bounded table, so that common words are merged once for each worker.

Normalising and splitting into words are the tokenizers library's own steps, read from the tokenizer's file; the merges are done here. A null text counts as
empty, with no ids. Repeated rows are encoded each; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import ChainMap
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held, table, tidied

_READY: dict[str, Codec] = held("codecs", {})
NEVER = 1 << 60
#: Letters beyond ASCII, and marks, that no normal form changes, that have one small form, and that are no blanks.
LETTERS, MARKS = "À-ÖØ-öø-ÿ", "¡¿«»–—‘’“”„…"
#: A character that is none of these, nor an ASCII blank or a visible ASCII character: words with one are split by the library.
ODD = re.compile(f"[^\\t-\\r\\x20-\\x7e{LETTERS}{MARKS}]")
#: All that some library takes for blank, but the ASCII blank itself.
BLANK = re.compile(r"[^\S ]|[\x1c-\x1f\x85\u180e]")


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """symbols after all merges; ranks: pair -> (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << (n - 1).bit_length()
    tree = [NEVER] * (2 * width)  # rank << 32 | place: the least is the leftmost pair of lowest rank
    get = ranks.get
    for i in range(n - 1):
        if (r := get((symbols[i], symbols[i + 1]))) is not None:
            tree[width + i] = r[0] << 32 | i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while (top := tree[1]) != NEVER:
        i = top & 0xFFFFFFFF
        j = after[i]
        symbols[i] = get((symbols[i], symbols[j]))[1]
        symbols[j] = -1
        k = after[i] = after[j]
        put(j, NEVER)
        r = get((symbols[i], symbols[k])) if k < n else None
        put(i, r[0] << 32 | i if r is not None else NEVER)
        if k < n:
            before[k] = i
        h = before[i]
        if h >= 0:
            r = get((symbols[h], symbols[i]))
            put(h, r[0] << 32 | h if r is not None else NEVER)
    return [s for s in symbols if s >= 0]


def _blank(part: str) -> str:
    for c in "\t\n\r\x0b\x0c":
        part = part.replace(c, " ")
    return part


def _plain_rule(spec: dict):
    """The tokenizer's own split as a function for lower-case words without odd characters, or None if its file has other steps than these."""
    steps = spec["normalizer"].get("normalizers", [spec["normalizer"]])
    known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    split = spec["pre_tokenizer"].get("pretokenizers", [])
    if [s for s in steps if s not in known] or known[2] not in steps or [s["type"] for s in split] != ["Split", "ByteLevel"]:
        return None
    first, last = split
    rule = first["pattern"].get("Regex", "")
    if first["behavior"] != "Removed" or not first["invert"] or last["add_prefix_space"] or last["use_regex"]:
        return None
    rule = rule.replace("\\p{L}", "a-zß-öø-ÿ").replace("\\p{N}", "0-9").replace("[^\\s", "[^\\t-\\r ")
    return None if "\\p" in rule or "\\s" in rule or "(" in rule else re.compile(rule).findall


class Codec:
    """A BPE with a word-end suffix, from a file of the tokenizers library (path is a parameter; the file is never copied)."""

    def __init__(self, path: str, keep: int = 1 << 18):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("only a plain BPE without decoder can be read")
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.plain_pieces = _plain_rule(spec)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.unknown = self.vocab.get(model.get("unk_token"))
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain")
        self.added = added
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow after 255
        self.byte = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in visible)}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.token = {i: t for t, i in (self.vocab | added).items()}
        self.keep, self.known = keep, {}
        order = sorted(self.ranks)
        self.pair = np.array([a << 20 | b for a, b in order], np.int64)
        self.rank, self.made = (np.array([self.ranks[p][k] for p in order], np.int64) for k in (0, 1))
        table = [[self.vocab.get(chr(c) + tail, -1 if self.unknown is None else self.unknown) for c in range(400)] for tail in ("", self.suffix)]
        self.plain, self.final = (np.array(t, np.int64) for t in table)

    def pieces(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The pieces of words and, for each piece, the place of its word. Words hold no ASCII blanks, so one call can split them all."""
        odd = [k for k, w in enumerate(words) if BLANK.search(w)] if BLANK.search("".join(words)) else []
        if odd:  # blanks inside a word would run into those between words
            plain = sorted(set(range(len(words))) - set(odd))
            found, owner = self.pieces([words[k] for k in plain]) if plain else ([], np.zeros(0, np.int64))
            own = [[p for p, _ in self.split(self.normalise(words[k]))] for k in odd]
            at = np.concatenate([np.array(plain, np.int64)[owner], np.repeat(odd, [len(x) for x in own])]).astype(np.int64)
            order = np.argsort(at, kind="stable")
            every = found + [p for x in own for p in x]
            return [every[k] for k in order], at[order]
        joined = self.normalise(" ".join(words))
        parts = joined.split(" ")
        if len(parts) != len(words):
            raise ValueError("a word was split by the normaliser")
        found = self.split(joined)
        start = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        at = np.array([o[0] for _, o in found], np.int64)
        return [p for p, _ in found], np.searchsorted(start, at, "right") - 1

    def learn(self, keys: list[str]) -> dict[str, bytes]:
        """entries() of words; each key is a newline and a word."""
        pieces, owner = self.pieces([k[1:] for k in keys])
        ids, n = self.merge_all(pieces)
        return self.entries(keys, ids, np.bincount(owner, n, len(keys)).astype(np.int64))

    def merge_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has. Pieces of like length are merged together, tree by tree in one array."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        code = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.int64)
        stop = np.cumsum(size)
        symbols = self.plain[np.minimum(code, len(self.plain) - 1)]
        symbols[stop - 1] = self.final[np.minimum(code[stop - 1], len(self.final) - 1)]
        if (symbols < 0).any():
            raise ValueError("a byte is missing from the vocabulary")
        alive = np.ones(len(symbols), bool)
        width = 2
        while (group := np.flatnonzero((size > (width // 2 if width > 2 else 1)) & (size <= width))).size or width < 64:
            if group.size:
                self.merge_group(symbols, alive, stop[group] - size[group], size[group], width)
            width *= 2
        for k in np.flatnonzero(size > width // 2):
            a, b = stop[k] - size[k], stop[k]
            out = merge(symbols[a:b].tolist(), self.ranks)
            symbols[a : a + len(out)] = out
            alive[a + len(out) : b] = False
        sums = np.concatenate([[0], np.cumsum(alive)])
        return symbols[alive], sums[stop] - sums[stop - size]

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER where there is none) and merged symbol of pairs."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], NEVER), self.made[at]

    def merge_group(self, symbols: np.ndarray, alive: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> None:
        """merge() for many pieces at once: row k of the arrays is the tree and the linked list of piece k."""
        place = np.arange(width)
        inside = place < size[:, None]
        s = np.where(inside, symbols[np.minimum(start[:, None] + place, len(symbols) - 1)], -1)
        tree = np.full((len(start), 2 * width), NEVER, np.int64)
        r, _ = self.look(s[:, :-1], s[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(r == NEVER, NEVER, r << 32 | place[:-1])
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        after = np.where(place + 1 < size[:, None], place + 1, width) + np.zeros_like(s)
        before = place - 1 + np.zeros_like(s)
        row = np.flatnonzero(tree[:, 1] != NEVER)

        def put(row: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            node = width + i
            tree[row, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        def ranked(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """What leaf i holds when j comes after it (width: nothing does)."""
            r, _ = self.look(s[row, i], np.where(j < width, s[row, np.minimum(j, width - 1)], -1))
            return np.where(r == NEVER, NEVER, r << 32 | i)

        while len(row):
            i = tree[row, 1] & 0xFFFFFFFF
            j = after[row, i]
            s[row, i] = self.look(s[row, i], s[row, j])[1]
            s[row, j] = -1
            k = after[row, j]
            after[row, i] = k
            put(row, j, np.full(len(row), NEVER))
            put(row, i, ranked(row, i, k))
            more = k < width
            before[row[more], k[more]] = i[more]
            h = before[row, i]
            some = h >= 0
            if some.any():
                put(row[some], h[some], ranked(row[some], h[some], i[some]))
            row = row[tree[row, 1] != NEVER]
        symbols[(start[:, None] + place)[inside]] = s[inside]
        alive[(start[:, None] + place)[inside]] = s[inside] >= 0

    def keys(self, part: str, out: list[str]) -> None:
        """Appends what part is made of: pieces of plain words, and words with odd characters, which start with a newline here."""
        odd = ODD.search(part)
        if self.plain_pieces is None:
            out += ["\n" + w for w in _blank(part).split(" ") if w]
            return
        if odd is None:
            out += self.plain_pieces(part.lower())
            return
        part, at = _blank(part), 0
        while odd is not None:
            start = part.rfind(" ", at, odd.start()) + 1 or at
            end = part.find(" ", odd.start())
            end = len(part) if end < 0 else end
            if start > at:
                out += self.plain_pieces(part[at:start].lower())
            out.append("\n" + part[start:end])
            at = end
            odd = ODD.search(part, at)
        out += self.plain_pieces(part[at:].lower())

    def encode_batch(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """Number of ids, ids as little-endian 32-bit numbers and decoded text of whole texts.

        No step of the tokenizer looks across an ASCII blank, so a piece of a plain word, and a whole word with odd characters, is encoded once and kept. The
        table of what is kept loses what was learned first, and isn't in use, when it is full; pieces of over 64 characters aren't kept.
        """
        rows: list[list[str]] = []
        for text in texts:
            row: list[str] = []
            for k, part in enumerate(self.cut.split(text)) if self.cut else ((0, text),):
                if k % 2:
                    row.append("\t" + part)  # an added token
                elif part:
                    self.keys(part, row)
            rows.append(row)
        wanted = set().union(*rows)
        fresh = wanted - self.known.keys()
        if len(self.known) + len(fresh) > self.keep:
            stay = self.known.keys() & wanted
            late = islice(self.known.items(), max(0, len(self.known) - self.keep // 2), None)  # what was learned last
            self.known = {w: e for w, e in late} | {w: self.known[w] for w in stay}
        found = {}
        plain, odd = [], []
        for key in fresh:
            if key[0] == "\t":
                found[key] = array("I", [self.added[key[1:]]]).tobytes()
            else:
                (odd if key[0] == "\n" else plain).append(key)
        for at in range(0, len(plain), 50_000):
            some = plain[at : at + 50_000]
            ids, n = self.merge_all([w if w.isascii() else w.encode().decode("latin-1").translate(self.byte) for w in some])
            found |= self.entries(some, ids, n)
        for at in range(0, len(odd), 20_000):
            found |= self.learn(odd[at : at + 20_000])
        long = {w: found.pop(w) for w in [w for w in found if len(w) > 64]}
        self.known |= found
        known = ChainMap(self.known, long) if long else self.known
        out = []
        for row in rows:
            if not row:
                out.append((0, b"", ""))
                continue
            raw = b"".join([known[w] for w in row])
            out.append((len(raw) // 4, raw, " ".join(map(self.token.__getitem__, np.frombuffer(raw, "<u4").tolist()))))
        return out

    def entries(self, keys: list[str], ids: np.ndarray, count: np.ndarray) -> dict[str, bytes]:
        """For each key the ids as little-endian 32-bit numbers; ids: those of all keys in a row."""
        end = np.cumsum(count).tolist()
        raw, start = ids.astype("<u4").tobytes(), [0, *end[:-1]]
        return {w: raw[4 * a : 4 * b] for w, a, b in zip(keys, start, end, strict=True)}

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return array("I", self.encode_batch([text])[0][1]).tolist()

    def decode(self, ids) -> str:
        """Tokens, special ones too, joined by blanks: what the library does for a file without a decoder."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])


def codec(path: str) -> Codec:
    """The worker's codec for path; it is read once."""
    if path not in _READY:
        _READY[path] = Codec(path)
    return _READY[path]


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", ids: bool = True, decoded: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) and, if asked for, the ids and the decoded text. One pass, no shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = own.encode_batch([t or "" for t in part.column(1).to_pylist()])
                out = {
                    key: part.column(0),
                    "n_tokens": pa.array([r[0] for r in rows], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string()),
                }
                if ids:
                    out["ids"] = pa.array([np.frombuffer(r[1], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32()))
                if decoded:
                    out["decoded"] = pa.array([r[2] for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return docs.select(key, text).mapInArrow(tidied(run, "codecs"), schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3(spark, sf_dir: str) -> DataFrame:
    """Number and digests of ids and decoded text for each row of documents."""
    return encode(table(spark, sf_dir, "documents"), default_path(), ids=False, decoded=False)
