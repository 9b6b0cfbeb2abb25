"""What a worker holds while a task runs and after it, with the functions that Spark would run in it."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from gatewarden.llm import bpe, byte_cnn, common, near_dedup
from tests.llm.test_numpy_parts import prose


class Docs:
    """Stands for a DataFrame: gives back what mapInArrow would run."""

    schema = None

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def batch(texts):
    n = np.arange(len(texts))
    return pa.RecordBatch.from_arrays([pa.array(n), pa.array(n), pa.array(texts)], names=["h1", "h2", "text"])


def test_a_task_holds_no_tables_of_other_operators():
    bpe.codec(bpe.default_path())
    common.prefix_hash(np.zeros(8, np.uint8))
    list(common.tidied(iter, "codecs")(iter([])))
    assert bpe._READY and not common._POWERS
    common.prefix_hash(np.zeros(8, np.uint8))
    signed = list(near_dedup._signed(Docs(), "text", 5)(iter([batch(["one two three four five six"])])))
    assert not bpe._READY and common._POWERS and sum(x.num_rows for x in signed) == near_dedup.BANDS
    assert bpe.codec(bpe.default_path()).encode("one") == bpe.Codec(bpe.default_path()).encode("one")


def test_signing_copies_no_whole_batch():
    rng = random.Random(5)
    one = batch([f"{k} {prose(rng, 400)}" for k in range(2000)])
    run, most, base = near_dedup._signed(Docs(), "text", 5), 0, pa.total_allocated_bytes()
    for _ in run(iter([one])):
        most = max(most, pa.total_allocated_bytes() - base)
    assert one.nbytes > 4 << 20 and most < one.nbytes / 2


def test_rows_that_pass_leave_in_small_batches():
    texts = [f"{k} " + "word " * 1000 for k in range(3000)]
    model = byte_cnn.train([b"good text"] * 3 + [b"### bad"] * 3, np.array([1, 1, 1, 0, 0, 0]), epochs=1)
    good = byte_cnn.predict(model, *common.utf8(pa.array(texts))) >= 0.5
    model["b"] += 0 if good.all() else 100
    got = list(byte_cnn.filter_rows(Docs(), model)(iter([batch(texts)])))
    assert [t for x in got for t in x.column(2).to_pylist()] == texts
    assert max(x.get_total_buffer_size() for x in got) < 6 << 20


def test_known_pieces_take_little_memory():
    rng = random.Random(6)
    codec = bpe.Codec(bpe.default_path())
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(20_000)]
    codec.encode_batch(words[:1])
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    codec.encode_batch(words)
    grown = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert len(codec.known) >= 20_000 and grown < 240 * len(codec.known)
