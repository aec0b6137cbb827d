"""What workers and disks hold."""

import re
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa

from quarry.llm import decontam, jaccard_join, scratch, token_store


def test_decontamination_holds_little_of_a_batch():
    texts = [" ".join(f"w{(i * 31 + k) % 5000}" for k in range(1000)) for i in range(1200)]
    n = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([n, n, n, pa.array(texts)], ["doc_id", "h1", "h2", "text"])
    shared = SimpleNamespace(value=decontam.Items([1], ["none of these words stands there"]))
    tracemalloc.start()
    assert not list(decontam._probe(shared)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak MB", peak / 1e6, "of", batch.nbytes / 1e6)
    assert peak < 100e6


def test_shuffle_files_go_with_their_query(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with scratch.freed_at_once(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before


def _held_mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_shingles_take_little_besides_their_result():
    texts = [" ".join(f"w{(i * 31 + k) % 50000}" for k in range(1000)) for i in range(1200)]
    buf, off = jaccard_join.W.buffers(pa.array(texts))
    tracemalloc.start()
    text, h = jaccard_join.shingles(buf, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak MB", peak / 1e6, "of", buf.nbytes / 1e6)
    assert len(h) == 1200 * 996
    assert np.array_equal(text, np.repeat(np.arange(1200), 996))
    assert peak < 60e6


def test_an_encoder_goes_when_another_task_begins():
    token_store.encoder_for(public_tokenizers.path("byte_bpe_50k.json"))
    same = lambda batches: batches
    assert list(scratch.lean(same, "encoders")(iter([]))) == [] and token_store._encoders
    assert list(scratch.lean(same)(iter([]))) == [] and not token_store._encoders


def test_a_batch_is_returned_before_the_next_is_read():
    """One that is read goes before the next one comes, and what it took is given back."""

    def batches():
        for _ in range(3):
            texts = pa.array([b"x" * 100] * 400_000)
            yield pa.RecordBatch.from_arrays([texts], ["text"])
            del texts
            held.append(_held_mb())

    def run(given):
        for batch in given:
            own = [bytes(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(own)])], ["n"])
            del batch, own

    held, before = [], _held_mb()
    assert [b.column(0)[0].as_py() for b in scratch.lean(run)(batches())] == [400_000] * 3
    print("MB held before and after each batch", before, held)
    assert _held_mb() < before + 20
