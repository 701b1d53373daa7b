"""What tasks of the pipeline hold at once."""

import random
import tracemalloc
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from pulsefleet.llm import nearcopy, packing, simhash
from pulsefleet.llm.bpe import worker_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def task(monkeypatch, module, make):
    """The function that ``make`` hands to mapInArrow."""
    rows = SimpleNamespace(mapInArrow=lambda f, _: f)
    rows.select = rows.filter = lambda *_: rows
    monkeypatch.setattr(module, "F", SimpleNamespace(col=lambda _: SimpleNamespace(cast=lambda _: SimpleNamespace(alias=lambda _: None), alias=lambda _: None)))
    return make(rows)


@pytest.mark.parametrize("module, make", [(nearcopy, lambda rows: nearcopy.sketches(rows, 5)), (nearcopy, lambda rows: nearcopy.shingle_sets(rows, 5)), (simhash, lambda rows: simhash.fingerprints(rows, 4))])
def test_a_task_does_not_hold_a_whole_batch_in_python(monkeypatch, module, make):
    rng = random.Random(3)
    texts = pa.array([f"{rng.random()} " + "word" * 2000 for _ in range(2000)])
    run = task(monkeypatch, module, make)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), texts], names=["doc_id", "text"])
    list(run(iter([batch.slice(0, 2)])))
    tracemalloc.start()
    n = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 and peak < batch.nbytes / 2


def test_near_copies_give_the_tokenizer_memory_back(monkeypatch):
    worker_bpe(PATH, True).ids("some words")
    assert worker_bpe.cache_info().currsize
    list(task(monkeypatch, nearcopy, lambda rows: nearcopy.sketches(rows, 5))(iter([])))
    assert not worker_bpe.cache_info().currsize


def test_the_pipeline_packs_with_a_small_cache(monkeypatch):
    asked = {}
    monkeypatch.setattr(corpus_pipeline, "pack_documents", lambda *_, **named: asked.update(named))
    corpus_pipeline.packing(None, None, "")
    assert asked["cache_rows"] == corpus_pipeline.CACHE_ROWS < packing.CACHE_ROWS
    bpe = worker_bpe(PATH, True, rows=8)
    for i in range(100):
        bpe.ids(f"word{i} other{i}")
    assert len(bpe.rest.young) + len(bpe.rest.old) <= 8
