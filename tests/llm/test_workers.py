"""What a Python worker keeps from one stage to the next."""

from __future__ import annotations

import pyarrow as pa

from evalflow.llm import bpe, shared, shingle_join
from evalflow.llm.queries import vocabulary_path


class Taken:
    """A table whose mapInArrow gives the function that a worker would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_encoder_stays_for_its_own_tasks_only():
    kept = lambda: bpe.automaton.cache_info().currsize
    first = bpe.automaton(vocabulary_path())
    assert list(shared.returning(lambda batches: batches, bpe.automaton)(iter([1, 2]))) == [1, 2]
    assert kept() == 1 and bpe.automaton(vocabulary_path()) is first
    assert list(shared.returning(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert kept() == 0


def test_near_duplicates_free_the_encoder():
    bpe.automaton(vocabulary_path())
    run = shingle_join.signature_rows(Taken(), 2, 80)
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c d e f g h", None])], names=["text"])
    assert sum(len(x) for x in run(iter([batch])))
    assert not bpe.automaton.cache_info().currsize
