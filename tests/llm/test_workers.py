"""What workers of the operators hold."""

import pyarrow as pa

from strata.llm import word_bpe
from strata.llm.common import workers_import


def test_texts_go_to_workers_in_small_batches(spark):
    """10,000 texts at once are tens of MB on both sides of the pipe."""
    workers_import(spark)
    sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([len(b)])], ["id"]) for b in bs), "id long")
    assert max(r.id for r in sizes.collect()) <= 1000


def test_a_word_is_remembered_once():
    coder = word_bpe.Encoder.__new__(word_bpe.Encoder)
    coder.words = word_bpe._Known(lambda w: w.encode())
    coder._word = lambda w: w.encode()
    assert coder._piece("word") == b"word" and not coder.words
    assert coder._piece("a,b") == b"a,b" and set(coder.words) == {"a", ",", "b"}
