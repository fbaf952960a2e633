"""The stored token table of the training order: copies that lie megabytes apart are compressed together."""

import pathlib
import random

from lendframe.llm import training_order as to


def _stored_bytes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    table = to._token_table(docs, "doc_id", "text", to.LENGTH, to.RANKS)
    assert table.count() == len(texts)
    return sum(pathlib.Path(f.removeprefix("file:")).stat().st_size for f in table.inputFiles())


def test_pages_of_the_token_table_reach_over_megabytes(spark):
    r = random.Random(3)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=8000)) for _ in range(200)]
    assert _stored_bytes(spark, texts * 2) < 1.3 * _stored_bytes(spark, texts)
