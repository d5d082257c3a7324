"""Counts and levels of op1 go over the network packed."""

import numpy as np

from lantern.llm import ngram_model


def test_numbers_come_back():
    for kind in (np.uint8, np.uint32, np.int64):
        for n in (0, 1, 5_000):
            values = np.random.default_rng(n).integers(0, np.iinfo(kind).max, n, kind, endpoint=True)
            assert (ngram_model.numbers(ngram_model.packed(values), kind) == values).all()


def test_small_counts_take_few_bytes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 4_000) % 5_000), i % 10 == 0) for i in range(10)]
    asked = ngram_model.asked_counts(ngram_model.in_blocks(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").coalesce(1)), 1, 2).first()
    # four bytes a count before
    assert len(asked["gram_counts"]) < len(asked["grams"]) / 5 and len(asked["word_counts"]) < len(asked["words"]) / 4
