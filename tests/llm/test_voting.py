"""Nearest-neighbour votes against plain cosines, held-out accuracy, and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.llm import queries, voting


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.QUERIES["op11_neighbour_votes"](spark, sf_dir).cache()
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert got.where(F.expr("held_out <> (crc32(cast(doc_id as string)) % 4 = 2)")).count() == 0
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    low = held[held.quality == 0]
    assert (held.predicted == held.quality).mean() > 0.95 and (low.predicted == 0).mean() > 0.8
    assert (held[held.quality == 1].predicted == 1).mean() > 0.97
    # labels of the held-out fold teach nothing
    turned = labels.withColumn("quality", F.when(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(voting.score_by_neighbours(docs, turned).collect()) == sorted(got.collect())


def test_votes_are_exact_cosines():
    draw = np.random.default_rng(3)
    z, p = (voting.latent(draw.standard_normal((n, 40)).astype(np.float32), np.eye(40, 64, dtype=np.float32)) for n in (30, 200))
    labels = (draw.random(200) < 0.7).astype(np.float32)
    got = voting.votes(z, p.astype(np.int16), labels, 5)
    for i in range(30):
        exact = [(sum(int(a) * int(b) for a, b in zip(z[i], q)) / sum(int(b) ** 2 for b in q) ** 0.5, y) for q, y in zip(p, labels)]
        best = sorted(exact, reverse=True)[:5]
        assert got[i] == pytest.approx(sum(max(s, 0) * y for s, y in best) / sum(max(s, 0) for s, _ in best), abs=1e-5)
    assert (voting.votes(z, p.astype(np.int16)[::-1], labels[::-1], 5) == pytest.approx(got)) and (voting.votes(z[:7], p.astype(np.int16), labels, 5) == got[:7]).all()


def test_counts_of_long_texts_are_whole(monkeypatch):
    text = ("Some words, 12 of THEM é " * 400).encode()
    whole = voting.gram_counts(text)
    monkeypatch.setattr(voting, "SEGMENT", 101)
    assert (voting.gram_counts(text) == whole).all() and whole[: voting.BYTE_BUCKETS].sum() == len(text) - 3 and whole[voting.BYTE_BUCKETS :].sum() == len(text) - 2


def test_edges(spark):
    rows = [(1, "plain words of a text", 1, 0.5), (1, "other words of that id", 1, 0.1), (3, None, None, None), (4, "", 2, 0.2), (None, "no id at all", 3, 0.3), (4, "", 2, 0.2), (9, "### %%% $$$ ### %%%", 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 0), (None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    got = voting.score_by_neighbours(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    empty = {r.score for r in got if r.doc_id in (3, 4)}
    assert len(empty) == 1 and [r.held_out for r in got if r.doc_id is None] == [False]
    none = labels.where("false")
    assert {r.score for r in voting.score_by_neighbours(docs, none).collect()} == {0.5}
    assert voting.score_by_neighbours(docs.where("false"), labels).count() == 0
    assert voting.labelled_sample(spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int"), 20).count() == 20
