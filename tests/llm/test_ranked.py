"""Ranked search against its SQL and plain Python, over several blocks, and edges."""

import math
import re
from collections import Counter, defaultdict

import duckdb

from lantern.llm import queries, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c in held:
            m = 10 + (90 * c.total() * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1) if s]
    return sorted(out, key=str)


def test_query_equals_sql(spark, sf_dir):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    expected = sorted(duck.sql(queries.ORACLE_SQL["op12_ranked_search"]).fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["op12_ranked_search"](spark, sf_dir).collect()) == expected
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert sorted(tuple(r) for r in ranked.search(docs.repartition(7), items, block_terms=200).collect()) == expected


def test_edges(spark, monkeypatch):
    rows = [(5, "alpha beta", 1), (4, "Alpha BETA", 2), (3, None, 3), (2, "", 4), (None, "alpha beta", 5), (5, "alpha beta", 1), (1, "gamma É é 7x7", 9), (8, "alpha " * 5_000 + "delta", 0), (9, "-- .. --", 0)] + [(100 + i, "omega alpha", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    asked = [(1, "beta, Alpha; beta"), (2, None), (3, ""), (4, "nowhere"), (None, "gamma é"), (1, "delta"), (7, "OMEGA"), (8, "É7x7 7x7")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    expected = brute([(r[0], r[1]) for r in rows], asked)
    for segment in (ranked.SEGMENT, 50):
        monkeypatch.setattr(ranked, "SEGMENT", segment)
        assert ranked.term_counts(rows[7][1].encode()) == {b"alpha": 5_000, b"delta": 1}
    for more in ({}, {"block_terms": 2}):
        got = sorted((tuple(r) for r in ranked.search(docs.repartition(5), items, **more).collect()), key=str)
        assert got == expected
    assert ranked.search(docs.where("false"), items).count() == 0 and ranked.search(docs, items.where("false")).count() == 0
    three = ranked.search(docs, items, k=3).where("item_id = 7").orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in three] == [(1, 100), (2, 101), (3, 102)]


def test_pruned_terms_stay_below_the_threshold():
    import numpy as np

    draw = np.random.default_rng(5)
    impacts = draw.integers(0, 50, (12, 400)) * (draw.random((12, 400)) < 0.3) * np.array([1, 1, 1, 2, 2, 3, 5, 8, 20, 30, 50, 90])[:, None]
    most, kth = impacts.max(axis=1), np.sort(impacts, axis=1)[:, -10]
    item = ranked.Item(np.arange(12), most, int(kth.max()), 10)
    assert item.cut > 0
    for at in range(0, 400, 64):
        item.meet(impacts[:, at : at + 64], np.arange(at, min(at + 64, 400)), np.zeros(min(64, 400 - at), bool))
    order = np.lexsort((np.arange(400), -impacts.sum(axis=0)))[:10]
    assert item.ids.tolist() == order.tolist() and item.scores.tolist() == impacts.sum(axis=0)[order].tolist()
