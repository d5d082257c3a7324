"""The catalog in key ranges: touched ranges only, replays, other checkpoints, old versions, and a racing writer."""

import pytest

from lantern.streaming import ranges, rescan


def folders(state):
    return {r: v for r, (v, *_) in state["ranges"].items()}


def test_ten_rows_rewrite_their_ranges(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    rows = lambda f, ks: spark.createDataFrame([(k, f(k), 1) for k in ks], "k long, v string, t long")
    assert ranges.read_ranges(spark, path) is None and ranges.pointer(spark, path) == {}
    first = ranges.change_ranges(rows(lambda k: f"a{k}", range(500)), path, ["k"], "t", ranges=16)
    assert set(folders(first).values()) == {0} and len(first["ranges"]) == 16
    second = ranges.change_ranges(rows(lambda k: f"b{k}", [7]).selectExpr("k", "v", "t + 1 AS t"), path, ["k"], "t", ranges=99)
    assert sorted(folders(second).values()) == [0] * 15 + [1] and second["count"] == 16
    got = {r["k"]: r["v"] for r in ranges.read_ranges(spark, path).collect()}
    assert got == {k: "b7" if k == 7 else f"a{k}" for k in range(500)}
    assert ranges.fingerprint_of(first) != ranges.fingerprint_of(second)
    empty = ranges.change_ranges(rows(str, []), path, ["k"], "t")
    assert ranges.fingerprint_of(empty) == ranges.fingerprint_of(second) and ranges.read_ranges(spark, path).count() == 500
    # what the last two states don't name is gone
    for i in range(3):
        state = ranges.change_ranges(rows(lambda k: f"c{i}", range(500)), path, ["k"], "t", versions=2)
    assert sorted(p.name for p in (tmp_path / "c/data").iterdir()) == ["version=000000000004", "version=000000000005"] and len(list((tmp_path / "c/state").glob("0*.json"))) == 2
    with pytest.raises(RuntimeError):
        ranges._set(spark, path, state)


def test_new_checkpoints_go_on_and_replays_count_once(spark, tmp_path):
    path, schema = f"file://{tmp_path}/catalog", "k long, v long"
    calls = []
    for n, batch in enumerate(([(1, 1), (2, 1)], [(2, 5), (3, 1)], [(3, 1)])):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
        stream = rescan.listing_stream(spark, f"{tmp_path}/in{n}", schema)
        rescan.keep_catalog(stream, path, ["k"], "v", f"{tmp_path}/check{n}", lambda df: calls.append(df.count()), ranges=4).awaitTermination()
    assert sorted(map(tuple, ranges.read_ranges(spark, path).collect())) == [(1, 1), (2, 5), (3, 1)] and calls == [2, 3]
    state = ranges.pointer(spark, path)
    again = ranges.change_ranges(spark.createDataFrame([(9, 9)], schema), path, ["k"], "v", source=[f"{tmp_path}/check2", 0])
    assert again == state and ranges.read_ranges(spark, path).count() == 3
