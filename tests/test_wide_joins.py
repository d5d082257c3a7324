"""Hamming, cosine, city and polygon joins, and person upkeep, against brute force."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.operators import duplicates, places, vectors


def near_hashes():
    rng = np.random.default_rng(6)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 40)
    flips = [h ^ np.int64(sum(1 << int(b) if b < 63 else -(1 << 63) for b in rng.choice(64, k, replace=False))) for h in base[:12] for k in (1, 3, 6, 10, 18, 20)]
    return [int(h) for h in dict.fromkeys([*base.tolist(), *map(int, flips), 0, -1, 1])]


@pytest.mark.parametrize("threshold", [0, 3, 6, 10, 20])
def test_near_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(duplicates, "BLOCK", 30)
    hashes = near_hashes()
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    expected = sorted((a, b, apart(a, b)) for a in hashes for b in hashes if a < b and apart(a, b) <= threshold)
    df = spark.createDataFrame([(h,) for h in [*hashes, hashes[0], None]], "h long")
    assert sorted(map(tuple, duplicates.near_pairs(df, threshold).collect())) == expected
    counts = dict.fromkeys(hashes, 0)
    for a, b, _ in expected:
        counts[a] += 1
        counts[b] += 1
    assert dict(map(tuple, duplicates.near_counts(df, threshold).collect())) == counts
    files = spark.createDataFrame([(i, h) for i, h in enumerate([*hashes, hashes[3], None])], "file_id long, h long")
    group = {h: i for i, h in enumerate(hashes)}
    for _ in hashes:
        for a, b, _d in expected:
            group[a] = group[b] = min(group[a], group[b])
    alone = {h for h in hashes if not counts[h] and h != hashes[3]}
    got = dict(map(tuple, duplicates.near_groups(files, threshold).collect()))
    assert got == {i: group[h] for i, h in enumerate([*hashes, hashes[3]]) if h not in alone}


def test_near_joins_of_nothing(spark):
    none = spark.createDataFrame([], "h long")
    assert all(f(none, t).count() == 0 for f in (duplicates.near_pairs, duplicates.near_counts, duplicates.near_links) for t in (3, 20))


def test_blocks_of_hashes_are_dealt_out(spark, monkeypatch):
    # tasks are dealt by number: small rows that make long work had been put into one task
    monkeypatch.setattr(duplicates, "BLOCK", 10)
    known = spark.createDataFrame([(h,) for h in near_hashes()], "h long")
    count = lambda p, q, distance, near, same: ([int(near.size)],)
    sizes = [r["n"] for r in duplicates._blocked(known, 17, count, "n long").groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
    n = known.count()
    assert len(sizes) > 20 and max(sizes) < sum(sizes) / 8 and sum(sizes) >= n * (n + 1) // 2


@pytest.mark.parametrize("threshold", [7, 10])
def test_no_exploded_hashes_are_broadcast(spark, threshold):
    plan = duplicates.near_pairs(spark.range(100).selectExpr("id as h"), threshold)._jdf.queryExecution().executedPlan().toString()
    balls = plan.count("Generate")
    assert "Broadcast" not in plan if threshold < duplicates.WIDE else balls == 1  # from 8 on no row for each key of a ball


def test_block_forest_joins_what_is_near():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        p, q = rng.permutation(40)[: rng.integers(1, 14)], 50 + rng.permutation(40)[: rng.integers(1, 14)]
        same = seed % 3 == 0
        near = rng.random((len(p), len(p) if same else len(q))) < 0.1
        if same:
            near |= near.T | np.eye(len(p), dtype=bool)
            q = p
        group = {int(x): int(x) for x in np.concatenate((p, q))}

        def merge(pairs, group):
            group = dict(group)
            for a, b in pairs:
                old, new = group[int(a)], group[int(b)]
                group = {k: new if v == old else v for k, v in group.items()}
            return {frozenset(k for k in group if group[k] == v) for v in group.values()}

        a, b = duplicates._block_forest(p, q, near, near, same)
        i, j = np.nonzero(near)
        assert len(a) < len(group) and merge(zip(a, b), group) == merge(zip(p[i], q[j]), group)


def test_similar_centroids_by_blocks(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.2, (15, 6)) for c in rng.normal(0, 1, (6, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "k long, centroid array<double>")
    sim = x @ x.T
    for least in (0.2, 0.9, 1.0):
        expected = [(i * 3, j * 3) for i in range(len(x)) for j in range(i + 1, len(x)) if sim[i, j] >= least]
        for rows in (1024, 16):
            got = sorted(map(tuple, vectors.similar_centroids(df, "k", least, rows).collect()))
            assert [g[:2] for g in got] == expected and all(math.isclose(s, sim[a // 3, b // 3], abs_tol=1e-9) for a, b, s in got)
    assert vectors.similar_centroids(df.where("k = 999"), "k", 0.1).count() == 0


def test_assign_nearest_without_direction(spark):
    table = spark.createDataFrame([(5, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0]), (8, [0.0, 0.0]), (9, None)], "label int, centroid array<double>")
    v = spark.createDataFrame([(1, [0.0, 0.0], "z"), (2, None, "n"), (3, [0.0, 5.0], "t"), (4, [-1.0, -1.0], "far"), (5, [3.0, 0.1], "x")], "vec_id long, embedding array<float>, note string")
    for most in (128 << 20, 16):
        got = {r["vec_id"]: (r["nearest_label"], r["similarity"] and round(r["similarity"], 6), r["note"]) for r in vectors.assign_nearest(v, table, 0.5, "label", most_bytes=most).collect()}
        assert got == {1: (None, None, "z"), 2: (None, None, "n"), 3: (2, 1.0, "t"), 4: (None, None, "far"), 5: (5, round(3 / math.sqrt(9.01), 6), "x")}
    assert vectors.assign_nearest(v.where("false"), table, 0.5, "label").count() == 0
    assert {r["nearest_label"] for r in vectors.assign_nearest(v, table.where("false"), 0.5, "label").collect()} == {None}


def test_sums_follow_changes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "KEYS", 3)
    rng = np.random.default_rng(2)
    rows = [(i, int(k), rng.normal(0, 1, 4).tolist()) for i, k in enumerate(rng.integers(0, 9, 90))] + [(200, None, [1.0] * 4), (201, 3, None)]
    all_rows = spark.createDataFrame(rows, "vec_id long, person_id long, embedding array<double>").repartition(4)
    was, added, removed = all_rows.where("vec_id % 4 > 0 or person_id = 7"), all_rows.where("vec_id % 4 = 0 and (person_id <> 7 or person_id is null)"), all_rows.where("person_id = 5 and vec_id % 4 > 0")
    now = vectors.updated_sums(vectors.vector_sums(was, "person_id"), added, removed, "person_id")
    final = all_rows.where("not (coalesce(person_id, 0) = 5 and vec_id % 4 > 0)")
    got, full = ({r["person_id"]: (r["n"], [round(x, 9) for x in r["centroid"]]) for r in f.collect()} for f in (vectors.summed_centroids(now, "person_id"), vectors.centroids(final, "person_id")))
    assert got == full and len(full) > 5
    gone = vectors.updated_sums(vectors.vector_sums(was, "person_id"), all_rows.where("false"), was.where("person_id = 2"), "person_id")
    assert gone.where("person_id = 2").count() == 0


def test_relabelled_faces(spark):
    faces = spark.createDataFrame(
        [(1, 0, 10, "cluster"), (2, 0, 10, "cluster"), (3, 0, None, None), (4, 1, 11, "manual"), (5, 1, 12, "cluster"), (6, 1, None, None), (7, -1, 10, "incremental"), (8, -1, 10, "manual"), (9, None, 12, "cluster"), (10, 7, None, None), (11, 3, 12, "cluster"), (12, 3, None, "manual")],
        "face_id long, cluster long, person_id long, assign_src string",
    )
    persons = spark.createDataFrame([(10, "Ann"), (11, "Bob"), (12, None), (40, None)], "person_id long, name string")
    got = {r["face_id"]: (r["person_id"], r["assign_src"]) for r in vectors.relabelled_faces(faces, persons).collect()}
    # a third of cluster 1 is Bob's, not more: clusters 1, 3 and 7 are new persons behind the largest id
    assert got == {1: (10, "cluster"), 2: (10, "cluster"), 3: (10, "cluster"), 4: (11, "manual"), 5: (41, "cluster"), 6: (41, "cluster"), 7: (None, None), 8: (10, "manual"), 9: (None, None), 10: (43, "cluster"), 11: (42, "cluster"), 12: (42, "cluster")}
    assert vectors.relabelled_faces(faces.where("false"), persons.where("false")).count() == 0


def test_nearest_city_of_many(spark):
    rng = np.random.default_rng(11)
    spots = lambda n: (np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n))
    lat, lon = spots(1_500)
    lat[:300], lon[:300] = 48 + rng.normal(0, 0.2, 300), 11 + rng.normal(0, 0.2, 300)
    p_lat, p_lon = (np.concatenate(x) for x in zip(spots(400), ([90, -90, 0, 0, lat[7]], [0, 77, 180, -180, lon[7]])))
    cities = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))] + [(5_000, None, 1.0)], "city_id long, lat double, lon double")
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p_lat, p_lon))] + [(9_999, None, None)], "id long, lat double, lon double")
    rad = np.radians
    h = np.sin((rad(lat) - rad(p_lat)[:, None]) / 2) ** 2 + np.cos(rad(p_lat))[:, None] * np.cos(rad(lat)) * np.sin((rad(lon) - rad(p_lon)[:, None]) / 2) ** 2
    expected = dict(enumerate(np.round(h, 15).argmin(axis=1).tolist()))
    for most in (64 << 20, 12_000):
        got = {r["id"]: (r["city_id"], r["km"]) for r in places.nearest_city(points, cities, most).collect()}
        assert {k: v[0] for k, v in got.items()} == expected
        assert all(math.isclose(got[i][1], 2 * places.EARTH_KM * math.asin(math.sqrt(h[i].min())), abs_tol=1e-6) for i in expected)


def test_nearest_city_of_shared_places(spark):
    # 200 cities at each of 30 places, 50 points at each of 20, and an id that has two places
    rng = np.random.default_rng(3)
    city, spot = ([(float(a), float(b)) for a, b in zip(rng.uniform(-80, 80, n), rng.uniform(-180, 180, n))] for n in (30, 20))
    cities = spark.createDataFrame([(i, *city[i % 30]) for i in range(6_000)], "city_id long, lat double, lon double")
    points = spark.createDataFrame([(i, *spot[i % 20]) for i in range(1_000)] + [(7, *city[4])], "id long, lat double, lon double")
    km = lambda p, c: 2 * places.EARTH_KM * math.asin(math.sqrt(math.sin(math.radians(c[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(c[0])) * math.sin(math.radians(c[1] - p[1]) / 2) ** 2))
    expected = {i: min((round(km(spot[i % 20], c), 6), k) for k, c in enumerate(city))[1] for i in range(1_000)} | {7: 4}
    got = [tuple(r) for r in places.nearest_city(points, cities).select("id", "city_id").collect()]
    assert len(got) == 1_000 and dict(got) == expected


def test_far_branches_of_cities_are_not_looked_at():
    rng = np.random.default_rng(5)
    n = 40_000
    tree = places.BallTree(np.arange(n), np.stack((np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)), axis=1))
    seen, own = [], tree._low
    tree._low = lambda spots, nodes: seen.append(len(nodes)) or own(spots, nodes)
    tree.nearest(rng.uniform(-80, 80, 500), rng.uniform(-180, 180, 500))
    assert sum(seen) < 500 * 100  # a bound for each of 1,024 leaves before


def inside(x, y, rings):
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_polygons_against_even_odd(spark):
    rng = np.random.default_rng(13)
    shapes = []
    for k in range(12):
        turn, away = np.sort(rng.uniform(0, 2 * math.pi, 30)), rng.uniform(1, 25, 30)
        cx, cy = rng.uniform(-120, 120), rng.uniform(-50, 50)
        shapes.append((f"s{k}", [[(float(cx + a * math.cos(t)), float(cy + a * math.sin(t))) for t, a in zip(turn, away)], [(cx - 0.4, cy - 0.3), (cx + 0.5, cy - 0.3), (cx, cy + 0.7)]]))
    spots = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-80, 80, 600), rng.uniform(-150, 150, 600)))] + [(1_000, None, 3.0)]
    expected = {i: next((n for n, r in shapes if lat is not None and inside(lon, lat, r)), None) for i, lat, lon in spots}
    points = spark.createDataFrame(spots, "id long, lat double, lon double")
    assert len({*expected.values()}) > 6
    for cell in (1.0, 7.5):
        assert {r["id"]: r["name"] for r in places.points_in_polygons(points, shapes, cell).collect()} == expected


def test_topojson(spark, tmp_path):
    # two squares that share the arc 1, the second one backwards; a multipolygon; a hole
    top = {
        "type": "Topology", "transform": {"scale": [0.5, 0.25], "translate": [10, -5]},
        "arcs": [[[4, 0], [-4, 0], [0, 4], [4, 0]], [[4, 4], [0, -4]], [[4, 4], [4, 0], [0, -4], [-4, 0]], [[20, 20], [2, 0], [0, 2], [-2, -2]], [[1, 1], [1, 0], [0, 1], [-1, -1]]],
        "objects": {"land": {"type": "GeometryCollection", "geometries": [
            {"type": "Polygon", "properties": {"name": "West", "n": 1}, "arcs": [[0, 1], [4]]}, {"type": "Point", "coordinates": [1, 1]},
            {"type": "MultiPolygon", "properties": {"name": "East"}, "arcs": [[[2, -2]], [[3]]]}]}},
    }
    (tmp_path / "top.json").write_text(json.dumps(top))
    got = {r["name"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in places.topojson_polygons(spark, str(tmp_path / "top.json"), "land").collect()}
    spot = lambda *ps: [(10 + x * 0.5, -5 + y * 0.25) for x, y in ps]
    assert got == {"West": [spot((4, 0), (0, 0), (0, 4), (4, 4), (4, 0)), spot((1, 1), (2, 1), (2, 2), (1, 1))], "East": [spot((4, 4), (8, 4), (8, 0), (4, 0), (4, 4)), spot((20, 20), (22, 20), (22, 22), (20, 20))]}
    points = spark.createDataFrame([(1, *reversed(spot((3, 3))[0])), (2, *reversed(spot((6, 2))[0])), (3, *reversed(spot((1.75, 1.5))[0])), (4, *reversed(spot((21.5, 21))[0])), (5, 0.0, 0.0)], "id long, lat double, lon double")
    names = places.points_in_polygons(points, places.topojson_polygons(spark, str(tmp_path / "top.json"), "land"), 0.25)
    assert sorted(map(tuple, names.select("id", "name").collect())) == [(1, "West"), (2, "East"), (3, None), (4, "East"), (5, None)]
    (tmp_path / "plain.json").write_text(json.dumps({"arcs": [[[0, 0], [2, 0], [2, 2], [0, 0]]], "objects": {"o": {"geometries": [{"type": "Polygon", "properties": {}, "arcs": [[0]]}]}}}))
    one = places.topojson_polygons(spark, str(tmp_path / "plain.json"), "o").first()
    assert one["name"] is None and [(p["x"], p["y"]) for p in one["rings"][0]] == [(0, 0), (2, 0), (2, 2), (0, 0)]
