"""Distributed density clusters and the prefix scan against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.operators import clusters, ordered


def brute(x, ids, least):
    """HDBSCAN with a full distance matrix: Kruskal over all pairs by (reach, smaller id, larger id), condensed tree, excess of mass."""
    order = np.argsort(ids)
    x, ids = x[order], np.asarray(ids)[order]
    n = len(x)
    if n < 2 * least:
        return dict.fromkeys(ids.tolist(), -1)
    d = clusters.distances(x, x)
    core = np.partition(d, least - 1, axis=1)[:, least - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    a, b = np.triu_indices(n, 1)
    w = reach[a, b]
    up, members, kids, height, made = list(range(2 * n - 1)), {i: [i] for i in range(n)}, {}, {}, n

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for e in np.lexsort((b, a, w)).tolist():
        p, q = find(int(a[e])), find(int(b[e]))
        if p != q:
            up[p] = up[q] = made
            members[made], kids[made], height[made] = members[p] + members[q], (p, q), float(w[e])
            made += 1
    level = lambda k: 1 / max(height[k], 1e-12)

    def explore(node, birth, root):
        """(mass of the best choice, its clusters) for the cluster that begins at node."""
        mass = 0.0
        while True:
            big = [k for k in kids[node] if len(members[k]) >= least]
            if len(big) == 1:
                mass += (level(node) - birth) * (len(members[node]) - len(members[big[0]]))
                node = big[0]
                continue
            mass += (level(node) - birth) * len(members[node])
            break
        if not big:
            return mass, [] if root else [first[0]]
        parts = []
        for k in big:
            first.insert(0, k)
            parts.append(explore(k, level(node), False))
            first.pop(0)
        inner = sum(p[0] for p in parts)
        if root or inner > mass:
            return inner, [c for p in parts for c in p[1]]
        return mass, [first[0]]

    first = [made - 1]
    chosen = explore(made - 1, 0.0, True)[1]
    out = dict.fromkeys(ids.tolist(), -1)
    for number, c in enumerate(sorted(chosen, key=lambda c: min(members[c]))):
        out.update((int(ids[i]), number) for i in members[c])
    return out


def planted(seed, n, width=6):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(rng.uniform(-4, 4, width), rng.uniform(0.02, 0.5), (rng.integers(6, n // 4), width)) for _ in range(7)]
    return np.concatenate([*parts, rng.uniform(-6, 6, (n // 6, width)), np.repeat(parts[0][:2], 5, axis=0)])


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize(("rows", "most"), [(1024, 1_000_000), (60, 40)])
def test_hdbscan_equals_brute_force(spark, rows, most):
    x = planted(2, 120)
    ids = np.random.default_rng(9).permutation(len(x)) * 7 - 300
    expected = brute(x, ids, 4)
    assert len(set(expected.values())) > 4 and -1 in expected.values()
    got = dict(map(tuple, clusters.hdbscan(frame(spark, x, ids), rows=rows, most=most).collect()))
    assert got == expected


def test_hdbscan_of_two_thousand(spark):
    x = planted(5, 1_500, 16)[:2_000]
    assert dict(map(tuple, clusters.hdbscan(frame(spark, x, range(len(x))), rows=512).collect())) == brute(x, range(len(x)), 4)


def test_hdbscan_edges(spark):
    few = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, clusters.hdbscan(few).collect())) == [(1, -1), (2, -1), (3, -1)]
    assert clusters.hdbscan(few.where("false")).count() == 0
    same = np.concatenate((np.zeros((9, 2)), np.ones((8, 2)), [[50.0, 50.0]]))
    got = dict(map(tuple, clusters.hdbscan(frame(spark, same, range(18)).unionByName(few.where("vec_id = 2").withColumn("vec_id", F.lit(99).cast("long")))).collect()))
    assert got == brute(same, range(18), 4) | {99: -1}


def test_scan_carries_over_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(None if g == 0 else "hot" if g < 7 else "few", int(t), i, None if i % 5 else float(i)) for i, (g, t) in enumerate(zip(rng.integers(0, 9, 500), rng.integers(0, 60, 500)))]
    df = spark.createDataFrame(rows, "g string, t long, i long, v double").repartition(6)
    got = ordered.scanned(df, ["g"], [F.col("t"), F.col("i")], sums={"total": F.col("i")}, latest={"seen": F.col("v")}, before={"prev": F.col("i")}, behind={"next": F.col("i")}).collect()
    assert len(got) == 500
    for g in (None, "hot", "few"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3])
        ours = {r["i"]: r for r in got if r["g"] == g}
        total, seen = 0, None
        for k, (_, _, i, v) in enumerate(mine):
            total, seen = total + i, v if v is not None else seen
            r = ours[i]
            assert (r["pos"], r["size"], r["total"], r["seen"]) == (k, len(mine), total, seen)
            assert r["prev"] == (mine[k - 1][2] if k else None) and r["next"] == (mine[k + 1][2] if k + 1 < len(mine) else None)
    assert ordered.scanned(df.where("false"), [], [F.col("t")], sums={"total": F.col("i")}).count() == 0


def test_query_over_all_embeddings(spark, sf_dir):
    from lantern.plans.catalogue import QUERIES

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got = dict(map(tuple, QUERIES["density_clusters"](spark, sf_dir).collect()))
    assert got == brute(np.array([r["embedding"] for r in rows], float), [r["vec_id"] for r in rows], 4)


def test_trees_of_pairs_of_blocks_are_dealt_out(spark):
    # tasks are dealt by number: 20 blocks of few bytes and much work had been put into one task
    x = planted(3, 200)
    blocks = clusters.packed(frame(spark, x, range(len(x))), "embedding", rows=12)
    n_blocks = blocks.count()
    count = lambda left, right: clusters.pa.table({"n": [sum(1 for _ in clusters.two_by_two(left, right)) + (len(left) if right is None else 0)]})
    dealt = clusters.dealt(blocks, n_blocks, count, "n long")
    tasks = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
    assert n_blocks > 16 and sum(tasks) == n_blocks * (n_blocks + 1) // 2 and len(tasks) > 50


def test_cross_edges_equal_kruskal():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        n, m = rng.integers(1, 9, 2)
        w, ids = rng.integers(0, 4, (n, m)).astype(float), rng.permutation(n + m) * 3 - 7
        p, q = ids[:n], ids[n:]
        a, b = np.minimum(p[:, None], q[None]).ravel(), np.maximum(p[:, None], q[None]).ravel()
        at = clusters.kruskal(a, b, np.lexsort((b, a, w.ravel())))
        assert sorted(zip(*(c.tolist() for c in clusters.cross_edges(w, p, q)))) == sorted(zip(a[at].tolist(), b[at].tolist(), w.ravel()[at].tolist()))


def test_product_leaves_out_no_pair():
    rng = np.random.default_rng(8)
    for scale, shift in ((1.0, 0.0), (1.0, 1e6), (1e-9, 3.0), (1e-30, 0.0), (1e25, 0.0)):
        x = np.concatenate((rng.normal(size=(150, 24)), rng.normal(size=(60, 24)) * 1e-4)) * scale + shift
        y = np.concatenate((rng.normal(size=(131, 24)), x[:40], x[150:180] + 1e-7 * scale))
        d = clusters.distances(x, y)
        upto_x, upto_y = rng.choice([-1.0, 0.0, 2e-4, 4.5], 210) * scale, rng.choice([-1.0, 0.0, 4.5, 5.0], 201) * scale
        wanted = d <= np.maximum(upto_x[:, None], upto_y)
        i, j = clusters.within(x, y, upto_x, upto_y, {})
        found = np.zeros(d.shape, bool)
        found[i, j] = True
        assert found.sum() == len(i) and not (wanted & ~found).any() and (clusters.apart(x, y, i, j) == d[i, j]).all()
        if shift == 0 and scale == 1:
            assert wanted.sum() < found.sum() * 1.5 < d.size / 2


def test_gaps_in_leaf_order_are_the_heaviest_edges(spark):
    rng = np.random.default_rng(12)
    n = 40
    ids = rng.permutation(n) * 5 - 40
    edges = sorted((float(rng.integers(0, 9)), *sorted((int(ids[k]), int(ids[rng.integers(0, k)])))) for k in range(1, n))
    tree = clusters.merge_tree(spark.createDataFrame([(a, b, w) for w, a, b in edges], "a long, b long, w double"), 25)
    order = clusters.in_leaf_order(tree).orderBy("pos").collect()
    assert [r["pos"] for r in order] == list(range(n)) and sorted(r["id"] for r in order) == sorted(ids.tolist())
    assert [edges[r["rank"]] for r in order[1:]] == [(r["w"], r["a"], r["b"]) for r in order[1:]]
    joined = {i: {i} for i in ids.tolist()}
    at = {r["id"]: r["pos"] for r in order}
    for rank, (_, a, b) in enumerate(edges):
        for p in joined[a]:
            for q in joined[b]:
                assert max(r["rank"] for r in order[min(at[p], at[q]) + 1 : max(at[p], at[q]) + 1]) == rank
        whole = joined[a] | joined[b]
        joined.update(dict.fromkeys(whole, whole))


def test_tree_keeps_few_pairs_of_blocks(spark, monkeypatch):
    # every pair of blocks, or group of them, had given a forest of its own, measured pair by pair
    x = np.random.default_rng(6).normal(size=(600, 8))
    x[580:] = x[:20]
    ids = np.random.default_rng(7).permutation(600) * 3
    blocks = clusters.packed(frame(spark, x, ids), "embedding", 16)
    filled = clusters.cored(blocks, blocks.count(), 4)
    kept, forest = [], clusters.least_forest
    monkeypatch.setattr(clusters, "least_forest", lambda edges, most=clusters.MOST: kept.append(edges.count()) or forest(edges, most))
    got = clusters.spanning_tree(filled, 16).collect()
    assert kept[-1] < 2 * len(ids)
    d = clusters.distances(x, x)
    core = np.partition(d, 3, axis=1)[:, 3]
    i, j = np.triu_indices(600, 1)
    w, a, b = np.maximum(np.maximum(core[i], core[j]), d[i, j]), np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    at = clusters.kruskal(a, b, np.lexsort((b, a, w)))
    assert sorted(map(tuple, got)) == sorted(zip(a[at].tolist(), b[at].tolist(), w[at].tolist()))
