"""The Merkle manifest against its SQL and plain hashlib, over several tiers, and edges."""

import hashlib
import zlib

import duckdb

from lantern.llm import merkle, queries


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def climb(nodes):
    """The last node, and each node's (before, after) by level."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, spot in zip(paths, spots):
            run = nodes[spot // 3 * 3 : spot // 3 * 3 + 3]
            path.append(("".join(run[: spot % 3]), "".join(run[spot % 3 + 1 :])))
        nodes, spots = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [s // 3 for s in spots]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r["source"] is not None, (r["source"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))):
        by.setdefault(r["source"], []).append(r)
    low = {s: climb([leaf(r, r["text"]) for r in group]) for s, group in by.items()}
    root, tops = climb([low[s][0] for s in by])
    out = []
    for (s, group), top in zip(by.items(), tops):
        for r, path in zip(group, low[s][1]):
            cut = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            node = leaf(r, r["text"].replace("\n", "") if cut else r["text"])
            for before, after in path + top:
                node = digest(before, node, after)
            out.append((r["doc_id"], leaf(r, r["text"]), low[s][0], root, digest(*(b + a for b, a in path + top)), node, node == root))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_query_equals_sql_and_hashlib(spark, sf_dir):
    got = found(queries.QUERIES["op13_merkle_manifest"](spark, sf_dir))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got == brute([r.asDict() for r in docs.collect()]) and not all(r[-1] for r in got)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(duck.sql(queries.ORACLE_SQL["op13_merkle_manifest"]).fetchall(), key=str)


def test_edges_and_tiers(spark):
    rows = [(i, f"text {i}\nand more", "en", "hot", i) for i in range(100)] + [(None, "no id\n", "en", "hot", 1), (None, None, None, None, None), (7, None, "en", None, 2), (3, "same", "en", "a", 4), (3, "same", "en", "a", 4), (3, "other\n", "en", "a", 5)]
    rows += [(1_000 + i, "é\n𝔘 ", None, f"source {i:02}", None) for i in range(20)] + [(5_000, "a" * 300_000 + "\n", "en", "", 1), (5_001, "", "en", "é", 0), (5_002, "x", "en", "z", -1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    names = schema.replace(" long", "").replace(" string", "").split(", ")
    expected = brute([dict(zip(names, r)) for r in rows])
    more = docs.selectExpr("*", "1 AS pos", "2 AS tree", "3 AS Size", "'x' AS leaf", "4 AS _at", "5 AS changed", "6 AS digest")
    assert found(merkle.manifest(docs.repartition(5))) == expected == found(merkle.manifest(more.repartition(3), levels=1))
    assert merkle.manifest(docs.where("false")).count() == 0
    single = docs.where("doc_id = 5002")
    r = merkle.manifest(single).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == digest("")


def test_slabs_cut_between_buckets(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(merkle, "SLAB", 5)
    rows = [(t, p, size, p // 9, digest(str((t, p)))) for t, size in ((None, 1), ("a", 25), ("b", 4)) for p in range(size)]
    table = pa.table({c: pa.array(v, k) for c, v, k in zip(merkle.COLUMNS, zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))})
    table = table.append_column("doc_id", pa.nulls(len(rows), pa.int64())).append_column("changed", pa.nulls(len(rows), pa.string()))
    got = pa.Table.from_batches(merkle.slabs(iter(table.to_batches(max_chunksize=3)), 2)).to_pylist()
    assert [(r["tree"], r["pos"]) for r in got] == [r[:2] for r in rows]
    for r in got:
        node = r["digest"]
        for step in r["path"]:
            node = digest(step["before"], node, step["after"])
        assert node == r["top"] and len(r["path"]) == {None: 0, "a": 2, "b": 2}[r["tree"]]
