"""Files read by the names given, in tasks of a given number."""

import hashlib

from lantern.sources import files


def test_md5_digests_of_given_names(spark, tmp_path):
    names = [f"{tmp_path}/{i}.mov" for i in range(40)]
    for i, name in enumerate(names[:-1]):
        with open(name, "wb") as f:
            f.write(bytes([i]) * i * 1_000)
    given = files.spread(spark.createDataFrame([(n,) for n in names], "path string"), 8)
    assert given.rdd.getNumPartitions() == 5
    got = {r["path"]: (r["size"], r["digest"]) for r in files.md5_digests(given).collect()}
    assert got == {n: (i * 1_000, hashlib.md5(bytes([i]) * i * 1_000).hexdigest()) for i, n in enumerate(names[:-1])} | {names[-1]: (None, None)}


def test_exports_make_no_task_of_every_32_files(spark, sf_dir):
    from lantern.plans.catalogue import QUERIES

    # Spark's file source would have split the files by their opening cost
    for name in ("ranged_fingerprints", "extracted_tree"):
        frame = QUERIES[name](spark, sf_dir)
        assert "binaryFile" not in frame._jdf.queryExecution().executedPlan().toString()
