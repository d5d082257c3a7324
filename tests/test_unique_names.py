"""Counters of unique names against the names of other files."""

from lantern.operators import archives


def test_counter_moves_past_names_taken(spark):
    names = ["a.jpg", "A.jpg", "a (2).jpg", "a.jpg", "a (2).jpg", "a (2) (2).jpg", "b"]
    files = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = [r["unique_name"] for r in archives.unique_names(files, "id", "name", "id").orderBy("id").collect()]
    assert len({x.lower() for x in got}) == len(names)
    assert got[0] == "a.jpg" and got[2] == "a (2).jpg" and got[5] == "a (2) (2).jpg" and got[6] == "b"
