"""Pipeline operators leave the caller's columns alone, whatever their names, and the session as it was."""

from pyspark.sql import functions as F

from lantern.llm import mixing, pieces, quality, queries, secrets, similar

NAMES = ["_row", "_spans", "_doc", "_own", "_key", "_KEY_", "_named", "_copies", "_copy", "_id", "_source", "Kept", "LLR", "n_words", "_weak", "base"]


def table(spark):
    texts = [(i, f"a text of its own with many words {i} " * 4 + ("token = abcdef123456" if i % 2 else ""), "en", f"s{i % 3}", 9) for i in range(12)]
    texts += [(100, texts[3][1], "en", "s0", 9), (3, "another text of id three", "en", "s0", 9), (5, None, "en", None, 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in NAMES))


def test_extra_columns_stay(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (secrets.redact(docs), similar.without_copies(docs), mixing.mixed_documents(docs), quality.kept_documents(docs, labels)):
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[n] == f"{n} of {r['doc_id']}" for n in NAMES)
    cleaned = {(r["doc_id"], r["text"]) for r in secrets.redact(docs).collect()}
    assert len(cleaned) == 15 and not any("abcdef123456" in (t or "") for _, t in cleaned)
    kept = sorted(r["doc_id"] for r in similar.without_copies(docs).collect())
    assert 100 not in kept and kept.count(3) == 2


def test_session_is_left_alone(spark):
    docs, before = table(spark), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    similar.without_copies(docs).count()
    pieces.encode_samples(docs, queries.TOKENIZER).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
