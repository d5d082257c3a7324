"""Every operator on nulls, empty and long texts, repeated rows, empty tables and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lantern.llm import html_text, media, mixing, ngram_model, pieces, quality, queries, quotes, secrets, simhash, similar, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, fp string, kind int"
LONG = "a long text with words " * 20_000
ROWS = [
    (1, None, "en", "s", 0, True, 1, "x", 1),
    (2, "", "en", None, 0, None, None, None, None),
    (3, " \n\t ", None, "s", None, False, 2, "y", 2),
    (4, LONG, "en", "t", 9, True, 3, "z", 3),
    (5, "token = abc123456 é𝔘 " * 30, "en", "t", 9, True, 3, "z", 3),
    (5, "token = abc123456 é𝔘 " * 30, "en", "t", 9, True, 3, "z", 3),
    (None, "no id but words enough to count here", "en", "t", 9, True, 3, "z", 3),
    (7, "same doc id", "en", "u", 9, True, 3, "z", 3),
    (7, "other text", "en", "u", 9, True, 3, "z", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 0, 1), (None, 1, None), (7, None, 0)], "doc_id long, quality int, toxic int")


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_scores(docs, none):
    got = rows(ngram_model.score_documents(docs), "doc_id", "n_tokens", "held_out")
    assert len(got) == len(ROWS) and (1, 1, got[[g[0] for g in got].index(1)][2]) in got
    assert ngram_model.score_documents(none).count() == 0
    few, many = (rows(ngram_model.score_documents(docs, **kw), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score") for kw in ({}, {"segment_chars": 5_000, "block_bytes": 100}))
    assert len(few) == len(many) == len(ROWS)
    for a, b in zip(few, many, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5], rel=0.05, abs=5)


def test_quality(spark, docs, none, labels):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.score_quality(docs, labels).collect()}
    assert got[(1, 0)]["base_failed"] and not got[(1, 0)]["kept"] and got[(4, 100_000)]["n_repeat_words"] == 100_000
    assert quality.score_quality(docs, labels).count() == len(ROWS) and quality.score_quality(none, labels).count() == 0
    assert quality.score_quality(docs, labels.limit(0)).count() == len(ROWS)
    assert quality.kept_documents(docs, labels).columns == docs.columns


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (None, None, "<p>é &amp; x"), (3, "u", "<div " * 50 + LONG), (4, "u", "<!-- open"), (5, "u", "<script>never closed")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {(r["page_id"], r["text"][:8], r["n_chars"]) for r in html_text.extract_pages(pages).collect()}
    assert {(1, "", 0), (2, "", 0), (None, "é & x", 5), (4, "", 0), (5, "", 0)} <= got
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_mixing(docs, none):
    got = rows(mixing.mix(docs), "doc_id", "size", "taken", "source_size")
    assert len(got) == len(ROWS) and all(t <= 2 * s for _, s, t, _ in got)
    assert got == rows(mixing.mix(docs.repartition(5)), "doc_id", "size", "taken", "source_size")
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_quotes(spark):
    talk = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, ">" * 50 + " x"), (None, 0, "a", "> q"), (1, None, "a", ""), (2, 5, "a", LONG)], "conv_id long, turn long, role string, text string").withColumn("parent", F.lit(1))
    assert quotes.link_quotes(talk).count() == 6 and quotes.link_quotes(talk.limit(0)).count() == 0


def test_secrets(docs, none):
    got = rows(secrets.scan_secrets(docs), "doc_id", "n_assign", "n_hex")
    assert len(got) == len(ROWS) and got.count((5, 30, 0)) == 2 and (1, 0, 0) in got
    assert secrets.scan_secrets(none).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[1] is None and "abc123456" not in clean[5] and clean[4] == LONG


def test_pieces(docs, none):
    got = pieces.encode_samples(docs, queries.TOKENIZER, 2).collect()
    assert all(r["round_trip"] for r in got) and pieces.encode_samples(none, queries.TOKENIZER).count() == 0
    assert [len([1 for r in got if r["doc_id"] == i]) for i in (1, 2, 5)] == [1, 1, 4]
    assert len({tuple(r["ids"]) for r in got if r["doc_id"] == 5}) == 2


def test_fingerprints(docs, none):
    got = rows(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")
    assert len(got) == len(ROWS) and {(1, 0, 1), (2, 0, 1), (3, 0, 1)} <= set(got)
    assert simhash.near_duplicates(none).count() == 0
    left = rows(similar.without_copies(docs.union(docs.where("doc_id is null"))), "doc_id", "text")
    assert [r[0] for r in left].count(5) == 1 and [r[0] for r in left].count(7) == 2 and [r[0] for r in left].count(None) == 1 and 2 not in [r[0] for r in left]
    assert similar.without_copies(none).count() == 0 and similar.without_copies(docs).columns == docs.columns


def test_suffixes(docs, none):
    got = rows(suffix_dedup.dedup_suffixes(docs), "doc_id", "n_bytes", "n_removed")
    assert len(got) == len(ROWS) and (1, 0, 0) in got and got.count((5, 750, got[[g[0] for g in got].index(5)][2])) == 2
    assert suffix_dedup.dedup_suffixes(none).count() == 0


def test_media(spark, docs, none):
    got = rows(media.text_media(docs), "doc_id", "n_bytes", "payload_bytes")
    assert len(got) == len(ROWS) and (1, 0, 64) in got and media.text_media(none).count() == 0
    files = spark.createDataFrame([(b"P5 2 2 255\n\0\1\2\3", 1), (None, 2), (b"", 3), (b"P5 9 9 255\n\0", 4)], "content binary, media_tile int")
    assert [r["media_error"] is None for r in media.media_columns(files).collect()] == [True, False, False, False]


def test_pipeline_stages_keep_columns(spark, tmp_path, labels):
    plain = spark.createDataFrame([r[:5] for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, plain, str(tmp_path)).columns == plain.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert "ids" in out.columns and out.count() >= 0
