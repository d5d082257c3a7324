"""Secret scans by multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) are reported wherever they match. Weak candidates (an opaque token, a login name)
are reported only if complementary parts co-occur in their scope: an interval join puts each weak candidate against
the anchors (access identifiers, client identifiers, endpoints) whose interval comes within `scope` code points in the
same document. A weak secret needs an identifier, strong or weak; a weak identifier needs a secret, strong or weak; an
endpoint needs both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.words import free_names
from lantern.session import written

SCOPE, RUN = 160, 256
# The base kinds' patterns, equal to the contract's after dropping its failing matches.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
# Patterns of the weak parts: an opaque token of 20+ mixed characters, a client identifier, an endpoint.
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}"
IDENTIFIER = r"""(?i)(?<![A-Za-z])(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}+"""
ENDPOINT = r"(?i)\b(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s\"'<>]{4,}+"
KINDS = ("assign", "access", "hex", "opaque", "identifier", "endpoint")
PART = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, at_least: str | None = None) -> Column:
    """(start, kind, end) of the leftmost non-overlapping matches, in code points; at_least: a pattern whose second group needs 6+ characters.

    The text is split by the pattern: match i starts behind the first i + 1 gaps and the i matches before it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    n = F.size(found)

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.element_at(gaps, i))
        end = start + F.length(F.element_at(found, i))
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))).alias("out"))

    def run_of(state: Column, first: Column) -> Column:
        # appending copies the array, so runs of RUN matches are made first and appended whole
        made = F.aggregate(F.sequence(first, F.least(first + F.lit(RUN - 1), n)), F.struct(state["at"].alias("at"), F.array().cast(PART).alias("out")), step)
        return F.struct(made["at"].alias("at"), F.array_append(state["out"], made["out"]).alias("out"))

    runs = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PART}>").alias("out"))
    spans = F.aggregate(F.sequence(F.lit(1), n, F.lit(RUN)), runs, run_of, lambda s: F.flatten(s["out"]))
    if at_least:
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        spans = F.filter(spans, lambda s, i: F.length(F.element_at(value, i + 1)) >= 6)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(PART))


def parts(documents: DataFrame) -> DataFrame:
    """doc_id, row_key (a hash of doc_id and text), base and weak: the spans of each row's whole text, null text as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(_spans(text, ASSIGN, 0, "value"), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    weak = F.concat(_spans(text, OPAQUE, 3), _spans(text, IDENTIFIER, 4), _spans(text, ENDPOINT, 5))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row_key"), F.array_sort(base).alias("base"), weak.alias("weak"))


def _apart(weak: Column, base: Column) -> Column:
    """The weak spans that touch no base span."""
    return F.filter(weak, lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))


def _binned(rows: DataFrame, reach: int) -> DataFrame:
    """A row for each bin of SCOPE code points that the interval, widened by reach, touches."""
    first, last = F.expr(f"(start - {reach}) div {SCOPE}"), F.expr(f"(end + {reach}) div {SCOPE}")
    return rows.withColumn("bin", F.explode(F.sequence(first, last)))


def _near(candidates: DataFrame, complements: DataFrame) -> DataFrame:
    """The candidates with a complement within SCOPE code points in the same row: an equi-join on bins, then the exact test."""
    c = _binned(complements.select("row_key", "start", "end"), SCOPE).alias("c")
    on = (F.col("w.row_key") == F.col("c.row_key")) & (F.col("w.bin") == F.col("c.bin")) & (F.col("c.start") <= F.col("w.end") + SCOPE) & (F.col("w.start") <= F.col("c.end") + SCOPE)
    return _binned(candidates, 0).alias("w").join(c, on, "left_semi").select("row_key", "start", "kind", "end").distinct()


def linked(found: DataFrame) -> DataFrame:
    """(row_key, weak): the weak spans of parts() whose complements co-occur in scope, sorted. Rows without any are absent.

    An opaque token needs an identifier; an identifier needs a secret; an endpoint needs both. Repeated rows are one.
    """
    some = found.where(F.size("weak") > 0).dropDuplicates(["row_key"]).select("row_key", F.explode(F.concat(_apart(F.col("weak"), F.col("base")), "base")).alias("x")).select("row_key", "x.start", "x.kind", "x.end")
    some = written(some, "parts")
    secrets, identifiers = some.where("kind in (0, 2, 3)"), some.where("kind in (1, 4)")
    tokens = _near(some.where("kind = 3"), identifiers)
    names = _near(some.where("kind = 4"), secrets)
    ends = _near(_near(some.where("kind = 5"), secrets), identifiers)
    return tokens.unionByName(names).unionByName(ends).groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("weak"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row of documents.

    Null text counts as empty (no spans, the digest of an empty list); repeated rows get equal results; an empty table
    gives an empty result; spans of one start go by kind; other columns are ignored, whatever their names.
    """
    found = written(parts(documents), "secrets")
    extra = linked(found).alias("l")
    count = lambda kind: F.size(F.filter("p.base", lambda s: s["kind"] == kind)).cast("long")
    return (
        found.alias("p")
        .join(extra, F.col("p.row_key") == F.col("l.row_key"), "left")
        .select(
            "p.doc_id",
            count(0).alias("n_assign"),
            count(1).alias("n_access"),
            count(2).alias("n_hex"),
            F.sha2(_listed(F.col("p.base")), 256).alias("base_sha256"),
            _listed(F.when(F.col("l.weak").isNull(), F.col("p.base")).otherwise(F.array_sort(F.concat("p.base", "l.weak")))).alias("spans"),
        )
    )


def redact(documents: DataFrame) -> DataFrame:
    """documents with every reported span of text replaced by [secret]; overlapping spans become one; null text stays null.

    Repeated rows are changed alike; an empty table gives an empty one; all other columns stay, whatever their names.
    """
    text = F.col("text").cast("string")
    row, doc, hits, own = free_names(documents, "_row", "_doc", "_spans", "_own")
    found = written(parts(documents), "secrets")
    extra = linked(found).select(F.col("row_key").alias(row), F.col("weak").alias("_weak"))
    none = F.array().cast(PART)
    all_spans = F.array_sort(F.concat("base", F.coalesce("_weak", none)))
    spans = found.withColumnRenamed("row_key", row).join(extra, row, "left").select(row, F.col("doc_id").alias(doc), all_spans.alias(hits)).where(F.size(hits) > 0)
    spans = written(spans.dropDuplicates([row, doc]), "redact")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        new = s["start"] >= state["at"]
        piece = F.array(text.substr(state["at"] + F.lit(1), s["start"] - state["at"]), F.lit("[secret]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(new, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"))

    cleaned = F.aggregate(hits, start, step, lambda s: F.concat(F.array_join(s["out"], ""), text.substr(s["at"] + F.lit(1), F.length(text))))
    keyed = documents.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(text, F.lit(""))))
    out = keyed.join(spans, (F.col(own) == F.col(row)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left")
    return out.withColumn("text", F.when(F.col(hits).isNull(), text).otherwise(cleaned)).select(documents.columns)
