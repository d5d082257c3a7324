"""Chat formatting by quotation linking.

Every message's text is parsed line by line: a line's quote level is its number of leading `>` marks, and the
attribution right before a deeper quote belongs to it (a paragraph's end of any length that ends in a colon and says who
wrote, or holds an address, or a date with a time). Runs of one level are quoted passages. A passage is
hashed whole and by its blocks (paragraphs, lines, pairs of lines; marks, letter case and white space aside), and so is
every message's own unquoted text. A block stands in the latest earlier turn of its conversation that has it, and in the
earliest message of all; a passage links to the message that has it whole, else to the one that has most letters of its
blocks, and of equals to that of its own conversation. A passage that no block links (part of a line, or lines broken
otherwise) is asked again by its windows of WINDOW words: it links to the message that has more than half of them. The
reply's parent is the original of its outermost linked passage, or the previous turn of its conversation. Conversations
are then ordered by replies and carry no quotes.

Earlier turns are found inside blocks of turns and carried from block to block, so no long conversation meets in one task,
and a frequent passage is reduced to one original a conversation and one of all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.words import chunks
from lantern.session import drop_written, written

MARK = re.compile(r"^(?:[ \t]*>)+ ?")
WRITES = re.compile(r"\b(?:wrote|writes|schrieb|schreibt|escribió|escribe|écrit|scritto|scrive|escreveu|escreve|skrev|schreef|napisał|napisała)\b", re.I)
ADDRESS = re.compile(r"[^\s@][@][^\s@]")
DATE = re.compile(r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b|\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b|\b\d{1,2}(?:st|nd|rd|th|\.)? (?:de |of )?[^\W\d_]{3,12}\.?,? (?:de )?\d{4}\b|\b[^\W\d_]{3,12}\.? \d{1,2},? \d{4}\b")
TIME = re.compile(r"\b\d{1,2}[:.]\d{2}\b")
OPENS = re.compile(r"(?:On|Am|El|Le|Il|Em|Den|Op|W dniu)\s")
TURNS, WINDOW = 4096, 3


def _attributes(text: str) -> bool:
    """Whether a text that ends in a colon says who wrote: a verb with nothing but a name behind it, an address, or date and time."""
    if not text.endswith(":"):
        return False
    verb = None
    for verb in WRITES.finditer(text):
        pass
    if verb and all(not w[0].isalpha() or w[0].isupper() or "@" in w for w in text[verb.end() : -1].split()):
        return True
    return bool(ADDRESS.search(text)) or bool(DATE.search(text) and TIME.search(text))


def without_attribution(lines: list[str]) -> list[str]:
    """lines without the attribution that ends them and the blank lines behind it; folded lines of it go too.

    The lines before belong to it if they hold a date or an address, or open as one does, and end no sentence.
    """
    end = len(lines)
    while end and not lines[end - 1].strip():
        end -= 1
    first = end - 1
    if end == 0 or not lines[first].rstrip().endswith(":"):
        return lines[:end]
    while first and lines[first - 1].strip():
        before = lines[first - 1].strip()
        if before[-1] in ".!?:;" or not (ADDRESS.search(before) or DATE.search(before) or OPENS.match(before)):
            break
        first -= 1
    joined = " ".join(x.strip() for x in lines[first:end])
    return lines[:first] if _attributes(joined) else lines[:end]


def normalised(passage: str) -> str:
    return " ".join(passage.lower().split())


def passage_hash(passage: str) -> int:
    value = xxhash.xxh64_intdigest(normalised(passage).encode())
    return value - (1 << 64) if value >> 63 else value


def parse_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and its quoted passages as (level, passage) in order; nested levels are passages of their own."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    level_before = 0
    for line in (text or "").split("\n"):
        m = MARK.match(line)
        level = m[0].count(">") if m else 0
        if level == 0:
            own.append(line)
        else:
            if level_before == 0:
                own = without_attribution(own)
            elif level > level_before:
                passages[-1] = (level_before, without_attribution(passages[-1][1]))
            if level != level_before or not passages:
                passages.append((level, []))
            passages[-1][1].append(line[m.end() :])
        level_before = level
    quoted = [(level, "\n".join(lines).strip()) for level, lines in passages]
    return "\n".join(own).strip(), [(level, p) for level, p in quoted if normalised(p)]


def block_hashes(passage: str) -> dict[int, int]:
    """Hash and letters of the passage, of its paragraphs and lines, and of each line with the next one."""
    lines = [x for x in passage.split("\n") if x.strip()]
    pieces = [passage, *re.split(r"\n\s*\n", passage), *lines, *map("\n".join, zip(lines, lines[1:], strict=False))]
    return {passage_hash(p): len(normalised(p)) for p in pieces if normalised(p)}


def parsed(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, own, quotes array<struct<level, text, whole, blocks>>, hashes. Null text counts as empty."""
    blocks = pa.list_(pa.struct([("hash", pa.int64()), ("chars", pa.int32())]))
    kinds = (pa.string(), pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), ("whole", pa.int64()), ("blocks", blocks)])), blocks)
    block = "array<struct<hash:long,chars:int>>"
    schema = f"conv_id long, turn long, role string, own string, quotes array<struct<level:int,text:string,whole:long,blocks:{block}>>, hashes {block}"

    def listed(passage: str) -> list[dict]:
        return [{"hash": h, "chars": n} for h, n in block_hashes(passage).items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            own, quotes, hashes = [], [], []
            for text in texts:
                rest, found = parse_quotes(text.decode())
                own.append(rest)
                quotes.append([{"level": level, "text": p, "whole": passage_hash(p), "blocks": listed(p)} for level, p in found])
                hashes.append(listed(rest))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, (own, quotes, hashes), kinds)], names=["conv_id", "turn", "role", "own", "quotes", "hashes"])

    source = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def earlier_turns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, turn, has), one a turn of the keys, with `before`: the last smaller turn whose row has, or null."""
    cut = rows.withColumn("_part", F.floor(F.col("turn") / TURNS))
    over = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per block of turns
    carried = cut.groupBy(*keys, "_part").agg(F.max(F.when(F.col("has"), F.col("turn"))).alias("_last")).withColumn("_carried", F.max("_last").over(over))
    inside = Window.partitionBy(*keys, "_part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    found = cut.withColumn("_inside", F.max(F.when(F.col("has"), F.col("turn"))).over(inside))
    return found.join(carried.select(*keys, "_part", "_carried"), [*keys, "_part"]).select(*rows.columns, F.coalesce("_inside", "_carried").alias("before"))


def _windows(text: Column) -> Column:
    """Distinct hashes of the text's windows of WINDOW words, letter case and line breaks aside; none of shorter texts."""
    words = F.filter(F.split(F.lower(text), r"[\s\p{Z}]+"), lambda w: w != "")
    at = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, WINDOW)))))


def _by_windows(known: DataFrame, linked: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, turn, pos, level, at) of the passages that are not in linked, by the windows of words that they share, and the tables that it reads.

    Of each window only the latest earlier turn of the conversation that has it counts, and the earliest message of all.
    """
    passage = ["conv_id", "turn", "pos", "level"]
    asked = known.select("conv_id", "turn", F.posexplode("quotes").alias("pos", "q")).select("conv_id", "turn", "pos", "q.level", "q.text").join(linked, passage, "left_anti")
    asked = asked.withColumn("w", _windows(F.col("text"))).select(*passage, F.size("w").alias("n"), F.explode("w").alias("hash")).distinct()
    asked = written(asked, "asked")
    own = known.select("conv_id", "turn", F.explode(_windows(F.col("own"))).alias("hash")).join(asked.select("hash").distinct(), "hash", "left_semi")
    own = written(own.distinct(), "windows")
    uses = own.select("conv_id", "hash", "turn", F.lit(True).alias("has")).unionByName(asked.select("conv_id", "hash", "turn", F.lit(False).alias("has")))
    uses = uses.groupBy("conv_id", "hash", "turn").agg(F.max("has").alias("has"))
    near = earlier_turns(uses, ["conv_id", "hash"]).where("before is not null").select("conv_id", "hash", "turn", F.struct("conv_id", F.col("before").alias("turn")).alias("at"))
    near = asked.join(near, ["conv_id", "hash", "turn"])
    first = own.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("at"))
    far = asked.join(first, "hash").where(F.col("at.conv_id") < F.col("conv_id"))
    shares = near.select(*passage, "n", "hash", "at").unionByName(far.select(*passage, "n", "hash", "at")).groupBy(*passage, "n", "at").agg(F.count("*").alias("shared"))
    inner = F.col("at.conv_id") == F.col("conv_id")
    best = F.struct("shared", inner, F.when(inner, F.col("at.turn")), -F.col("at.conv_id"), -F.col("at.turn"))
    return shares.where(F.col("shared") * 2 > F.col("n")).groupBy(*passage).agg(F.max_by("at", best).alias("at")), [asked, own]


def link_quotes(conversations: DataFrame, least_chars: int = 0) -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotes), n_quotes, n_linked, parent_conv, parent_turn,
    root_conv, root_turn, depth. A conversation is the rows of one root in the order (depth, conv_id, turn).

    Messages of the same (conv_id, turn) are one message's rows and share its place. Rows with a null conv_id or turn
    are roots of their own. A message never links to itself or to a later turn of its own conversation, and across
    conversations only to a smaller conv_id, so links have no cycles. Blocks of fewer than least_chars letters link inside
    their conversation only. An empty table gives an empty result; texts of any length are read whole, one at a time;
    other columns are ignored.
    """
    rows = written(parsed(conversations), "messages")
    known = rows.where("conv_id is not null and turn is not null")
    own = known.select("conv_id", "turn", F.explode("hashes").alias("b")).select("conv_id", "turn", "b.hash", "b.chars")
    quotes = known.select("conv_id", "turn", F.posexplode("quotes").alias("pos", "q")).select("conv_id", "turn", "pos", "q.level", "q.whole", F.explode("q.blocks").alias("b"))
    quotes = written(quotes.select("conv_id", "turn", "pos", "level", "b.hash", "b.chars", (F.col("b.hash") == F.col("whole")).alias("whole")).distinct(), "quotes")
    asked = quotes.select("hash").distinct()
    own = written(own.join(asked, "hash", "left_semi"), "originals")
    uses = own.select("conv_id", "hash", "turn", F.lit(True).alias("has")).unionByName(quotes.select("conv_id", "hash", "turn", F.lit(False).alias("has")))
    uses = uses.groupBy("conv_id", "hash", "turn").agg(F.max("has").alias("has"))
    near = earlier_turns(uses, ["conv_id", "hash"]).where("before is not null").select("conv_id", "hash", "turn", F.struct("conv_id", F.col("before").alias("turn")).alias("at"))
    near = quotes.join(near, ["conv_id", "hash", "turn"])
    first = own.where(F.col("chars") >= least_chars).groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("at"))
    far = quotes.join(first, "hash").where(F.col("at.conv_id") < F.col("conv_id"))
    votes = near.select("conv_id", "turn", "pos", "level", "at", "chars", "whole").unionByName(far.select("conv_id", "turn", "pos", "level", "at", "chars", "whole"))
    shares = votes.groupBy("conv_id", "turn", "pos", "level", "at").agg(F.max("whole").alias("whole"), F.sum("chars").alias("chars"))
    inner = F.col("at.conv_id") == F.col("conv_id")
    best = F.struct("whole", F.when(F.col("whole"), 0).otherwise(F.col("chars")), inner, F.when(inner, F.col("at.turn")), -F.col("at.conv_id"), -F.col("at.turn"))
    linked = shares.groupBy("conv_id", "turn", "pos", "level").agg(F.max_by("at", best).alias("at"))
    by_blocks = written(linked, "linked")
    by_windows, windows = _by_windows(known, by_blocks.select("conv_id", "turn", "pos", "level"))
    linked = by_blocks.unionByName(by_windows)
    links = linked.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.min_by("at", F.struct("level", "pos")).alias("quoted"))
    turns = known.groupBy("conv_id", "turn").agg(F.max(F.size("quotes")).alias("n_quotes"))
    turns = earlier_turns(turns.withColumn("has", F.lit(True)), ["conv_id"])
    nodes = (
        turns.join(links, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
            F.when(F.col("quoted").isNotNull(), F.col("quoted")).when(F.col("before").isNotNull(), F.struct("conv_id", F.col("before").alias("turn"))).alias("parent"),
        )
    )
    nodes = written(nodes, "nodes")
    for table in (quotes, own, by_blocks, *windows):
        drop_written(conversations.sparkSession, table)
    placed = _roots(nodes)
    drop_written(conversations.sparkSession, nodes)
    return (
        rows.join(placed, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            F.col("own").alias("text"),
            F.size("quotes").cast("long").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.col("parent.conv_id").alias("parent_conv"),
            F.col("parent.turn").alias("parent_turn"),
            F.coalesce("root.conv_id", "conv_id").alias("root_conv"),
            F.coalesce("root.turn", "turn").alias("root_turn"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        )
    )


def _roots(nodes: DataFrame) -> DataFrame:
    """nodes with root and depth, by pointer doubling: every round joins the nodes on the way to their pointer's pointer.

    A node whose pointer is at a root (or past it) is done and is never joined again, only looked up.
    """
    start = nodes.select("conv_id", "turn", "n_linked", "parent", F.coalesce("parent", F.struct("conv_id", "turn")).alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    start = written(start.withColumn("done", F.col("parent").isNull()), "pointers")  # nodes is read here only
    finished, moving = start.where("done"), start.where(~F.col("done"))
    while True:
        at = F.struct("conv_id", "turn").alias("root")
        known = finished.select(at, F.col("root").alias("next"), F.col("depth").alias("more"), F.lit(True).alias("end")).unionByName(moving.select(at, F.col("root").alias("next"), F.col("depth").alias("more"), F.lit(False).alias("end")))
        hop = moving.join(known, "root").select("conv_id", "turn", "n_linked", "parent", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("end").alias("done"))
        hop = written(hop, "pointers")
        finished, moving = finished.unionByName(hop.where("done")), hop.where(~F.col("done"))
        if moving.isEmpty():
            return finished.select("conv_id", "turn", "n_linked", "parent", "root", "depth")
