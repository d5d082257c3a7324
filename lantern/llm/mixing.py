"""Mixing sources to target weights by entropy balancing.

Among all document rates r, 0 to 2, that meet every source's token constraint sum(r * size) = target and keep the mix's
document lengths near the corpus's, entropy balancing takes those closest to rate 1 in size-weighted relative entropy.
With z the logarithm of a document's size, centred and scaled over the corpus's tokens, its dual is convex:

    minimise  sum of size * G(x_source + b * z)  -  sum of target * x_source  -  b * m  +  RIDGE / 2 * sum(size) * b**2

G' (u) = min(exp(u), 2), so the rates are exponential tilts min(exp(x_source + b * z), 2): every source has its own x, all
documents share b. m makes the mix's mean z that of the corpus; RIDGE lets it miss where the sources leave no room.
Each Newton step sums gradient and curvature over the documents (equal sizes of a source summed before), solves the
arrowhead system by its Schur complement, a few sums, and moves x and b. Sources at their cap have rate 2.

Rates are rounded to copies by order sampling: a document gets the higher count if u / fraction, u a hash, is below its
source's threshold, which is where the running size meets the target. It is found from sums over 2**BIN_BITS ranges of
that number, LEVELS times one inside the other, and exactly inside the last one, so no task ever holds a source's
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.words import free_names
from lantern.session import written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
NEWTON_STEPS, CLOSE = 200, 1e-9
RIDGE = 0.01
BIN_BITS, LEVELS = 12, 2
PLACES = 62
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_totals(sized: DataFrame) -> DataFrame:
    """(source, source_size, weight): sources by code point, null last, weigh 3, 1, 2, repeating."""
    spark = sized.sparkSession
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = sums.orderBy(F.col("source").isNull(), "source")
    ranked = spark.createDataFrame(order.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), "source string, source_size long, at long")
    pick = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("at") % len(WEIGHTS) + 1).cast("int"))
    return written(ranked.select("source", "source_size", pick.cast("double").alias("weight")), "ranked")


def source_targets(totals: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """totals with target: `share` of all sizes by weight, cut at `most` times the source's size, the excess reshared.

    Each round fixes the sources whose share passes their cut; what is left is shared among the others by weight. Only
    two sums a round come to the driver.
    """
    cap = F.col("source_size") * F.lit(most)
    left = (totals.agg(F.sum("source_size").alias("n")).head()["n"] or 0) * share
    level = None
    closed = F.lit(False)
    while True:
        s = totals.select(F.sum(F.when(closed, cap).otherwise(F.lit(0.0))).alias("used"), F.sum(F.when(closed, F.lit(0.0)).otherwise(F.col("weight"))).alias("weight"), F.count_if(closed).alias("n")).head()
        if not s["weight"]:
            break
        new = (left - s["used"]) / s["weight"]
        if level is not None and new <= level:
            break
        level = new
        closed = F.col("weight") * F.lit(level) > cap
        if totals.agg(F.count_if(closed).alias("n")).head()["n"] == s["n"]:
            break
    return totals.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level if level is not None else 0.0)))


def tilted_rates(targets: DataFrame, sized: DataFrame, steps: int = NEWTON_STEPS, most: float = MOST) -> tuple[DataFrame, Column]:
    """targets with x (null at the cap or without a target), and the rate of a row with x, target, source_size and size."""
    counted = written(sized.where("size > 0").groupBy("source", "size").agg(F.sum("size").alias("w")), "sizes")
    log = F.log1p("size")
    s = counted.agg(F.sum("w").alias("w"), F.sum(F.col("w") * log).alias("a"), F.sum(F.col("w") * log * log).alias("b")).head()
    mean = s["a"] / s["w"] if s["w"] else 0.0
    spread = max((s["b"] / s["w"] - mean * mean) ** 0.5 if s["w"] and s["b"] / s["w"] > mean * mean else 1.0, 1e-6)
    z = (log - F.lit(mean)) / F.lit(spread)
    capped = F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-9))
    free = (F.col("target") > 0) & ~capped
    state = targets.withColumn("x", F.when(free, F.log(F.col("target") / F.col("source_size"))))
    rows = written(counted.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).where(free | capped).select("t.source", "t.target", free.alias("free"), "c.w", z.alias("z")), "dual")
    fixed = rows.where(~F.col("free")).agg(F.sum(F.col("w") * F.col("z") * F.lit(most)).alias("m")).head()["m"] or 0.0
    rows, ridge, b = rows.where("free"), RIDGE * (s["w"] or 0), 0.0
    for _ in range(steps):
        u = F.col("x") + F.lit(b) * F.col("z")
        tilt = F.exp(F.least(u, F.lit(50.0)))
        rate, slope = F.col("w") * F.least(tilt, F.lit(most)), F.when(tilt <= most, F.col("w") * tilt).otherwise(F.lit(0.0))
        sums = (
            rows.alias("r")
            .join(state.select("source", "x").alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
            .groupBy("r.source", "r.target", "s.x")
            .agg((F.sum(rate) - F.col("target")).alias("g"), F.greatest(F.sum(slope), F.lit(1e-9)).alias("h"), F.sum(slope * F.col("z")).alias("c"), F.sum(rate * F.col("z")).alias("gz"), F.sum(slope * F.col("z") * F.col("z")).alias("hz"))
        )
        sums = written(sums, "newton")
        t = sums.agg(F.sum("gz").alias("gz"), F.sum("hz").alias("hz"), F.sum(F.col("c") * F.col("g") / F.col("h")).alias("cg"), F.sum(F.col("c") * F.col("c") / F.col("h")).alias("cc"), F.max(F.abs(F.col("g")) / F.col("target")).alias("off"), F.sum("target").alias("all")).head()
        if t["all"] is None:
            break
        gradient = t["gz"] + fixed + ridge * b
        if t["off"] < CLOSE and abs(gradient) < CLOSE * t["all"]:
            break
        step = -max(-1.0, min(1.0, (gradient - t["cg"]) / (t["hz"] + ridge - t["cc"])))
        move = (F.col("g") + F.col("c") * F.lit(step)) / F.col("h")
        state = sums.select("source", (F.col("x") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), move))).alias("x"))
        b += step
    else:
        raise ArithmeticError(f"the rates are not settled after {steps} Newton steps")
    out = targets.alias("t").join(state.select("source", "x").alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")), "left").select("t.*", "s.x")
    rate = F.when(F.col("x").isNotNull(), F.least(F.exp(F.col("x") + F.lit(b) * z), F.lit(most))).when(F.col("target") > 0, F.lit(most)).otherwise(F.lit(0.0))
    return written(out, "tilts"), rate


def mix(documents: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, key, taken) per row of documents; reruns agree.

    Null text has size 0 and is never copied; a null source is a source of its own; repeated rows get the same copies;
    an empty table gives an empty result; rows of one place in the order, which need equal hashes, go by doc_id. key is a
    hash of doc_id and text. taken = copies * size, so a source of unrepeated rows misses its target by less than half
    a document, as a rule by a few words.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sized = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key")), "sized")
    tilts, rate = tilted_rates(source_targets(source_totals(sized), share, most), sized, most=most)
    rated = sized.alias("d").join(tilts.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target", "t.x").withColumn("rate", rate)
    part = F.col("rate") - F.floor("rate")
    ratio = (F.shiftrightunsigned("key", 11) + F.lit(0.5)) / F.lit(float(2**53)) / part
    place = F.when((part > 0) & (F.col("size") > 0), F.floor(ratio / (ratio + F.lit(1.0)) * F.lit(float(2**PLACES))).cast("long"))
    placed = written(rated.drop("x").withColumn("place", place), "placed")
    needs = placed.groupBy("source", "target").agg((F.col("target") - F.sum(F.floor("rate") * F.col("size"))).alias("need"))
    cut = needs.select("source", "need", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("before"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    in_cut = lambda level: F.col("p.source").eqNullSafe(F.col("c.source")) & (F.shiftright("p.place", PLACES - BIN_BITS * level) == F.col("c.bin"))
    for level in range(1, LEVELS + 1):
        own = F.shiftright("p.place", PLACES - BIN_BITS * level).alias("bin")
        bins = placed.where("place is not null").alias("p").join(cut.alias("c"), in_cut(level - 1)).groupBy("p.source", own, "c.need", F.col("c.before").alias("base")).agg(F.sum("p.size").alias("n"))
        bins = bins.withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(running), F.lit(0)))
        cut = written(bins.where("before < need and before + n >= need").select("source", "need", "bin", "before"), "cut")
    inside = placed.alias("p").join(cut.alias("c"), in_cut(LEVELS)).groupBy("p.source", "p.place", "p.doc_id", "c.need", "c.before").agg(F.sum("p.size").alias("size"))
    upto = Window.partitionBy("source").orderBy("place", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # up to the last running sum within the need; rows before the range are all in, rows behind it all out
    point = (
        inside.withColumn("here", F.col("before") + F.sum("size").over(upto))
        .where("here <= need")
        .groupBy("source")
        .agg(F.max(F.struct("place", F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("last"), F.max("here").alias("here"))
    )
    points = cut.alias("c").join(point.alias("q"), F.col("c.source").eqNullSafe(F.col("q.source")), "left")
    points = written(points.select("c.source", "c.bin", "q.last", (F.col("c.need") - F.coalesce("q.here", "c.before")).alias("rest")), "points")
    own = F.struct("p.place", F.col("p.doc_id").isNotNull().alias("known"), "p.doc_id")
    bin_of = F.shiftright("p.place", PLACES - BIN_BITS * LEVELS)
    more = F.coalesce((bin_of < F.col("c.bin")) | ((bin_of == F.col("c.bin")) & (own <= F.col("c.last"))), F.lit(False))
    chosen = placed.alias("p").join(points.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", "c.rest", more.alias("more"), own.alias("own"))
    # one further document whose size comes nearest to what is still missing
    off = F.abs(F.col("size") - F.col("rest"))
    last = chosen.where(~F.col("more") & F.col("place").isNotNull() & (off < F.col("rest"))).groupBy("source").agg(F.min_by("own", F.struct(off, "own")).alias("extra"))
    copies = (F.floor("p.rate") + (F.col("p.more") | F.coalesce(F.col("p.own") == F.col("l.extra"), F.lit(False))).cast("long")).cast("long")
    return (
        chosen.alias("p")
        .join(last.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left")
        .select("p.doc_id", "p.source", "p.size", "p.source_size", "p.target", "p.rate", F.when(F.col("p.size") > 0, copies).otherwise(F.lit(0)).alias("copies"), "p.key")
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mixed_documents(documents: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of documents as often as mix() takes them; documents that it takes no time are gone. Edge cases as in mix()."""
    own, copy, doc, of, key, copies = free_names(documents, "_own", "_copy", "_id", "_source", "_key", "_copies")
    times = mix(documents.select("doc_id", "source", "text"), share, most).where("copies > 0").select(F.col("doc_id").alias(doc), F.col("source").alias(of), F.col("key").alias(key), F.col("copies").alias(copies)).distinct()
    keyed = documents.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    same = F.col(own).eqNullSafe(F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.col("source").cast("string").eqNullSafe(F.col(of))
    return keyed.join(times, same).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(documents.columns)
