"""Mixing sources to target weights by hash thresholds.

A document is taken if the hash of its id and text lies below its source's threshold,
so a larger budget always takes a superset. The threshold comes from a
histogram of sizes by source and hash bucket: whole buckets below the budget
are in, only the bucket that the budget cuts is refined by the next digits of
the hash. Nothing is sorted and no task sees a source.

Defined cases: a null text has size 0; null sources form one source, last in
the order; a null id or text counts as an empty one, so rows that share an id
are told apart by their texts; rows alike in both share their hash and are
taken alike; an empty table gives an empty mix; other columns are carried by
``mixed`` and never read.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from paywarden.llm.common import WORD, numbered, written

#: Weights by the source's place, and how often a source may be repeated.
WEIGHTS = (5, 2, 1)
MOST = 3
#: A hash has three digits of 12 bits; each level of the histogram reads one more.
DIGIT_BITS, LEVELS = 12, 3


def row_hash() -> Column:
    """36 bits of the md5 of a row's id and its text's md5."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.md5(F.concat(whole("doc_id"), F.lit(":"), F.md5(whole("text").cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, LEVELS * DIGIT_BITS // 4), 16, 10).cast("bigint")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_level(sources: DataFrame) -> tuple[int, int]:
    """(R, W): an uncapped source of weight w gets R * w / W words.

    Every round caps the sources whose share exceeds their limit and shares out
    the rest; a round is one sum over the sources, and the level only rises.
    """
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, open_weight = int(total or 0), int(weight or 0)
    exact = lambda value: F.lit(Decimal(value))
    while open_weight:
        above = exact(rest) * F.col("weight") > F.col("cap") * exact(open_weight)
        capped, left = sources.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        if int(left) == open_weight:
            break
        rest, open_weight = int(total) - int(capped), int(left)
    return rest, open_weight


def targets(sized: DataFrame) -> DataFrame:
    """Per source: its size, its target, whole copies of it, and the words still wanted after them."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sums, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    sources = written(
        ranked.select("source", "source_size", weight.cast("bigint").alias("weight"),
                      (F.col("source_size") * MOST).alias("cap")),
        "sources",
    )
    rest, open_weight = water_level(sources)
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(max(open_weight, 1)))
    target = F.least(share, F.col("cap").cast("double"))
    copies = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0)
    goals = sources.select("source", "source_size", target.alias("target"), copies.cast("bigint").alias("copies"))
    wanted = F.col("target") - F.col("copies") * F.col("source_size")
    # The quotient may round just below a whole number of copies.
    one_more = (wanted >= F.col("source_size")) & (F.col("source_size") > 0)
    return goals.select(
        "source", "source_size", "target", (F.col("copies") + F.when(one_more, 1).otherwise(0)).alias("copies"),
        F.when(one_more, 0.0).otherwise(F.greatest(wanted, F.lit(0.0))).alias("wanted"),
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with ``threshold``: documents whose hash lies below it make up the words wanted.

    ``state`` follows the bucket that the budget cuts: the digits of the hash
    so far, and the words still wanted inside it. At the last level the group
    of equal hashes is taken if that comes nearer to the budget.
    """
    state = goals.select("source", F.lit(0).cast("bigint").alias("prefix"), "wanted")
    done = []
    for level in range(1, LEVELS + 1):
        shift = DIGIT_BITS * (LEVELS - level)
        inside = sized.withColumn("bucket", F.shiftright("hash", shift)).join(
            state.withColumnRenamed("source", "own"),
            F.col("source").eqNullSafe(F.col("own")) & (F.shiftright("bucket", DIGIT_BITS) == F.col("prefix")),
        )
        sums = inside.groupBy("source", "wanted", "bucket").agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("end", F.sum("n").over(upto))
        cut = sums.where((F.col("end") > F.col("wanted")) & (F.col("end") - F.col("n") <= F.col("wanted")) & (F.col("n") > 0))
        left = cut.select("source", F.col("bucket").alias("prefix"), (F.col("wanted") - F.col("end") + F.col("n")).alias("wanted"), "n")
        if level < LEVELS:
            state = written(left.drop("n"), "bucket")
        else:
            nearer = F.when(F.col("n") <= 2 * F.col("wanted"), 1).otherwise(0)
            done = left.select(F.col("source").alias("own"), (F.col("prefix") + nearer).alias("threshold"))
    return goals.join(done, F.col("source").eqNullSafe(F.col("own")), "left").select(
        goals["*"], F.coalesce("threshold", F.lit(0)).alias("threshold")
    )


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash of every document; targets and thresholds of every source), both written."""
    sized = written(
        docs.select("doc_id", "source", words(F.col("text")).alias("size"), row_hash().alias("hash")),
        "sized",
    )
    goals = written(targets(sized), "goals")
    return sized, written(thresholds(sized, goals), "thresholds")


def times(limit: DataFrame, digits: Column) -> Column:
    """How often the mix takes a document with this hash."""
    return limit["copies"] + F.when(digits < limit["threshold"], 1).otherwise(0)


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, and the words that the mix takes of it."""
    sized, limit = plan(docs)
    limit = limit.withColumnRenamed("source", "own")
    joined = sized.join(limit, sized["source"].eqNullSafe(limit["own"]))
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times(limit, F.col("hash"))).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    _, limit = plan(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), row_hash().alias("hash"))
    limit = limit.withColumnRenamed("source", "own")
    joined = rows.join(limit, rows["source"].eqNullSafe(limit["own"]))
    again = F.explode(F.array_repeat(F.lit(True), times(limit, F.col("hash")).cast("int")))
    return joined.select("row", again).select("row.*")
