"""Ranks, first lines and repeated keys that stay balanced when one key is huge.

A window over a person key puts all lines of that key into one task. Only
``ranked`` needs a window, and it cuts large groups into slices. Everything
else is a partial aggregate: each task sends one row per key at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from paywarden.schema import LINE_ORDER
from paywarden.session import scratch_path

#: A key is large when it holds more than 1/LARGE_KEYS of all lines. By the
#: pigeonhole principle there are fewer than LARGE_KEYS such keys, whatever the
#: size of the data, so the list of them (a few MB at most) may be broadcast.
LARGE_KEYS = 50_000
#: Keys with fewer lines than this are never cut.
LARGE_FLOOR = 500_000


def first_by(lines: DataFrame, keys: list[str], order: list[str] = LINE_ORDER, min_rows: int = 1) -> DataFrame:
    """The first whole line of each key that has at least ``min_rows`` lines."""
    head = F.min_by(F.struct(*lines.columns), F.struct(*order))
    heads = lines.groupBy(*keys).agg(head.alias("head"), F.count(F.lit(1)).alias("line_count"))
    if min_rows > 1:
        heads = heads.where(F.col("line_count") >= min_rows)
    return heads.select("head.*")


def first_line_ids(lines: DataFrame, keys: list[str], order: list[str] = LINE_ORDER) -> DataFrame:
    """Per key, the id of its first line."""
    head = F.min(F.struct(*order))
    return lines.groupBy(*keys).agg(head.alias("head")).select(*keys, F.col("head.line_id").alias("first_line_id"))


def flag_first(lines: DataFrame, keys: list[str], order: list[str] = LINE_ORDER, out: str = "first_line",
               identity: list[str] = ("line_id",)) -> DataFrame:
    """Mark the first line of each key. The flag comes back by line id, which no key can skew."""
    identity = list(identity)
    firsts = lines.groupBy(*keys).agg(F.min(F.struct(*order)).alias("head"))
    marks = firsts.select(*[F.col("head." + c) if c in order else F.col(c) for c in identity], F.lit(True).alias(out))
    return lines.join(marks, identity, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def repeated(lines: DataFrame, keys: list[str]) -> DataFrame:
    """All lines of the keys that occur more than once."""
    twice = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    return lines.join(twice, keys, "left_semi")


def large_keys(lines: DataFrame, keys: list[str], limit: int = LARGE_KEYS, floor: int = LARGE_FLOOR) -> DataFrame:
    """Keys that hold more than 1/limit of the lines; fewer than ``limit`` of them."""
    share = lines.agg((F.count(F.lit(1)) / limit).alias("share"))
    counts = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") > floor) & (F.col("n") > share.scalar())).select(*keys)


def cut_large(
    lines: DataFrame, keys: list[str], order: list[Column], limit: int = LARGE_KEYS, floor: int = LARGE_FLOOR
) -> DataFrame:
    """Lines with ``is_large`` and ``cut``: the place of the slice of a large key's lines, null for all other keys.

    The lines of large keys are dealt out by ranges of key and whole order, whose bounds Spark draws from the lines
    themselves; so a slice has a partition's share of them, however the order is spread. They are written, so that
    every later step sees the same slices.
    """
    large = large_keys(lines, keys, limit, floor).withColumn("is_large", F.lit(True))
    if large.isEmpty():
        return lines.withColumns({"is_large": F.lit(None).cast("boolean"), "cut": F.lit(None).cast("int")})
    on_keys = [lines[k].eqNullSafe(large[k]) for k in keys]
    marked = lines.join(F.broadcast(large), on_keys, "left").select(lines["*"], "is_large")
    path = scratch_path(lines.sparkSession, "slices")
    cut = marked.where("is_large").repartitionByRange(*map(F.col, keys), *order).withColumn("cut", F.spark_partition_id())
    cut.write.parquet(path)
    rest = marked.where("is_large is null").withColumn("cut", F.lit(None).cast("int"))
    return rest.unionByName(lines.sparkSession.read.schema(cut.schema).parquet(path))


def add_slice_figures(sliced: DataFrame, figures: DataFrame, keys: list[str], cuts: list[str]) -> DataFrame:
    """Bring figures of whole slices back to their lines; lines of small keys get nulls."""
    same = [sliced[c].eqNullSafe(figures[c]) for c in [*keys, *cuts]]
    extra = [figures[c] for c in figures.columns if c not in (*keys, *cuts)]
    return sliced.join(figures, same, "left").select(sliced["*"], *extra)


def slices_before(keys: list[str], cuts: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*cuts).rowsBetween(Window.unboundedPreceding, -1)


def ranked(
    lines: DataFrame, keys: list[str], order: list[str], out: str, limit: int = LARGE_KEYS, floor: int = LARGE_FLOOR
) -> DataFrame:
    """Exact row number per key in ``order``. The rank in a slice of a large key is the rank inside it plus the number
    of lines in earlier slices."""
    sliced = cut_large(lines, keys, [F.col(c) for c in order], limit, floor)
    counts = sliced.where("is_large").groupBy(*keys, "cut").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(*keys, "cut", F.sum("n").over(slices_before(keys, ["cut"])).alias("lines_before"))
    inside = Window.partitionBy(*keys, "cut").orderBy(*order)
    numbered = sliced.withColumn("rank_inside", F.row_number().over(inside).cast("long"))
    rank = F.col("rank_inside") + F.coalesce("lines_before", F.lit(0))
    return add_slice_figures(numbered, before, keys, ["cut"]).select(*lines.columns, rank.alias(out))


def ranked_values(
    rows: DataFrame, keys: list[str], measure: str, limit: int = LARGE_KEYS, floor: int = LARGE_FLOOR
) -> DataFrame:
    """RANK and DENSE_RANK of each value of a measure per key, largest first, nulls last.

    Equal values are counted before they are ranked, so a slice of a large key is a range of distinct values.
    """
    values = rows.groupBy(*keys, measure).agg(F.count(F.lit(1)).alias("n"))
    falling = F.col(measure).desc_nulls_last()
    sliced = cut_large(values, keys, [falling], limit, floor)
    sums = sliced.where("is_large").groupBy(*keys, "cut").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    earlier = slices_before(keys, ["cut"])
    before = sums.select(
        *keys, "cut", F.sum("n").over(earlier).alias("rows_before"), F.sum("v").over(earlier).alias("values_before")
    )
    inside = Window.partitionBy(*keys, "cut").orderBy(falling)
    larger = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    numbered = sliced.withColumns(
        {"larger_rows": F.coalesce(larger, F.lit(0)), "place": F.row_number().over(inside).cast("long")}
    )
    none = F.lit(0)
    return add_slice_figures(numbered, before, keys, ["cut"]).select(
        *keys,
        measure,
        (F.col("larger_rows") + F.coalesce("rows_before", none) + 1).alias("rank"),
        (F.col("place") + F.coalesce("values_before", none)).alias("dense_rank"),
    )


def neighbours(
    rows: DataFrame, keys: list[str], order: list[str], value: str, limit: int = LARGE_KEYS, floor: int = LARGE_FLOOR
) -> DataFrame:
    """Previous and next value per key in ``order``. At the edge of a slice they come from the next slice."""
    sliced = cut_large(rows, keys, [F.col(c) for c in order], limit, floor)
    at = F.struct(*order)
    edges = sliced.where("is_large").groupBy(*keys, "cut").agg(
        F.min_by(F.struct(value), at).alias("head"), F.max_by(F.struct(value), at).alias("tail")
    )
    along = Window.partitionBy(*keys).orderBy("cut")
    edges = edges.select(
        *keys, "cut", F.lag(f"tail.{value}").over(along).alias("edge_before"),
        F.lead(f"head.{value}").over(along).alias("edge_after"),
    )
    inside = Window.partitionBy(*keys, "cut").orderBy(*order)
    marked = sliced.withColumns(
        {
            "previous": F.lag(value).over(inside),
            "next": F.lead(value).over(inside),
            "is_head": F.row_number().over(inside) == 1,
            "is_tail": F.lead(F.lit(1)).over(inside).isNull(),
        }
    )
    return add_slice_figures(marked, edges, keys, ["cut"]).select(
        *rows.columns,
        F.when(F.col("is_head"), F.col("edge_before")).otherwise(F.col("previous")).alias("previous"),
        F.when(F.col("is_tail"), F.col("edge_after")).otherwise(F.col("next")).alias("next"),
    )


def with_group_totals(
    rows: DataFrame, keys: list[str], measure: str, limit: int = LARGE_KEYS, floor: int = LARGE_FLOOR
) -> DataFrame:
    """SUM and AVG over the group of each row: summed per group, then joined back, so that no group is one task's work.

    The totals of large groups, of which there are few, go to the rows; only rows of other groups move by their key.
    """
    summed = rows.groupBy(*keys).agg(
        F.sum(measure).alias("group_total"), F.avg(F.col(measure).cast("double")).alias("group_mean"), F.count(F.lit(1)).alias("_n")
    )
    path = scratch_path(rows.sparkSession, "totals")
    summed.write.parquet(path)
    known = lambda: rows.sparkSession.read.schema(summed.schema).parquet(path)
    least = max(floor, (known().agg(F.sum("_n")).first()[0] or 0) / limit)
    large, small = known().where(F.col("_n") > least).drop("_n"), known().where(F.col("_n") <= least).drop("_n")
    if large.isEmpty():
        return joined_on(rows, small, keys)
    few = joined_on(rows, F.broadcast(large), keys)
    if small.isEmpty():
        return few
    rest = rows.join(F.broadcast(large), reduce(Column.__and__, [rows[k].eqNullSafe(large[k]) for k in keys]), "left_anti")
    return few.unionByName(joined_on(rest, small, keys))


def joined_on(rows: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the figures of their keys; a null key finds the figures of the null key."""
    same = [rows[k].eqNullSafe(figures[k]) for k in keys]
    return rows.join(figures, same).select(rows["*"], *[figures[c] for c in figures.columns if c not in keys])


#: Values that are few enough to be sorted in one place, and how exactly pivots are drawn from the sketch of the values.
FEW, ACCURACY, MARGIN = 100_000, 10_000, 3e-4


def middle_values(rows: DataFrame, size: int, places: tuple[int, int]) -> tuple:
    """The values at two neighbouring places (from 0) of the order of column ``v``, which holds neither nulls nor NaN.

    A sketch of the values gives a pivot on either side of both places; one pass counts the values below and at the
    pivots. If that does not settle both places, the search goes on between the pivots, or wider if they missed.
    """
    (low, high), v, margin = places, F.col("v"), MARGIN
    while size > FEW:
        at = [max(0.0, low / size - margin), min(1.0, (high + 1) / size + margin)]
        a, b = rows.agg(F.percentile_approx("v", at, ACCURACY)).first()[0]
        below_a, upto_a, below_b, upto_b = rows.agg(*map(F.count_if, (v < a, v <= a, v < b, v <= b))).first()
        if not (below_a <= low and high < upto_b):
            margin *= 4
            continue
        if low < upto_a:
            if high < upto_a:
                return a, a
            return a, (b if high >= below_b else rows.where(v > a).agg(F.min("v")).first()[0])
        if high >= below_b:
            return (b if low >= below_b else rows.where(v < b).agg(F.max("v")).first()[0]), b
        rows, size, low, high = rows.where((v > a) & (v < b)), below_b - upto_a, low - upto_a, high - upto_a
    ordered = rows.agg(F.sort_array(F.collect_list("v")).alias("v"))
    return tuple(ordered.select(F.get("v", F.lit(low)).alias("low"), F.get("v", F.lit(high)).alias("high")).first())


def exact_median(rows: DataFrame, column: str) -> Column:
    """The exact median of a column as a literal: the middle value, or the mean of the two.

    Nulls do not count; infinities are ordinary values, and NaN is larger than any of them.
    """
    values = rows.select(F.col(column).alias("v")).where("v is not null")
    fractional = isinstance(values.schema["v"].dataType, (T.FloatType, T.DoubleType))
    n, numbers = values.agg(F.count(F.lit(1)), F.count_if(~F.isnan("v")) if fractional else F.count(F.lit(1))).first()
    if not n:
        return F.lit(None)
    places = ((n - 1) // 2, n // 2)
    if places[1] >= numbers:
        return F.lit(float("nan"))
    lower, upper = middle_values(values.where(~F.isnan("v")) if numbers < n else values, numbers, places)
    return (F.lit(lower) + F.lit(upper)) / 2


def count_per(lines: DataFrame, keys: list[str], out: str) -> DataFrame:
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def distinct_count(value: str | Column) -> Column:
    """Distinct values of a column with few values (regimes, institutions), in one aggregation pass."""
    return F.size(F.collect_set(value)).cast("long")
