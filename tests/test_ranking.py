"""Ranks, medians and joins where one key holds a third of all rows."""

import random
import statistics

import pytest
from pyspark.sql import Window as W, functions as F

from paywarden.operators import explore as xp, matching as mt, ranking as rk

LARGE = dict(limit=10, floor=50)


@pytest.fixture(scope="module")
def lines(spark):
    """20 000 lines; key 0 holds a third of them."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997)
    return spark.range(20_000).select(
        key.alias("key"), F.col("id").alias("source_row"), (F.col("id") * 7919 % 4).alias("group"),
        (F.col("id") * 31 % 211).cast("double").alias("amount"),
    ).cache()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("sizes", [LARGE, {}], ids=["cut", "whole"])
def test_rank(lines, sizes):
    got = rk.ranked(lines, ["key"], ["group", "source_row"], "place", **sizes)
    window = W.partitionBy("key").orderBy("group", "source_row")
    assert same(got, lines.withColumn("place", F.row_number().over(window).cast("long")))


@pytest.mark.parametrize("sizes", [LARGE, {}], ids=["cut", "whole"])
def test_rank_and_dense_rank_of_values(lines, sizes):
    got = lines.join(rk.ranked_values(lines, ["key"], "amount", **sizes), ["key", "amount"])
    window = W.partitionBy("key").orderBy(F.col("amount").desc())
    places = {"rank": F.rank().over(window).cast("long"), "dense_rank": F.dense_rank().over(window).cast("long")}
    assert same(got.select(*lines.columns, "rank", "dense_rank"), lines.withColumns(places))


@pytest.mark.parametrize("sizes", [LARGE, {}], ids=["cut", "whole"])
def test_neighbours(lines, sizes):
    got = rk.neighbours(lines, ["key"], ["source_row"], "amount", **sizes)
    window = W.partitionBy("key").orderBy("source_row")
    assert same(got, lines.withColumns({"previous": F.lag("amount").over(window), "next": F.lead("amount").over(window)}))


def test_slices_of_a_key_whose_numbers_restart(spark, conf):
    """One key from 40 imports with the same row numbers: the slices share its lines, the ranks are those of the window."""
    conf(spark__sql__shuffle__partitions="12", spark__sql__adaptive__coalescePartitions__enabled="false")
    order = ["source_row", "execution_id"]
    lines = spark.range(20_000).select(
        F.lit(1).alias("key"), (F.col("id") % 500).alias("source_row"), F.floor(F.col("id") / 500).alias("execution_id"))
    sizes = [r["count"] for r in rk.cut_large(lines, ["key"], [F.col(c) for c in order], **LARGE).groupBy("cut").count().collect()]
    assert len(sizes) > 6 and max(sizes) < 20_000 / 4
    window = W.partitionBy("key").orderBy(*order)
    got = rk.ranked(lines, ["key"], order, "place", **LARGE)
    assert same(got, lines.withColumn("place", F.row_number().over(window).cast("long")))


def test_null_keys_and_measures_are_ranked(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, None), ("a", None), ("a", 2.0), ("a", 2.0)], "key string, amount double")
    window = W.partitionBy("key").orderBy(F.col("amount").desc_nulls_last())
    expected = rows.withColumns({"rank": F.rank().over(window).cast("long"), "dense_rank": F.dense_rank().over(window).cast("long")})
    got = rk.joined_on(rows, rk.ranked_values(rows, ["key"], "amount"), ["key", "amount"])
    assert same(got.select(*expected.columns), expected)
    sums = W.partitionBy("key")
    totals = rows.withColumns({"group_total": F.sum("amount").over(sums), "group_mean": F.avg("amount").over(sums)})
    assert same(rk.with_group_totals(rows, ["key"], "amount").select(*totals.columns), totals)


def test_large_keys_are_few_whatever_the_data(lines):
    assert [r.key for r in rk.large_keys(lines, ["key"], limit=10, floor=50).collect()] == [0]
    assert rk.large_keys(lines, ["source_row"], limit=10, floor=0).count() < 10


def test_first_flags_and_repeats(lines):
    order = ["source_row"]
    firsts = rk.flag_first(lines, ["key"], order, identity=["source_row"])
    window = W.partitionBy("key").orderBy("source_row")
    assert same(firsts.select(*lines.columns, "first_line"), lines.withColumn("first_line", F.row_number().over(window) == 1))
    assert rk.first_by(lines, ["key"], order).count() == lines.select("key").distinct().count()
    assert rk.repeated(lines, ["key"]).count() == 20_000


def test_group_totals(lines):
    window = W.partitionBy("key")
    expected = lines.withColumns({"group_total": F.sum("amount").over(window), "group_mean": F.avg("amount").over(window)})
    assert same(rk.with_group_totals(lines, ["key"], "amount").select(*expected.columns), expected)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 2000, 30_000])
def test_exact_median(spark, n):
    values = [random.Random(n + i).randint(0, n) * (1.5 if i % 3 else 1e6) for i in range(n)]
    profile = xp.numeric_profile(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v").first()
    assert (profile.n, profile["median"]) == (n, statistics.median(values))


def in_doubles(values):
    """Median with nulls left out and NaN above everything."""
    ordered = sorted((v for v in values if v is not None), key=lambda v: (v != v, v if v == v else 0))
    return (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("values", [
    [1.0] * 500 + [2.0] * 500, [1.0] * 501 + [2.0] * 500, [float(i % 7) for i in range(999)], [float(-i * i) for i in range(1000)],
    [5.0] * 300 + [float(i) for i in range(2000)], [1e300 * i for i in range(301)] + [1e-300 * i for i in range(300)],
    [NAN] + [float(i) for i in range(2000)], [INF, -INF, NAN, None] * 3 + [float(i) for i in range(999)],
    [NAN] * 600 + [1.0] * 300, [NAN] * 300 + [1.0] * 301, [-INF] * 700 + [INF] * 701, [1.0, 3.0], [NAN],
], ids=range(13))
def test_median_by_pivots(spark, monkeypatch, values):
    monkeypatch.setattr(rk, "FEW", 20)
    random.Random(1).shuffle(values)
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got, expected = rows.agg(rk.exact_median(rows, "v").alias("m")).first().m, in_doubles(values)
    assert got == expected or (got != got and expected != expected)


def test_median_of_money(spark, monkeypatch):
    monkeypatch.setattr(rk, "FEW", 20)
    rows = spark.range(3001).select((F.col("id") * 1000003 % 3001 / 100).cast("decimal(18,2)").alias("v"))
    assert float(rows.agg(rk.exact_median(rows, "v").alias("m")).first().m) == 15.0


@pytest.mark.parametrize("offset, limit", [(0, 10), (7, 500), (990, 30), (999, 1), (1000, 5), (500, 0), (333, 334)])
def test_pages_by_the_index_of_ranges(spark, conf, offset, limit):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    rows = spark.range(1000).select((F.col("id") * 7919 % 100).alias("a"), "id").repartition(6)
    index = xp.page_index(rows, ["a", "id"])
    expected = [tuple(r) for r in rows.orderBy("a", "id").collect()][offset:offset + limit]
    page = index.page(limit, offset)
    assert [tuple(r) for r in page.collect()] == expected
    assert len(index.starts) > 1 and sum(n for _, _, n in index.starts) == 1000
    if offset >= 500 and limit:
        assert f"Offset {offset}" not in page._jdf.queryExecution().optimizedPlan().toString()
    assert xp.page_index(rows.limit(0), ["id"]).page(5, 0).collect() == []


def test_self_join_and_homonyms_are_counted_without_pairs(spark):
    rows = [("1", "ann", "A"), ("2", " Ann", "B"), ("3", "bob", "A"), ("4", "ANN", "A"), ("5", "eve", "E")]
    people = spark.createDataFrame(rows, "id string, name string, person string")
    assert {r.id: r.partners for r in xp.with_partners(people, "person").collect()} == {"1": 2, "3": 2, "4": 2}
    found = {(r.name, r.person): (r.row_count, r.other_rows) for r in xp.same_name_other_id(people, people, "name", "person").collect()}
    assert found == {("ANN", "A"): (2, 1), ("ANN", "B"): (1, 2)}


def skewed_lines(spark, n):
    """Half of the lines share one usable identifier, a third has none."""
    key = F.when(F.col("id") % 2 == 0, "HOT").when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("K"), F.col("id")))
    return spark.range(n).select(
        F.col("id").cast("string").alias("line_id"), F.col("id").alias("source_row"), F.lit("E").alias("execution_id"),
        F.lit("I").alias("institution_id"), F.lit("R").alias("regime"), F.lit("T1").alias("quarter"), F.lit(2024).alias("year"),
        key.alias("staff_key"), F.concat(F.lit("N"), F.col("id") % 5000).alias("name_key"), F.sha2(F.col("id").cast("string"), 512).alias("pad"),
    )


def test_a_hot_identifier_is_split_by_the_join(spark, conf, tmp_path):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="400KB", spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="200KB", spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="16",
    )
    path = str(tmp_path / "lines")
    skewed_lines(spark, 120_000).repartition(16).write.parquet(path)
    lines = spark.read.parquet(path)
    declared = lines.where("staff_key in ('HOT', 'K1')").groupBy("institution_id", "regime", "quarter", "year", "staff_key").agg(
        F.min("name_key").alias("name_key")).withColumn("declared_id", F.concat(F.lit("D"), "staff_key"))
    linked = mt.link(lines, declared)
    found = linked.groupBy("id_match").agg(F.count("*").alias("n"), F.count_if("first_line").alias("firsts"), F.max("pad")).collect()
    assert {r.id_match: (r.n, r.firsts) for r in found}["DHOT"] == (60_000, 1)
    run = linked.groupBy("id_match").agg(F.max("pad"))
    run.collect()
    assert "skew=true" in run._jdf.queryExecution().executedPlan().toString()
    # Lines without identifier are spread over all tasks of that join.
    keyed = mt.with_spread_keys(lines).where("staff_key = ''")
    assert keyed.select("id_join").distinct().count() == keyed.count()


def test_totals_of_large_groups_go_to_the_rows(lines):
    """Rows of large groups do not move by their key; small groups and null keys still meet their totals."""
    mixed = lines.withColumn("key", F.when(F.col("source_row") % 100 == 0, None).when(F.col("key") != 0, F.col("key") + 1).otherwise(F.col("key")))
    window = W.partitionBy("key")
    expected = mixed.withColumns({"group_total": F.sum("amount").over(window), "group_mean": F.avg("amount").over(window)})
    got = rk.with_group_totals(mixed, ["key"], "amount", **LARGE)
    assert same(got.select(*expected.columns), expected)
    one = lines.withColumn("key", F.col("source_row") % 2)
    plan = rk.with_group_totals(one, ["key"], "amount", **LARGE)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
