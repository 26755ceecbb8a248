import pytest
from pyspark.sql import functions as F

from paywarden.functions import filters as fl
from paywarden.functions.filters import Condition, FilterRule


@pytest.fixture(scope="module")
def rows(spark):
    layout = "line_id string, institution_id string, regime string, category string, gross_pay decimal(18,2)"
    data = [("1", "A", "R", "Keep", 10), ("2", "A", "R", "drop", 20), ("3", "A", "R", None, 30), ("4", "B", "R", "x_y", 40)]
    return spark.createDataFrame(data, layout.replace("decimal(18,2)", "int")).withColumn(
        "gross_pay", F.col("gross_pay").cast("decimal(18,2)")
    )


def ids(rows, predicate):
    return {r.line_id for r in rows.where(predicate).collect()}


def test_operators(rows):
    assert ids(rows, fl.condition(Condition("category", "=", "Keep"))) == {"1"}
    assert ids(rows, fl.condition(Condition("category", "!=", "Keep"))) == {"2", "4"}
    assert ids(rows, fl.condition(Condition("category", "contains", "EE"))) == {"1"}
    assert ids(rows, fl.condition(Condition("category", "prefix", "x_"))) == {"4"}
    assert ids(rows, fl.condition(Condition("gross_pay", ">", "1 9,5"))) == {"2", "3", "4"}
    assert ids(rows, fl.condition(Condition("category", ">=", "drop"))) == {"2", "4"}


def test_refused_conditions():
    for bad in (Condition("line_id", "=", "1"), Condition("category", "~", "1"), Condition("category", "=", " "),
                Condition("gross_pay", ">", "many")):
        with pytest.raises(ValueError):
            fl.condition(bad)


def test_rules_apply_to_their_own_scope_and_drop_unknown(rows):
    rules = [FilterRule("category", "!=", "drop", institution_id="A", regime="R")]
    assert ids(rows, fl.retained(rules)) == {"1", "4"}
    # Neither kept nor left out: the empty category is unknown.
    assert ids(rows, ~fl.own_predicate(rules)) == {"2"}
    assert ids(rows, fl.retained([])) == {"1", "2", "3", "4"}


def test_explore(rows):
    assert ids(rows, fl.explore("category", "empty")) == {"3"}
    assert ids(rows, fl.explore("category", "not empty")) == {"1", "2", "4"}
    assert ids(rows, fl.explore("gross_pay", ">=", "30")) == {"3", "4"}
    assert ids(rows, fl.explore("gross_pay", ">=", "no number")) == set()
    assert ids(rows, fl.explore("category", "prefix", "KE")) == {"1"}
    with pytest.raises(ValueError):
        fl.explore("category", "like", "x")


def test_scope_filter_prunes_partitions(spark, tmp_path):
    lines = spark.range(20).select(F.col("id").alias("line_id"), F.concat(F.lit("I"), F.col("id") % 2).alias("institution_id"),
                                   F.lit("R").alias("regime"), F.lit("T1").alias("quarter"), (2000 + F.col("id") % 3).cast("int").alias("year"))
    path = str(tmp_path / "t")
    lines.write.partitionBy("institution_id", "regime", "quarter", "year").parquet(path)
    found = spark.read.parquet(path).where(fl.in_scope("I1", year=2001))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(institution_id" in plan and found.count() == lines.where(fl.in_scope("I1", year=2001)).count()
