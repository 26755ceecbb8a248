import pytest
from pyspark.sql import functions as F

from paywarden.functions.formulas import Formula
from paywarden.operators import annex_totals as at, annexes as ax
from paywarden.plans.views import FORMULAS, RULES, Views
from paywarden.schema import LINE_ORDER, Mode, Rubric, SCOPE

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    v = Views(spark, SMALL)
    return v.pay.cache(), v.declared.cache()


@pytest.fixture(scope="module")
def pack(tables):
    rows = at.pack_summary(*tables, RULES, FORMULAS, keys=[]).collect()
    return {r.annex: (r.row_count, r.people, r.impact) for r in rows}


@pytest.mark.parametrize("annex", ax.ANNEXES, ids=lambda a: a.name)
def test_pack_agrees_with_each_annex(tables, pack, annex):
    rows = ax.annex(annex.name, *tables, RULES, FORMULAS)
    order = ax.DECLARED_ORDER if annex.family == ax.DECLARED else ["source_row", "execution_id", "line_id"]
    single = rows.agg(F.count("*").alias("n"), F.sum("impact").alias("i")).first()
    people = ax.annex_people(rows, annex, order).count()
    assert pack.get(annex.name, (0, 0, None)) == (single.n, people, single.i)


def test_lines_elsewhere_are_outside_the_scope(tables):
    lines, declared = tables
    found = ax.elsewhere(lines, declared, RULES, "staff_key")
    inside = found.where("paying_institution = institution_id and (institution_id <> 'IF' or category = 'BUILDING')")
    assert found.count() > 0 and inside.isEmpty()


def test_present_and_undeclared_split_the_paid_listing(tables, pack):
    lines, _ = tables
    paid = lines.where((F.col("institution_id") != "IF") | (F.col("category") == "BUILDING")).where("gross_pay > 0").count()
    for kind in ("id", "name"):
        assert pack[f"present_{kind}"][0] + pack[f"undeclared_{kind}"][0] == paid


def plain(rows):
    return sorted(map(str, rows.collect()))


#: Every mode on every kind of rubric, with parts of cents to round, for scopes of one and of several institutions.
RANKED = [
    Formula(f"k{i}", rubric, mode, (("BASE_PAY", 0.3337), ("BONUS", -0.005)), institution, regime, "T1", 1995, 1, name="ranked")
    for i, (rubric, mode, institution, regime) in enumerate([
        (Rubric.ANY, Mode.EXTRA_LINES, None, "R1"), (Rubric.ANY, Mode.ONE_PER_PERSON, "IF", "R1"), (Rubric.ANY, Mode.NO_IMPACT, None, "R3"),
        (Rubric.PAID_ELSEWHERE, Mode.ONE_PER_PERSON, None, "R2"), (Rubric.PAID_ELSEWHERE, Mode.EXTRA_LINES, "IO", "R2"),
        (Rubric.OK_BY_ID, Mode.EXTRA_LINES, None, "R2"), (Rubric.OK_BY_NAME, Mode.ONE_PER_PERSON, None, "R4"),
        (Rubric.PAID_NOT_DECLARED, Mode.EXTRA_LINES, None, "R4"), (Rubric.MISSING_ID, Mode.EXTRA_LINES, None, "R5"),
        (Rubric.DUPLICATE_NAME, Mode.EXTRA_LINES, "IP", None), (Rubric.DUPLICATE_ID, Mode.ONE_PER_PERSON, None, None),
    ])
]


@pytest.mark.parametrize("formulas", [FORMULAS, RANKED, []], ids=["given", "ranked", "default"])
def test_sums_without_lines_equal_the_sums_of_the_lines(tables, formulas):
    got = at.pack_summary(*tables, RULES, formulas)
    expected = ax.annex_summary(ax.pack_entries(*tables, RULES, formulas))
    assert plain(got.select(expected.columns)) == plain(expected)


def test_some_annexes_alone(tables):
    names = ["dup_id", "elsewhere_name"]
    got = at.pack_summary(*tables, RULES, RANKED, names)
    assert plain(got) == plain(at.pack_summary(*tables, RULES, RANKED).where(F.col("annex").isin(names)).select(got.columns))


def test_amounts_of_any_size_add_up_exactly(spark, tables):
    lines, declared = tables
    large = F.lit("9999999999999999.99").cast("decimal(18,2)")
    grown = lines.withColumn("base_pay", F.when(F.col("source_row") % 2 == 0, large).otherwise(-large + 1)).withColumn("transport", F.lit(0).cast("decimal(18,2)"))
    grown = grown.withColumn("bonus", F.lit(0).cast("decimal(18,2)"))
    got = at.pack_summary(grown, declared, [], [], ["listing", "dup_name"], keys=[]).collect()
    expected = ax.annex_summary(ax.pack_entries(grown, declared, [], [], ["listing", "dup_name"]), keys=[]).collect()
    assert {r.annex: r.impact for r in got} == {r.annex: r.impact for r in expected}


def test_the_sums_move_rows_per_key_only(tables):
    plan = at.pack_summary(*tables, RULES, FORMULAS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") < 10 and "Generate explode" not in plan


@pytest.mark.parametrize("annex", ax.ANNEXES, ids=lambda a: a.name)
def test_people_of_an_annex(tables, annex):
    rows = ax.annex(annex.name, *tables, RULES, [])
    order = ax.DECLARED_ORDER if annex.family == ax.DECLARED else LINE_ORDER
    expected = ax.annex_people(rows, annex, order).select(*SCOPE, F.lit(annex.name).alias("annex"), "concerned", F.col(order[-1]).alias("line_id"))
    assert plain(at.pack_people(*tables, RULES, [annex.name])) == plain(expected)


def test_lines_without_any_key_are_people_of_their_own(spark):
    lines = [(f"l{i}", "e", "I1", "R1", "T1", 2024, "", "NU" if i % 2 else "", "" if i < 6 else "ANNA", i) for i in range(9)]
    pay = spark.createDataFrame(lines, "line_id string, execution_id string, institution_id string, regime string, quarter string, year int,"
                                       "category string, staff_key string, name_key string, source_row bigint")
    pay = pay.withColumns({c: F.lit(10).cast("decimal(18,2)") for c in ("base_pay", "gross_pay")})
    for part in ("transport", "bonus", "housing", "pension", "other_pay", "deductions", "net_pay"):
        pay = pay.withColumn(part, F.lit(0).cast("decimal(18,2)"))
    pay = pay.withColumn("extra_components", F.lit(None).cast("map<string,decimal(18,2)>"))
    declared = pay.select(F.col("line_id").alias("declared_id"), "execution_id", *SCOPE, "staff_key", "name_key", "source_row").limit(0)
    found = {r.annex: (r.row_count, r.people) for r in at.pack_summary(pay, declared, [], []).collect()}
    assert found["missing_id"] == found["listing"] == (9, 7) and found["undeclared_id"] == (9, 2)
    people = at.pack_people(pay, declared, [], ["missing_id"]).collect()
    assert sorted(r.concerned for r in people) == [f"L:l{i}" for i in range(6)] + ["N:ANNA"]


def test_amounts_of_unranked_rubrics_move_instead_of_what_formulas_read(tables):
    """The value of a line that depends on nothing but the line is taken below the join."""
    plan = ax.annex("undeclared_id", *tables, RULES, FORMULAS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftAnti") < plan.index("AS impact")


def test_standard_tables_are_widened_after_they_move(spark):
    views = Views(spark, SMALL)
    moved = views.source_lines.hint("rebalance", "quarter", "year")
    plan = views.standard_of(views.raw_of(moved))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS staff_key") < plan.index("RebalancePartitions") and len(moved.columns) == 10
