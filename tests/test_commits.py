"""Tables that change together, deletion by file, and formulas as a table."""

from __future__ import annotations

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from paywarden.functions import formulas as fx
from paywarden.operators import formula_book as fb
from paywarden.schema import Mode, Rubric, SCOPE
from paywarden.sources import lifecycle as lc, writers as wr
from paywarden.sources.commits import Tables

LINES = "declared_id string, execution_id string, institution_id string, regime string, quarter string, year int"


@pytest.fixture
def tables(spark, tmp_path):
    own = Tables(spark, str(tmp_path / "with blank %20"))
    lines = [(f"D{i}", f"V{i % 3}", "I1", "R1", "T1", 2024) for i in range(30)]
    entries = [wr.journal_entry(spark, execution_id=f"V{i}", operation=lc.IMPORT_DECLARED, institution_id="I1", regime="R1", quarter="T1",
                                year=2024, status="DONE", rows_loaded=10) for i in range(3)]
    with own.change() as change:
        change.append("declared", spark.createDataFrame(lines, LINES).repartition(5, "declared_id"))
        change.append("schemas", spark.createDataFrame([(f"V{i}", "Noms") for i in range(3)], "execution_id string, column string"))
        change.append("journal", entries[0].unionByName(entries[1]).unionByName(entries[2]))
    return own


def ids(tables, name="declared"):
    return sorted(r[0] for r in tables.read(name).collect())


def test_a_withdrawal_changes_all_tables_at_once(tables):
    assert lc.withdraw_import(tables, "V1") == 10 and tables.version() == 2
    assert tables.read("declared").where("execution_id = 'V1'").isEmpty() and tables.read("schemas").count() == 2
    latest = wr.current_journal(tables.read("journal")).collect()
    assert {r.execution_id: (r.status, r.message) for r in latest}["V1"] == ("DELETED", "Withdrawn (10 lines)")
    assert tables.read("journal").count() == 4 and tables.read("declared", 1).count() == 30
    with pytest.raises(ValueError, match="already withdrawn"):
        lc.withdraw_import(tables, "V1")


def test_a_used_import_stays(spark, tables):
    results = spark.createDataFrame([("D1", "run"), ("D2", "run")], "declared_id string, run_id string")
    with pytest.raises(ValueError, match="used by"):
        lc.withdraw_import(tables, "V1", results)
    with pytest.raises(ValueError, match="used by"):
        lc.withdraw_import(tables, "V0", None, spark.createDataFrame([("V0",)], "execution_id string"))
    assert tables.version() == 1


@pytest.mark.parametrize("step", ["append", "commit"])
def test_a_failure_in_the_middle_leaves_all_tables_as_they_were(tables, monkeypatch, step):
    from paywarden.sources.commits import Change

    before, journal = ids(tables), tables.read("journal").count()

    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(Change, step, fail)
    with pytest.raises(OSError):
        lc.withdraw_import(tables, "V1")
    monkeypatch.undo()
    assert ids(tables) == before and tables.read("schemas").count() == 3 and tables.read("journal").count() == journal
    assert lc.withdraw_import(tables, "V1") == 10


def test_a_second_writer_is_refused(tables):
    one, two = tables.change(), tables.change()
    one.delete("declared", F.col("declared_id") == "D3")
    two.delete("declared", F.col("declared_id") == "D4")
    assert one.commit() == 2
    with pytest.raises(ValueError, match="meanwhile"):
        two.commit()
    assert "D4" in ids(tables) and "D3" not in ids(tables)


def test_only_files_with_hits_are_rewritten(tables):
    before = tables.manifest()["declared"]["files"]
    with tables.change() as change:
        assert change.delete("declared", F.col("declared_id") == "D7") == 1
        assert change.delete("declared", F.col("declared_id") == "none") == 0
        assert change.delete("declared", F.lit(None).cast("boolean")) == 0
    after = tables.manifest()["declared"]["files"]
    assert len(set(before) & set(after)) == len(before) - 1 and len(ids(tables)) == 29
    with tables.change() as change:
        assert change.delete("declared", F.lit(True)) == 29
    assert ids(tables) == [] and tables.read("declared").columns == [f.split()[0] for f in LINES.split(", ")]
    with tables.change() as change:
        assert change.delete("declared", F.lit(True)) == 0
        with pytest.raises(ValueError, match="columns"):
            change.append("declared", tables.read("schemas"))


def test_a_scope_is_emptied_in_all_its_tables(spark, tables):
    with tables.change() as change:
        change.append("results", spark.createDataFrame([("I1", "R1", "T1", 2024), ("I2", "R1", "T1", 2024)], tables.read("declared").select(*SCOPE).schema))
    assert lc.empty_scope(tables, dict(zip(SCOPE, ("I1", "R1", "T1", 2024)))) == {"results": 1, "declared": 30}
    assert tables.read("results").count() == 1


def test_pay_lines_go_with_their_raw_copies(spark, tmp_path):
    own = Tables(spark, str(tmp_path))
    pay = spark.createDataFrame([(f"L{i}", f"E{i % 2}", "I1", "R1", "T1", 2024 + i % 2) for i in range(8)], LINES.replace("declared_id", "line_id"))
    entry = [wr.journal_entry(spark, execution_id=f"E{i}", operation=lc.IMPORT_PAY, institution_id="I1", regime="R1", quarter="T1", year=2024 + i,
                              status="DONE") for i in range(2)]
    with own.change() as change:
        change.append("pay", pay)
        change.append("raw", pay.select("line_id", "execution_id"))
        change.append("journal", entry[0].unionByName(entry[1]))
    scope = dict(zip(SCOPE, ("I1", "R1", "T1", 2025)))
    with pytest.raises(ValueError, match="used by"):
        lc.withdraw_pay_scope(own, scope, spark.createDataFrame([("L1", "r")], "line_id string, run_id string"))
    assert lc.withdraw_pay_scope(own, scope) == 4
    assert own.read("pay").count() == own.read("raw").count() == 4
    with pytest.raises(ValueError, match="no pay lines"):
        lc.withdraw_pay_scope(own, scope)


def test_formulas_as_a_table_resolve_as_the_list_does(spark):
    rng = random.Random(4)
    formulas = [
        fx.Formula(f"f{i}", rng.choice(Rubric.ALL), rng.choice(Mode.ALL), (("BASE_PAY", rng.randint(-9, 9) / 4), ("EXTRA", 0.0005)),
                   rng.choice([None, "", "I1", "I2", "I3"]), "R1" if i % 2 else "R2", f"T{rng.randint(1, 4)}", rng.randint(2018, 2024), i,
                   active=rng.random() < 0.8, name="n")
        for i in range(400)
    ]
    scopes = [(i, r, f"T{t}", y) for i in ("I1", "I2", "I9") for r in ("R1", "R2", "R3") for t in (1, 3, 4) for y in (2017, 2019, 2023)]
    lines = spark.createDataFrame(
        [(f"l{n}", *s, n * 3, n % 2 == 0, Rubric.ALL[n % 8]) for n, s in enumerate(scopes)],
        "line_id string, institution_id string, regime string, quarter string, year int, pay int, first_line boolean, rubric string",
    ).withColumns({c: F.col("pay").cast("decimal(18,2)") for c in fx.BUILT_IN_COMPONENTS.values()})
    lines = lines.withColumn("extra_components", F.create_map(F.lit("EXTRA"), (F.col("pay") / 100).cast("decimal(18,2)")))
    table = fx.formula_table(spark, [dataclasses.replace(f, institution_id=f.institution_id or None) for f in formulas])
    book = fb.in_force(lines, table)
    assert sorted(book.select(*SCOPE, "rubric", "formula_id").collect()) == sorted(fx.resolve_table(lines, formulas).select(*SCOPE, "rubric", "formula_id").collect())
    for first in (None, "first_line"):
        listed = fx.with_value(lines.withColumn("formula_id", fx.resolve_by(formulas, "rubric", Rubric.ALL)), formulas, "impact", first=first)
        got = fb.valued(lines, book, F.col("rubric"), "impact", first)
        assert sorted(got.select("line_id", "impact_formula_id", "impact").collect()) == sorted(listed.select("line_id", "formula_id", "impact").collect())


def test_the_plan_does_not_grow_with_the_formulas(spark):
    lines = spark.createDataFrame([("I1", "R1", "T1", 2024)], "institution_id string, regime string, quarter string, year int")
    size = lambda n: len(fb.in_force(lines, fx.formula_table(spark, [
        fx.Formula(f"f{i}", institution_id=f"I{i}", regime="R1", version=i) for i in range(n)]))._jdf.queryExecution().optimizedPlan().toString())
    assert size(10_000) < size(10) * 1.2
    assert fb.in_force(lines, fx.formula_table(spark, [])).select("formula_id").distinct().collect() == [("DEFAULT",)]
