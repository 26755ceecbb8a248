from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import by, counts, declared, pay
from paywarden.functions import formulas as fx
from paywarden.operators import matching as mt
from paywarden.plans.views import FORMULAS
from paywarden.schema import Mode, Rubric


def scopes(spark, rows):
    return spark.createDataFrame(rows, "institution_id string, regime string, quarter string, year int")


def test_resolution_worked_by_hand(spark):
    rows = scopes(spark, [("IF", "R1", "T4", 1998), ("IO", "R1", "T4", 1998), ("IO", "R1", "T1", 1996),
                          ("IO", "R4", "T1", 2001), ("IO", "R5", "T1", 1995)])
    found = fx.resolve_table(rows, FORMULAS, [Rubric.PAID_NOT_DECLARED])
    assert {(r.institution_id, r.regime, r.year): r.formula_id for r in found.collect()} == {
        ("IF", "R1", 1998): "f4", ("IO", "R1", 1998): "f2", ("IO", "R1", 1996): "f1", ("IO", "R4", 2001): "DEFAULT",
        ("IO", "R5", 1995): "DEFAULT"}


def test_precedence_of_institution_over_exact_rubric_and_of_later_start(spark):
    rows = scopes(spark, [("A", "R", "T1", 2024), ("B", "R", "T1", 2024), ("A", "R", "T4", 2022)])
    own_any = fx.Formula("own", institution_id="A", regime="R", year=2023, terms=(("BASE_PAY", 1),))
    exact = fx.Formula("exact", Rubric.OK_BY_ID, regime="R", year=2020, terms=(("BASE_PAY", 1),))
    later = replace(exact, formula_id="later", quarter="T3", year=2022)
    found = fx.resolve_table(rows, [exact, own_any, later], [Rubric.OK_BY_ID])
    assert {(r.institution_id, r.quarter): r.formula_id for r in found.collect()} == {
        ("A", "T1"): "own", ("B", "T1"): "later", ("A", "T4"): "later"}


def test_extra_component_and_deductions(spark):
    lines = pay(spark, [("A1", "Alpha", 100, 10, 25)], columns=("Matricule", "NomPostnom", "Base", "Retenue", "PrimeTech"),
                mapping={"PrimeTech": "component_PRIME_TECHNIQUE"})
    formula = fx.Formula("x", regime="PNC", terms=(("BASE_PAY", 1), ("PRIME_TECHNIQUE", 1), ("DEDUCTIONS", -1)))
    valued = fx.with_value(lines.withColumn("formula_id", F.lit("x")), [formula], "v")
    assert float(valued.first().v) == 115


def test_forced_formula_values_impact_but_not_mass(spark):
    lines, people = pay(spark, [("A1", "Alpha", 100)]), declared(spark, [("A1", "Alpha")])
    twice = fx.Formula("twice", regime="PNC", year=2023, terms=(("BASE_PAY", 2),))
    chosen = fx.forced([twice], "twice", "I1", "PNC", "T1", 2024)
    row = mt.matching(lines, people, [], forced=chosen).first()
    assert (float(row.impact), float(row.mass), row.formula_id) == (200, 100, "twice")
    for quarter, year, regime in (("T4", 2022, "PNC"), ("T1", 2024, "FARDC")):
        with pytest.raises(ValueError):
            fx.forced([twice], "twice", "I1", regime, quarter, year)


def test_modes_count_first_or_further_lines(spark):
    lines = pay(spark, [("B", "Beta", 10), ("B", "Beta", 20), ("NU", "x", 1), ("N.U", "y", 2), ("", "z", 4)])
    people = declared(spark, [("Z", "Nobody")])
    extra = fx.Formula("extra", Rubric.DUPLICATE_ID, Mode.EXTRA_LINES, (("BASE_PAY", 1),), regime="PNC")
    once = fx.Formula("once", Rubric.MISSING_ID, Mode.ONE_PER_PERSON, (("BASE_PAY", 1),), regime="PNC")
    paid = mt.matching(lines, people, [extra, once]).where("line_id is not null")
    totals = {r.status: float(r.x) for r in paid.groupBy("status").agg(F.sum("impact").alias("x")).collect()}
    # One NU line and one blank line count; the second NU line is not the first of its key.
    assert totals == {"DUPLICATE_ID": 20, "MISSING_ID": 5, "PAID_NOT_DECLARED": 10}
    assert counts(paid) == {"DUPLICATE_ID": 1, "MISSING_ID": 3, "PAID_NOT_DECLARED": 1}


def test_versions_and_validation():
    draft = fx.Formula("a", regime="R", name="n", terms=(("base_pay", 1), ("BONUS", 0)))
    first = fx.new_version([], draft)
    assert first.version == 1 and first.terms == (("BASE_PAY", 1),)
    assert fx.new_version([first], replace(draft, formula_id="b")).version == 2
    assert fx.new_version([first], replace(draft, institution_id="I")).version == 1
    for bad in (replace(draft, name=" "), replace(draft, rubric="?"), replace(draft, mode="?"), replace(draft, quarter="T5"),
                replace(draft, terms=(("UNKNOWN", 1),)), replace(draft, terms=(("BASE_PAY", 1001),)), replace(draft, terms=())):
        with pytest.raises(ValueError):
            fx.new_version([], bad)
    assert fx.new_version([], replace(draft, terms=(), mode=Mode.NO_IMPACT)).terms == ()


def test_catalogue_and_text(spark):
    catalogue = by(fx.component_catalog(spark, {"tech": "Technical"}), "code", "built_in")
    assert catalogue["GROSS_PAY"] and not catalogue["TECH"] and len(catalogue) == 10
    assert fx.describe(fx.Formula("x", terms=(("BASE_PAY", 2), ("DEDUCTIONS", -1)))) == "2 × BASE_PAY + -1 × DEDUCTIONS"


def test_quotes_in_formula_ids_are_text(spark):
    odd = fx.Formula("it's \\ odd", regime="PNC", terms=(("BASE_PAY", 1),))
    lines = pay(spark, [("A", "B", 5)])
    assert lines.select(fx.resolve_id([odd], "*").alias("f")).first().f == "it's \\ odd"
