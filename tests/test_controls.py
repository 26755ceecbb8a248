"""Acceptance cases of matching, listing groups, campaigns and comparisons."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from helpers import by, counts, declared, pay
from paywarden.functions.filters import FilterRule, retained
from paywarden.operators import campaign as cp, compare as cm, listing as ls, matching as mt


def union(*frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- matching ------------------------------------------------------------------------


def test_one_status_per_line(spark):
    lines = pay(spark, [("A", "Alpha", 10), ("B", "Beta", 10), ("B", "Beta", 10), ("C", "Gamma", 10)])
    results = mt.matching(lines, declared(spark, [("A", "Alpha"), ("B", "Beta")]))
    assert counts(results) == {"OK_BY_ID": 2, "DUPLICATE_ID": 1, "PAID_NOT_DECLARED": 1}
    assert results.count() == lines.count()


def test_spellings_of_a_missing_id(spark):
    lines = pay(spark, [("NU", "a", 1), ("N.U", "b", 1), ("nu", "c", 1), ("nU", "d", 1)])
    assert counts(mt.matching(lines, declared(spark, [("X", "Other")]))) == {"MISSING_ID": 4, "DECLARED_NOT_PAID": 1}


def test_name_fallback_method_and_score(spark):
    lines = pay(spark, [("A", "Alpha", 1), ("NU", "Béta", 1), ("Q", "Gamma", 1), ("R", "Delta", 1)])
    people = declared(spark, [("A", "Alpha"), ("B", "Beta"), ("C", "gamma")])
    results = mt.matching(lines, people)
    methods = sorted((r.method, r.score, r.status) for r in results.collect())
    assert methods == [("ID", 1.0, "OK_BY_ID"), ("NAME", 0.8, "OK_BY_NAME"), ("NAME", 0.8, "OK_BY_NAME"),
                       ("NONE", 0.0, "PAID_NOT_DECLARED")]


def test_second_declaration_of_a_paid_person_stays_unpaid(spark):
    results = mt.matching(pay(spark, [("A", "Alpha", 1)]), declared(spark, [("A", "Alpha"), ("A", "Alpha")]))
    assert counts(results) == {"OK_BY_ID": 1, "DECLARED_NOT_PAID": 1}


def test_duplicate_line_still_uses_its_declaration(spark):
    results = mt.classify(pay(spark, [("A", "Alpha", 1), ("A", "Alpha", 1)]), declared(spark, [("A", "Alpha")]))
    assert {(r.status, r.method) for r in results.collect()} == {("OK_BY_ID", "ID"), ("DUPLICATE_ID", "ID")}


def test_scopes_do_not_mix(spark):
    lines = union(pay(spark, [("A", "Alpha", 1)]), pay(spark, [("A", "Alpha", 1)], "E2", regime="FARDC"))
    results = mt.matching(lines, declared(spark, [("A", "Alpha")]))
    assert by(results, "regime", "status") == {"PNC": "OK_BY_ID", "FARDC": "PAID_NOT_DECLARED"}


def test_filter_comes_before_matching(spark):
    columns = ("Matricule", "NomPostnom", "Base", "Section")
    lines = pay(spark, [("A", "Alpha", 1, "KEEP"), ("B", "Beta", 1, "DROP")], columns=columns)
    rules = [FilterRule("section", "=", "KEEP", institution_id="I1", regime="PNC")]
    results = mt.matching(lines.where(retained(rules)), declared(spark, [("A", "Alpha"), ("B", "Beta")]))
    assert counts(results) == {"OK_BY_ID": 1, "DECLARED_NOT_PAID": 1}


def test_imports_with_equal_row_numbers_give_the_same_result_in_any_order(spark):
    lines = union(*[pay(spark, [("A", f"Name {e}", i)], e) for i, e in enumerate(("E3", "E1", "E2"))])
    first = {r.line_id for r in mt.classify(lines, declared(spark, [("A", "x")])).where("first_line").collect()}
    again = mt.classify(lines.orderBy(F.rand(7)).repartition(3), declared(spark, [("A", "x")]))
    assert {r.line_id for r in again.where("first_line").collect()} == first
    assert first == {r.line_id for r in lines.where("execution_id = 'E1'").collect()}


# --- listing group -------------------------------------------------------------------


def test_listing_group(spark):
    lines = union(
        pay(spark, [("A1", "Alpha", 100), ("D1", "Delta", 10), ("D1", "Delta", 20), ("NU", "Nobody", 5)], "E1"),
        pay(spark, [("A1", "Alpha", 50), ("U1", "Unique", 70)], "E2", institution_id="I2", regime="FARDC"),
    )
    results = ls.listing_group(lines)
    assert counts(results) == {"SEVERAL_REGIMES": 2, "DUPLICATE_ID": 2, "UNUSABLE_ID": 1, "UNIQUE": 1}
    ranks = {(r.staff_key, r.regime): r.occurrence_rank for r in results.where("staff_key = 'A1'").collect()}
    assert ranks == {("A1", "FARDC"): 1, ("A1", "PNC"): 2}
    summary = {(r.regime, r.status): r.row_count for r in ls.status_summary(results, ["regime"]).collect()}
    assert summary[("FARDC", "UNIQUE")] == 1 and summary[("PNC", "DUPLICATE_ID")] == 2


def test_institutions_names_and_people(spark):
    lines = union(
        pay(spark, [("A", "Alpha", 1), ("B", "Same", 1)], "E1"),
        pay(spark, [("A", "Alpha", 1), ("C", "Same", 1), ("", "", 1), ("NU", "", 1)], "E2", institution_id="I2"),
    )
    results = ls.listing_group(lines)
    assert counts(results) == {"SEVERAL_INSTITUTIONS": 2, "DUPLICATE_NAME": 2, "UNUSABLE_ID": 2}
    names = spark.createDataFrame([("I1", "One"), ("I2", "Two")], "institution_id string, official_name string")
    people = {r.person: (r.row_count, r.institutions) for r in ls.unique_people(results, names).collect()}
    assert people == {"M:A": (2, "One, Two"), "M:B": (1, "One"), "M:C": (1, "Two"), "N:": (2, "Two")}
    # A missing-identifier mark counts as one person, a blank identifier without name as its line.
    assert ls.status_summary(results).where("status = 'UNUSABLE_ID'").first().people == 2


# --- campaign ------------------------------------------------------------------------


def campaign_case(spark):
    columns = ("Matricule", "NomPostnom", "Base", "Section")
    base = union(
        pay(spark, [("A1", "Alpha", 100, "KEEP"), ("A2", "Beta", 90, "DROP")], "E1", columns=columns),
        pay(spark, [("A1", "Alpha", 50, "KEEP"), ("Z9", "Zeta", 1, "DROP")], "E2", columns=columns, regime="FARDC"),
    )
    rules = [FilterRule("section", "=", "KEEP", institution_id="I1", regime=r) for r in ("PNC", "FARDC")]
    return declared(spark, [("A1", "Alpha"), ("A2", "Beta")]), cp.analysis_base(base, ["E1", "E2"], rules)


def test_campaign(spark):
    people, base = campaign_case(spark)
    results = cp.campaign(people, base)
    assert counts(results) == {"PAID_IN_SEVERAL_REGIMES": 2, "DECLARED_NOT_PAID": 1}
    impact = {r.paying_regime: float(r.impact) for r in results.collect()}
    assert impact == {"PNC": 0, "FARDC": 50, None: 0}
    with pytest.raises(ValueError):
        cp.analysis_base(base, [])


def test_campaign_name_fallback_needs_no_id_hit_anywhere(spark):
    base = union(pay(spark, [("X1", "Alpha", 1)], "E1"), pay(spark, [("A1", "Other", 1)], "E2", institution_id="I2"))
    results = cp.campaign(declared(spark, [("A1", "Alpha"), ("NU", "Alpha")]), base)
    assert sorted((r.staff_key, r.method, r.paying_institution) for r in results.collect()) == [
        ("A1", "ID", "I2"), ("NU", "NAME", "I1")]


def test_campaign_sums_agree_with_its_payment_lines(spark):
    rows = [(f"K{i % 4}", f"N{i % 3}", i) for i in range(30)] + [("", f"N{i % 5}", i) for i in range(10)]
    base = union(*[pay(spark, rows[i::3], f"E{i}", institution_id=f"I{i % 2}", regime=f"R{i}") for i in range(3)])
    people = declared(spark, [("K0", "N9"), ("K1", "N1"), ("K1", "N2"), ("Q", "N2"), ("", "N4"), ("", ""), ("Q", "N8")],
                      institution_id="I1", regime="R1")
    results, pairs = cp.campaign(people, base), cp.payment_lines(people, base)
    expected = {(r.declared_id, r.paying_execution): (r.n, r.m) for r in pairs.groupBy("declared_id", "paying_execution").agg(
        F.count("*").alias("n"), F.sum("gross_pay").alias("m")).collect()}
    found = {(r.declared_id, r.paying_execution): (r.payments, r.mass) for r in results.where("payments > 0").collect()}
    assert found == expected
    per_person = {r.declared_id: (r.n, r.k) for r in pairs.groupBy("declared_id").agg(
        F.count("*").alias("n"), F.countDistinct("paying_regime").alias("k")).collect()}
    assert {r.declared_id: (r.occurrences, r.regimes) for r in results.where("payments > 0").collect()} == per_person
    assert {r.declared_id for r in results.where("status = 'DECLARED_NOT_PAID'").collect()} == {
        r.declared_id for r in people.collect()} - set(per_person)


# --- comparison ----------------------------------------------------------------------


COLUMNS = ("Matricule", "NomPostnom", "Base", "MontantNet", "Grade")


def sides(spark, a, b):
    return union(pay(spark, a, "E1", columns=COLUMNS, regime="A"), pay(spark, b, "E2", columns=COLUMNS, regime="B"))


def test_presence_financial_and_administrative_classes(spark):
    lines = sides(spark,
                  [("1", "Un", 100, 90, "G1"), ("2", "Deux", 100, 90, "G1"), ("3", "Trois", 100, 90, "G1"), ("4", "Quatre", 100, 90, "G1"), ("9", "Seul", 1, 1, "G1")],
                  [("1", "Un", 100, 90, "G1"), ("2", "Deux", 150, 140, "G1"), ("3", "Trois", 100, 90, "G2"), ("4", "Quatre", 1, 1, "G2"), ("8", "Autre", 1, 1, "G1")])
    results = cm.compare_regimes(lines, cm.Side("A"), cm.Side("B"))
    assert by(results, "match_key", "status") == {
        "M:1": "IDENTICAL", "M:2": "FINANCIAL_GAP", "M:3": "ADMIN_GAP", "M:4": "FINANCIAL_AND_ADMIN_GAP", "M:9": "ONLY_A", "M:8": "ONLY_B"}
    row = cm.compare_summary(results).first()
    assert (row.common, row.only_a, row.only_b, row.financial, row.administrative) == (4, 1, 1, 2, 2)
    assert cm.top_gaps(results, 1).first().match_key == "M:4"


def test_multiple_payment_identity_conflict_and_names(spark):
    lines = sides(spark, [("1", "Un", 1, 1, ""), ("1", "Un", 1, 1, ""), ("2", "Deux", 1, 1, ""), ("5", "Cinq", 1, 1, ""), ("", "", 1, 1, ""), ("NU", "Nom", 1, 1, "")],
                  [("1", "Un", 2, 2, ""), ("2", "Zwei", 1, 1, ""), ("6", "Cinq", 1, 1, ""), ("", "nom", 1, 1, "")])
    results = cm.compare_regimes(lines, cm.Side("A"), cm.Side("B"))
    assert by(results, "match_key", "status") == {
        "M:1": "MULTIPLE_PAYMENT", "M:2": "ID_NAME_CONFLICT", "M:5": "ONLY_A", "M:6": "ONLY_B", "N:NOM": "IDENTICAL"}
    notes = {k: cm.SAME_NAME_MESSAGE in d for k, d in by(results, "match_key", "diagnosis").items()}
    assert notes == {"M:1": False, "M:2": False, "M:5": True, "M:6": True, "N:NOM": False}


def test_thresholds(spark):
    lines = sides(spark, [("1", "Un", 100, 100, ""), ("2", "Deux", 1000, 1000, "")], [("1", "Un", 120, 120, ""), ("2", "Deux", 1030, 1030, "")])
    flagged = lambda t: {r.match_key for r in cm.compare_regimes(lines, cm.Side("A"), cm.Side("B"), t).where("financial_gap").collect()}
    assert flagged(cm.Thresholds()) == {"M:1", "M:2"}
    assert flagged(cm.Thresholds(amount=25)) == {"M:2"}
    assert flagged(cm.Thresholds(percent=10)) == {"M:1"}
    assert flagged(cm.Thresholds(amount=25, percent=10)) == {"M:1", "M:2"}


def test_refused_comparisons(spark):
    lines = sides(spark, [("1", "Un", 1, 1, "")], [("1", "Un", 1, 1, "")])
    for a, b in ((cm.Side("A"), cm.Side("A")), (cm.Side("A"), cm.Side("C"))):
        with pytest.raises(ValueError):
            cm.check_sides(lines, a, b)
    cm.check_sides(lines, cm.Side("A"), cm.Side("B"))


def test_named_institutions_are_compared_across(spark):
    lines = union(pay(spark, [("1", "Un", 1)], "E1"), pay(spark, [("1", "Un", 1)], "E2", institution_id="I2"))
    results = cm.compare_regimes(lines, cm.Side("PNC", "I1"), cm.Side("PNC", "I2"))
    assert counts(results) == {"IDENTICAL": 1}


def test_full_outer_join_agrees_with_the_single_pass(spark):
    lines = sides(spark, [("1", "Un", 1, 1, "a"), ("2", "Deux", 1, 1, "")], [("1", "Un", 2, 2, "b"), ("3", "Drei", 1, 1, "")])
    profile = lambda r: cm.person_profile(lines.where(F.col("regime") == r), ["institution_id"])
    joined = cm.full_outer(profile("A"), profile("B"), ["institution_id"])
    once = cm.both_sides(lines, cm.Side("A"), cm.Side("B"), ["institution_id"]).select(*joined.columns)
    assert joined.exceptAll(once).isEmpty() and once.exceptAll(joined).isEmpty()


def test_a_name_with_very_many_spellings(spark):
    """Spellings are summed per key once more; no window holds all of them."""
    one = pay(spark, [("", "Anonyme", 2)], "E1")
    spelled = F.concat(F.lit("A"), F.col("n").cast("string"), F.lit("nonyme"))
    base = one.crossJoin(spark.range(100_000).withColumnRenamed("id", "n")).withColumns({
        "last_name": spelled, "line_id": F.col("n").cast("string"), "source_row": F.col("n"),
        "regime": F.when(F.col("n") % 5 == 0, "FARDC").otherwise("PNC"), "execution_id": F.when(F.col("n") % 5 == 0, "E2").otherwise("E1"),
    }).drop("n")
    people = cp.unique_people(declared(spark, [("NU", "Anonyme"), ("A", "Other")]), base, spark.createDataFrame([], "institution_id string, official_name string"))
    plan = cp.paying_sources(base, "name_key", [], ["last_name"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    found = people.where("mass > 0").agg(F.count("*").alias("n"), F.min("occurrences").alias("o"), F.sum("mass").alias("m"), F.sum("impact").alias("i"))
    assert tuple(map(int, found.first())) == (100_000, 100_000, 200_000, 40_000)
    assert people.count() == 100_001


def test_details_share_the_figures_of_their_key(spark):
    columns = ("Matricule", "NomPostnom", "Base", "Section")
    rows = [(f"A{i % 3}", "Alpha", i, f"S{i % 4}") for i in range(24)]
    base = union(pay(spark, rows, "E1", columns=columns), pay(spark, rows[:9], "E2", columns=columns, regime="FARDC"))
    keys = ["staff_key", "quarter", "year", "paying_institution", "paying_regime", "paying_execution", "formula_id", "occurrences", "regimes"]
    sums = [F.sum(c).alias(c) for c in ("payments", "mass", "outside_impact")]
    whole, parts = cp.paying_sources(base, "staff_key"), cp.paying_sources(base, "staff_key", [], ["section"])
    assert sorted(map(str, parts.groupBy(*keys).agg(*sums).collect())) == sorted(map(str, whole.groupBy(*keys).agg(*sums).collect()))


def test_declarations_of_one_name_meet_its_sources_once(spark, monkeypatch):
    """Many declarations without identifier share a name: the campaign sees the name once per scope."""
    rows = [("", "Anonyme", i + 1) for i in range(12)]
    base = reduce(lambda a, b: a.unionByName(b), [pay(spark, rows, f"E{i}", regime=f"R{i}") for i in range(5)])
    seen, original = [], cp.campaign
    monkeypatch.setattr(cp, "campaign", lambda *a, **k: seen.append(original(*a, **k)) or seen[-1])
    names = spark.createDataFrame([], "institution_id string, official_name string")
    many = declared(spark, [("NU", "Anonyme")] * 40 + [("A", "Other")]).withColumn("declared_id", F.concat(F.lit("D"), F.monotonically_increasing_id().cast("string")))
    got = cp.unique_people(many, base, names).collect()
    assert len(got) == 41 and sum(frame.count() for frame in seen) <= 6
    paid = [r for r in got if r["mass"] > 0]
    assert len(paid) == 40 and {(r["occurrences"], int(r["mass"]), r["regimes"]) for r in paid} == {(60, 390, "R0, R1, R2, R3, R4")}
