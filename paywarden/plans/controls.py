"""Queries of matching, listing groups, campaigns and regime comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from paywarden.functions import formulas as fx
from paywarden.operators import campaign as cp, compare as cm, formula_book as fb, listing as ls, matching as mt, ranking as rk
from paywarden.plans.formula_sql import FORMULA_SQL, join_formula, value_sql
from paywarden.plans.registry import P, S, query, same_period, same_scope
from paywarden.plans.views import FORMULAS, RULES, Views
from paywarden.schema import LINE_ORDER, Mode, PERIOD, Rubric, SCOPE

USABLE = "staff_key NOT IN ('', 'NU')"
ORDER = "source_row, execution_id, line_id"


def money(expression: str) -> str:
    return f"cast(coalesce({expression}, 0) AS decimal(38,2))"


MATCH_SQL = f"""
by_id AS (SELECT {S}, staff_key, min(declared_id) AS id_match FROM declared WHERE {USABLE} GROUP BY {S}, staff_key),
by_name AS (SELECT {S}, name_key, min(declared_id) AS name_match FROM declared WHERE name_key <> '' GROUP BY {S}, name_key),
linked AS (
  SELECT p.*, i.id_match, n.name_match,
    row_number() OVER (PARTITION BY p.institution_id, p.regime, p.quarter, p.year, p.staff_key
      ORDER BY p.source_row, p.execution_id, p.line_id) AS rn
  FROM pay p
  LEFT JOIN by_id i ON {same_scope('i', 'p')} AND i.staff_key = p.staff_key
  LEFT JOIN by_name n ON {same_scope('n', 'p')} AND n.name_key = p.name_key),
classified AS (
  SELECT *, coalesce(id_match, name_match) AS declared_id,
    CASE WHEN id_match IS NOT NULL THEN 'ID' WHEN name_match IS NOT NULL THEN 'NAME' ELSE 'NONE' END AS method,
    cast(CASE WHEN id_match IS NOT NULL THEN 1.0 WHEN name_match IS NOT NULL THEN 0.8 ELSE 0.0 END AS double) AS score,
    CASE WHEN rn > 1 AND {USABLE} THEN 'DUPLICATE_ID' WHEN id_match IS NOT NULL THEN 'OK_BY_ID'
      WHEN name_match IS NOT NULL THEN 'OK_BY_NAME' WHEN NOT {USABLE} THEN 'MISSING_ID'
      ELSE 'PAID_NOT_DECLARED' END AS status
  FROM linked),
unpaid AS (
  SELECT * FROM declared d WHERE NOT EXISTS (SELECT 1 FROM classified c WHERE c.declared_id = d.declared_id)),
matched AS (
  SELECT c.institution_id, c.regime, c.quarter, c.year, c.line_id, c.declared_id, c.method, c.score, c.status,
    {value_sql('c', 'm', 'c.rn')} AS mass, {value_sql('c', 'f', 'c.rn')} AS impact, f.formula_id
  FROM classified c {join_formula('c', 'f', 'c.status')} {join_formula('c', 'm', "'*'")}
  UNION ALL
  SELECT {S}, NULL, declared_id, 'NONE', 0.0, 'DECLARED_NOT_PAID', 0, 0, NULL FROM unpaid)
"""
MATCHED = (FORMULA_SQL, MATCH_SQL)


def matched(v: Views):
    return mt.matching(v.pay, v.declared, FORMULAS)


# --- matching ------------------------------------------------------------------------


@query("match_by_id", f"""
SELECT p.line_id, i.id_match FROM pay p LEFT JOIN by_id i ON {same_scope('i', 'p')} AND i.staff_key = p.staff_key""",
       MATCHED)
def match_by_id(v):
    return mt.link(v.pay, v.declared).select("line_id", "id_match")


@query("match_by_name", f"""
SELECT p.line_id, n.name_match FROM pay p LEFT JOIN by_name n ON {same_scope('n', 'p')} AND n.name_key = p.name_key""",
       MATCHED)
def match_by_name(v):
    return mt.link(v.pay, v.declared).select("line_id", "name_match")


@query("cascade_match", "SELECT line_id, declared_id, method, score FROM classified", MATCHED)
def cascade_match(v):
    return mt.classify(v.pay, v.declared).select("line_id", "declared_id", "method", "score")


@query("declared_unpaid", f"SELECT declared_id, {S} FROM unpaid", MATCHED)
def declared_unpaid(v):
    return mt.declared_not_paid(v.pay, v.declared).select("declared_id", *SCOPE)


@query("matching", "SELECT * FROM matched", MATCHED)
def matching(v):
    return matched(v)


@query("matching_summary", f"""
SELECT status, count(*) AS row_count, {money('sum(mass)')} AS mass, {money('sum(impact)')} AS impact,
  cast(0 AS decimal(38,2)) AS confirmed_impact
FROM matched GROUP BY status""", MATCHED)
def matching_summary(v):
    return mt.matching_summary(matched(v))


@query("matching_scopes", f"""
SELECT {S}, status, count(*) AS row_count, {money('sum(mass)')} AS mass, {money('sum(impact)')} AS impact,
  cast(0 AS decimal(38,2)) AS confirmed_impact
FROM matched GROUP BY {S}, status""", MATCHED)
def matching_scopes(v):
    """The flagship: rows and money per status for every institution, regime and quarter."""
    return mt.matching_summary(matched(v), SCOPE)


#: The same tables over the lines that the business filters keep.
FILTERED = (FORMULA_SQL, MATCH_SQL.replace("FROM pay p", "FROM listing p"))


@query("matching_filtered", "SELECT * FROM matched", FILTERED)
def matching_filtered(v):
    """Matching of the lines that the business filters keep."""
    return mt.matching(v.listing, v.declared, FORMULAS)


@query("matching_forced", """
SELECT line_id, status, 'f3' AS formula_id, cast(base_pay + 0.5 * bonus AS decimal(18,2)) AS impact FROM classified""", MATCHED)
def matching_forced(v):
    """Matching valued by one formula for the whole run, whatever the scopes have in force."""
    forced = next(f for f in FORMULAS if f.formula_id == "f3")
    rows = mt.matching(v.pay, v.declared, FORMULAS, forced).where("line_id is not null")
    return rows.select("line_id", "status", "formula_id", "impact")


@query("impact_by_status", "SELECT line_id, status, formula_id, impact FROM matched WHERE line_id IS NOT NULL", MATCHED)
def impact_by_status(v):
    classified = mt.classify(v.pay, v.declared)
    return mt.value_matches(classified, FORMULAS).select("line_id", "status", "formula_id", "impact")


@query("dup_rank_id", f"""
SELECT line_id, row_number() OVER (PARTITION BY {S}, staff_key ORDER BY {ORDER}) AS dup_rank FROM pay""")
def dup_rank_id(v):
    return rk.ranked(v.pay, ["staff_key", *SCOPE], LINE_ORDER, "dup_rank").select("line_id", "dup_rank")


# --- formulas ------------------------------------------------------------------------


@query("resolve_formula", f"SELECT {S}, rubric, formula_id FROM resolved", (FORMULA_SQL,))
def resolve_formula(v):
    return fx.resolve_table(v.pay, FORMULAS)


#: The formulas of ``Views.formula_rows``, resolved by trying every formula on every scope.
BOOK_SQL = f"""
book_formulas AS (
  SELECT 'B' || o_orderkey AS formula_id, ([{', '.join(f"'{r}'" for r in Rubric.ALL)}])[(o_orderkey // 3) % {len(Rubric.ALL)} + 1] AS rubric,
    ([{', '.join(f"'{m}'" for m in Mode.ALL)}])[(o_orderkey // 7) % {len(Mode.ALL)} + 1] AS mode,
    cast((o_orderkey % 400 - 200) / 100 AS decimal(12,4)) AS k_base, cast((o_orderkey % 7) / 8 AS decimal(12,4)) AS k_bonus,
    CASE WHEN o_orderkey % 5 = 4 THEN 'I' || o_custkey ELSE ([NULL, 'IF', 'IO', 'IP'])[o_orderkey % 5 + 1] END AS institution_id,
    CASE WHEN o_orderkey % 11 > 0 THEN 'R' || (o_orderkey % 5 + 1) END AS regime,
    year(o_orderdate) * 4 + quarter(o_orderdate) AS starts, o_orderkey AS version FROM orders WHERE o_orderkey % 9 > 0),
book AS (
  SELECT {S}, rubric, coalesce(formula_id, 'DEFAULT') AS formula_id, mode, k_base, k_bonus FROM (
    SELECT s.institution_id, s.regime, s.quarter, s.year, r.rubric, f.formula_id, f.mode, f.k_base, f.k_bonus,
      row_number() OVER (PARTITION BY s.institution_id, s.regime, s.quarter, s.year, r.rubric ORDER BY
        f.institution_id IS NOT NULL DESC, f.rubric = r.rubric DESC, f.starts DESC, f.version DESC) AS place
    FROM scopes s CROSS JOIN rubrics r LEFT JOIN book_formulas f
      ON (f.regime = s.regime OR f.regime IS NULL) AND f.rubric IN (r.rubric, '*')
      AND (f.institution_id IS NULL OR f.institution_id = s.institution_id)
      AND f.starts <= s.year * 4 + cast(substr(s.quarter, 2, 1) AS integer))
  WHERE place = 1)"""


@query("formula_book", f"SELECT {S}, rubric, formula_id FROM book", (FORMULA_SQL, BOOK_SQL))
def formula_book(v):
    """The formula in force for every scope and rubric, out of as many formulas as there are orders."""
    return fb.in_force(v.pay, v.formula_rows).select(*SCOPE, "rubric", "formula_id")


@query("matching_book", f"""
SELECT c.line_id, c.status, b.formula_id AS impact_formula_id,
  cast(CASE WHEN b.formula_id = 'DEFAULT' THEN base_pay + transport + bonus WHEN b.mode = 'NO_IMPACT' THEN 0
    WHEN b.mode = 'EXTRA_LINES' AND c.rn = 1 THEN 0 WHEN b.mode = 'ONE_PER_PERSON' AND c.rn > 1 THEN 0
    ELSE k_base * base_pay + k_bonus * bonus - deductions END AS decimal(18,2)) AS impact
FROM classified c JOIN book b ON {same_scope('b', 'c')} AND b.rubric = c.status""", (*MATCHED, BOOK_SQL))
def matching_book(v):
    """Matching valued by a table of formulas."""
    book = fb.in_force(v.pay, v.formula_rows, mt.Match.PAY_STATUSES)
    rows = fb.valued(mt.classify(v.pay, v.declared), book, F.col("status"), "impact", "first_line")
    return rows.select("line_id", "status", "impact_formula_id", "impact")


@query("formula_versions", """
SELECT f.institution_id, f.regime, f.rubric, max(f.version) + 1 AS next_version, min(u.uses) AS scopes
FROM formulas f JOIN (
  SELECT g.institution_id, g.regime, g.rubric, count(r.formula_id) AS uses
  FROM formulas g LEFT JOIN resolved r ON r.formula_id = g.formula_id AND r.rubric = g.rubric
  GROUP BY g.institution_id, g.regime, g.rubric) u
  ON u.institution_id IS NOT DISTINCT FROM f.institution_id AND u.regime = f.regime AND u.rubric = f.rubric
GROUP BY f.institution_id, f.regime, f.rubric""", (FORMULA_SQL,))
def formula_versions(v):
    """Next version per institution, regime and rubric, with the scopes its versions value."""
    table = fx.formula_table(v.spark, [f for f in FORMULAS if f.active])
    uses = fx.resolve_table(v.pay, FORMULAS).groupBy("formula_id", "rubric").agg(F.count(F.lit(1)).alias("uses"))
    return (
        table.join(uses, ["formula_id", "rubric"], "left")
        .groupBy("institution_id", "regime", "rubric")
        .agg((F.max("version") + 1).alias("next_version"), F.sum(F.coalesce("uses", F.lit(0))).alias("scopes"))
    )


@query("selectable_formulas", f"""
SELECT {S}, formula_id FROM (
  SELECT s.*, 'DEFAULT' AS formula_id FROM scopes s
  UNION ALL
  SELECT s.*, f.formula_id FROM scopes s JOIN formulas f ON f.regime = s.regime AND f.rubric = '*'
    AND (f.institution_id IS NULL OR f.institution_id = s.institution_id)
    AND f.starts <= s.year * 4 + cast(substr(s.quarter, 2, 1) AS integer))""", (FORMULA_SQL,))
def selectable_formulas(v):
    """Formulas that may be forced, for every scope."""
    able = [f for f in FORMULAS if f.active and f.rubric == Rubric.ANY]
    options = [F.lit(fx.DEFAULT_FORMULA.formula_id)]
    options += [F.expr(f"if({fx.applies_sql(f)}, {fx.text_sql(f.formula_id)}, null)") for f in able]
    scopes = v.pay.select(*SCOPE).distinct()
    return scopes.select(*SCOPE, F.explode(F.array_compact(F.array(*options))).alias("formula_id"))


@query("formula_impact", f"""
SELECT p.line_id, f.formula_id, {value_sql('p', 'f', 'p.rn')} AS impact
FROM (SELECT *, row_number() OVER (PARTITION BY {S}, staff_key ORDER BY {ORDER}) AS rn FROM pay) p
{join_formula('p', 'f', "'DUPLICATE_ID'")}""", (FORMULA_SQL,))
def formula_impact(v):
    flagged = rk.flag_first(v.pay, ["staff_key", *SCOPE])
    valued = flagged.withColumn("formula_id", fx.resolve_id(FORMULAS, Rubric.DUPLICATE_ID))
    return fx.with_value(valued, FORMULAS, "impact", first="first_line").select("line_id", "formula_id", "impact")


@query("default_impact", "SELECT line_id, cast(base_pay + transport + bonus AS decimal(18,2)) AS impact FROM pay")
def default_impact(v):
    valued = v.pay.withColumn("formula_id", F.lit(fx.DEFAULT_FORMULA.formula_id))
    return fx.with_value(valued, [], "impact").select("line_id", "impact")


#: The formulas as a reader would write them.
TEXTS = """
WHEN formula_id = 'DEFAULT' THEN '1 × BASE_PAY + 1 × TRANSPORT + 1 × BONUS + 1 × HOUSING + 1 × PENSION + 1 × OTHER_PAY'
WHEN formula_id IN ('f1', 'f6') THEN '1 × BASE_PAY' WHEN formula_id = 'f2' THEN '1 × BASE_PAY + -1 × DEDUCTIONS'
WHEN formula_id = 'f3' THEN '1 × BASE_PAY + 0.5 × BONUS' WHEN formula_id = 'f4' THEN '2 × BASE_PAY'
WHEN formula_id IN ('f5', 'f9') THEN '1 × GROSS_PAY' WHEN formula_id = 'f7' THEN '0'
WHEN formula_id = 'f8' THEN '5 × BASE_PAY' WHEN formula_id = 'f10' THEN '1 × NET_PAY'"""


@query("formula_text", f"""
SELECT rubric, formula_id, CASE {TEXTS} END AS expression, count(*) AS scopes
FROM resolved GROUP BY rubric, formula_id""", (FORMULA_SQL,))
def formula_text(v):
    """The formulas in use, as text, with the scopes they value."""
    texts = [(f.formula_id, fx.describe(f)) for f in [fx.DEFAULT_FORMULA, *FORMULAS]]
    table = v.spark.createDataFrame(texts, "formula_id string, expression string")
    uses = fx.resolve_table(v.pay, FORMULAS).groupBy("rubric", "formula_id").agg(F.count(F.lit(1)).alias("scopes"))
    return uses.join(table, "formula_id").select("rubric", "formula_id", "expression", "scopes")


@query("formula_simulation", f"""
SELECT {S}, count(*) AS row_count, {money('sum(impact)')} AS impact, round(cast(sum(impact) AS double) / count(*), 6) AS mean_impact
FROM (SELECT {S}, CASE WHEN row_number() OVER (PARTITION BY {S}, staff_key ORDER BY {ORDER}) > 1
    THEN cast(gross_pay * 0.5 - deductions AS decimal(18,2)) ELSE 0 END AS impact FROM pay)
GROUP BY {S}""")
def formula_simulation(v):
    from paywarden.operators.summaries import simulate_formula

    draft = fx.Formula("draft", Rubric.DUPLICATE_ID, "EXTRA_LINES", (("GROSS_PAY", 0.5), ("DEDUCTIONS", -1)))
    return simulate_formula(v.pay, draft)


# --- listing group -------------------------------------------------------------------

PERSON = f"CASE WHEN {USABLE} THEN 'M:' || staff_key WHEN name_key <> '' THEN 'N:' || name_key ELSE 'L:' || line_id END"
GROUP_SQL = f"""
keyed AS (SELECT *, {PERSON} AS person_key FROM pay),
spans AS (SELECT {P}, person_key, count(DISTINCT regime) AS regimes, count(DISTINCT institution_id) AS institutions
  FROM keyed GROUP BY {P}, person_key),
occurrences AS (
  SELECT k.*, s.regimes, s.institutions,
    CASE WHEN {USABLE} THEN count(*) OVER (PARTITION BY k.quarter, k.year, staff_key) ELSE 0 END AS id_lines,
    CASE WHEN name_key <> '' THEN count(*) OVER (PARTITION BY k.quarter, k.year, name_key) ELSE 0 END AS name_lines,
    row_number() OVER (PARTITION BY k.quarter, k.year, k.person_key ORDER BY regime, institution_id, {ORDER}) AS occurrence_rank
  FROM keyed k JOIN spans s ON {same_period('s', 'k')} AND s.person_key = k.person_key),
statused AS (
  SELECT *, CASE WHEN NOT {USABLE} THEN 'UNUSABLE_ID' WHEN regimes > 1 THEN 'SEVERAL_REGIMES'
    WHEN institutions > 1 THEN 'SEVERAL_INSTITUTIONS' WHEN id_lines > 1 THEN 'DUPLICATE_ID'
    WHEN name_lines > 1 THEN 'DUPLICATE_NAME' ELSE 'UNIQUE' END AS status
  FROM occurrences),
rubric_of(status, rubric) AS (VALUES ('UNUSABLE_ID', 'MISSING_ID'), ('SEVERAL_REGIMES', 'PAID_ELSEWHERE'),
  ('SEVERAL_INSTITUTIONS', 'PAID_ELSEWHERE'), ('DUPLICATE_ID', 'DUPLICATE_ID'), ('DUPLICATE_NAME', 'DUPLICATE_NAME')),
grouped AS (
  SELECT t.institution_id, t.regime, t.quarter, t.year, t.line_id, t.staff_key, t.name_key, t.last_name, t.first_name,
    t.status, t.id_lines, t.name_lines, t.regimes, t.institutions, t.occurrence_rank, t.gross_pay AS mass,
    CASE WHEN f.formula_id IS NULL THEN cast(0 AS decimal(18,2)) ELSE {value_sql('t', 'f', 't.occurrence_rank')} END AS impact,
    coalesce(f.formula_id, 'NO_IMPACT') AS formula_id
  FROM statused t LEFT JOIN rubric_of r ON r.status = t.status
  LEFT JOIN resolved f ON {same_scope('f', 't')} AND f.rubric = r.rubric)
"""
GROUPED = (FORMULA_SQL, GROUP_SQL)
GROUP_COLUMNS = [*SCOPE, "line_id", "staff_key", "name_key", "status", "id_lines", "name_lines", "regimes", "institutions",
                 "occurrence_rank", "mass", "impact", "formula_id"]


def grouped(v: Views, rank: bool = True):
    return ls.listing_group(v.pay, FORMULAS, rank)


@query("listing_group", f"SELECT {', '.join(GROUP_COLUMNS)} FROM grouped", GROUPED)
def listing_group(v):
    return grouped(v).select(*GROUP_COLUMNS)


@query("listing_filtered", f"SELECT {', '.join(GROUP_COLUMNS)} FROM grouped",
       (FORMULA_SQL, GROUP_SQL.replace("FROM pay)", "FROM listing)")))
def listing_filtered(v):
    """The listing group of the lines that the business filters keep."""
    return ls.listing_group(v.listing, FORMULAS).select(*GROUP_COLUMNS)


@query("occurrence_counts", "SELECT line_id, id_lines, name_lines FROM occurrences", GROUPED)
def occurrence_counts(v):
    return ls.occurrence_counts(v.pay).select("line_id", "id_lines", "name_lines")


@query("distinct_over_person", "SELECT line_id, person_key, regimes, institutions FROM occurrences", GROUPED)
def distinct_over_person(v):
    figures = ls.person_figures(v.pay)
    joined = ls.with_person(v.pay).join(figures, ["person_key", *PERIOD])
    return joined.select("line_id", "person_key", "regimes", "institutions")


@query("person_rank", "SELECT line_id, person_key, occurrence_rank FROM occurrences", GROUPED)
def person_rank(v):
    return ls.with_rank(v.pay).select("line_id", "person_key", "occurrence_rank")


PEOPLE = "count(DISTINCT coalesce(nullif(staff_key, ''), nullif(name_key, ''), {}))"
SUMMARY = f"""count(*) AS row_count, {PEOPLE.format('line_id')} AS people, {money('sum(mass)')} AS mass,
  {money('sum(impact)')} AS impact"""


@query("status_summary", f"SELECT status, {SUMMARY} FROM grouped GROUP BY status", GROUPED)
def status_summary(v):
    return ls.status_summary(grouped(v, rank=False))


@query("regime_status_summary", f"SELECT regime, status, {SUMMARY} FROM grouped GROUP BY regime, status", GROUPED)
def regime_status_summary(v):
    return ls.status_summary(grouped(v, rank=False), ["regime"])


NAMES_SQL = "names(institution_id, official_name) AS (VALUES ('IF', 'Institution F'), ('IO', 'Institution O'))"
FULL = "trim({0}.last_name || ' ' || {0}.first_name)"


@query("unique_people_listing", f"""
SELECT g.quarter, g.year, CASE WHEN {USABLE} THEN 'M:' || staff_key ELSE 'N:' || name_key END AS person,
  max(staff_key) AS staff_key, max({FULL.format('g')}) AS full_name, max(name_key) AS name_key, max(status) AS status,
  string_agg(DISTINCT regime, ', ' ORDER BY regime) AS regimes,
  coalesce(string_agg(DISTINCT official_name, ', ' ORDER BY official_name), '') AS institutions,
  count(*) AS row_count, {money('sum(mass)')} AS mass, {money('sum(impact)')} AS impact
FROM grouped g LEFT JOIN names n ON n.institution_id = g.institution_id GROUP BY 1, 2, 3""", (*GROUPED, NAMES_SQL))
def unique_people_listing(v):
    return ls.unique_people(grouped(v, rank=False), v.institutions)


@query("results_by_status", f"""
SELECT g.status, n.official_name AS institution, g.regime, g.quarter, g.year, g.line_id, g.staff_key,
  {FULL.format('g')} AS full_name, g.name_key, g.id_lines, g.name_lines, g.regimes, g.institutions, g.occurrence_rank,
  g.mass, g.impact, g.formula_id
FROM grouped g LEFT JOIN names n ON n.institution_id = g.institution_id""", (*GROUPED, NAMES_SQL))
def results_by_status(v):
    """The result lines written as one folder per status in a single pass, and read back."""
    from paywarden.session import scratch_path
    from paywarden.sources.writers import export_parts

    folder = scratch_path(v.spark, "results_by_status")
    details = ls.listing_details(grouped(v), v.institutions)
    export_parts(details, folder, "status")
    return v.spark.read.schema(details.schema).parquet(folder)


# --- campaign ------------------------------------------------------------------------

CAMPAIGN_SQL = f"""
id_hits AS (
  SELECT d.declared_id, d.institution_id AS di, d.regime AS dr, d.staff_key AS dk, d.name_key AS dn, b.*, 'ID' AS method
  FROM declared d JOIN pay b ON {same_period('b', 'd')} AND d.staff_key NOT IN ('', 'NU') AND b.staff_key = d.staff_key),
name_hits AS (
  SELECT d.declared_id, d.institution_id AS di, d.regime AS dr, d.staff_key AS dk, d.name_key AS dn, b.*, 'NAME' AS method
  FROM declared d JOIN pay b ON {same_period('b', 'd')} AND d.name_key <> '' AND b.name_key = d.name_key
  WHERE d.declared_id NOT IN (SELECT declared_id FROM id_hits)),
pairs AS (
  SELECT *, row_number() OVER (PARTITION BY declared_id, execution_id ORDER BY regime, institution_id, source_row, line_id) AS payment_rank
  FROM (SELECT * FROM id_hits UNION ALL SELECT * FROM name_hits)),
valued_pairs AS (
  SELECT b.*, CASE WHEN b.di = b.institution_id AND b.dr = b.regime THEN cast(0 AS decimal(18,2))
      ELSE {value_sql('b', 'f', 'b.payment_rank')} END AS impact,
    CASE WHEN b.di = b.institution_id AND b.dr = b.regime THEN 'NO_IMPACT' ELSE f.formula_id END AS formula_id
  FROM pairs b {join_formula('b', 'f', "'PAID_ELSEWHERE'")}),
counted AS (
  SELECT declared_id, count(*) AS occurrences, count(DISTINCT regime) AS regimes FROM pairs GROUP BY declared_id),
campaign_rows AS (
  SELECT v.declared_id, v.di AS institution_id, v.dr AS regime, v.quarter, v.year, v.dk AS staff_key, v.dn AS name_key,
    v.institution_id AS paying_institution, v.regime AS paying_regime, v.execution_id AS paying_execution, v.method,
    {FULL.format('v')} AS paid_name, c.occurrences, c.regimes, v.gross_pay AS mass, v.impact, v.formula_id,
    CASE WHEN c.regimes > 1 THEN 'PAID_IN_SEVERAL_REGIMES'
      WHEN v.regime <> v.dr AND v.institution_id <> v.di THEN 'PAID_OTHER_INSTITUTION_AND_REGIME'
      WHEN v.regime <> v.dr THEN 'PAID_OTHER_REGIME' WHEN v.institution_id <> v.di THEN 'PAID_OTHER_INSTITUTION'
      WHEN c.occurrences > 1 THEN 'MULTIPLE_IN_SCOPE' ELSE 'PAID_IN_SCOPE' END AS status, 1 AS payments
  FROM valued_pairs v JOIN counted c ON c.declared_id = v.declared_id
  UNION ALL
  SELECT declared_id, {S}, staff_key, name_key, NULL, NULL, NULL, 'NONE', NULL, 0, 0, 0, 0, 'NO_IMPACT',
    'DECLARED_NOT_PAID', 0
  FROM declared WHERE declared_id NOT IN (SELECT declared_id FROM pairs))
"""
CAMPAIGN = (FORMULA_SQL, CAMPAIGN_SQL)
#: The same tables over the lines that the business filters keep.
FILTERED_CAMPAIGN_SQL = CAMPAIGN_SQL.replace("JOIN pay b", "JOIN listing b")
CAMPAIGN_KEYS = f"""declared_id, {S}, staff_key, name_key, paying_institution, paying_regime, paying_execution, method,
  occurrences, regimes, formula_id, status"""


def run_campaign(v: Views):
    return cp.campaign(v.declared, v.pay, FORMULAS)


@query("campaign", f"""
SELECT {CAMPAIGN_KEYS}, cast(sum(payments) AS bigint) AS payments, {money('sum(mass)')} AS mass,
  {money('sum(impact)')} AS impact
FROM campaign_rows GROUP BY {CAMPAIGN_KEYS}""", CAMPAIGN)
def campaign(v):
    return run_campaign(v)


@query("campaign_summary", f"""
SELECT status, count(*) AS row_count, {PEOPLE.format('declared_id')} AS people, {money('sum(mass)')} AS mass,
  {money('sum(impact)')} AS impact
FROM campaign_rows GROUP BY status""", CAMPAIGN)
def campaign_summary(v):
    return cp.campaign_summary(run_campaign(v))


HITS = """SELECT declared_id, institution_id AS paying_institution, regime AS paying_regime, execution_id AS paying_execution,
  method, count(*) AS payments, cast(sum(gross_pay) AS decimal(38,2)) AS mass FROM {} GROUP BY 1, 2, 3, 4, 5"""
HIT_COLUMNS = ["declared_id", "paying_institution", "paying_regime", "paying_execution", "method", "payments", "mass"]


@query("campaign_id_matches", HITS.format("id_hits"), CAMPAIGN)
def campaign_id_matches(v):
    return cp.id_matches(v.declared.select("declared_id", *PERIOD, "staff_key"), v.pay).select(*HIT_COLUMNS)


@query("campaign_name_matches", HITS.format("name_hits"), CAMPAIGN)
def campaign_name_matches(v):
    kept = v.declared.select("declared_id", *PERIOD, "staff_key", "name_key")
    return cp.name_matches(kept, v.pay).select(*HIT_COLUMNS)


@query("campaign_counts", """
SELECT d.declared_id, coalesce(c.occurrences, 0) AS occurrences, coalesce(c.regimes, 0) AS regimes
FROM declared d LEFT JOIN counted c ON c.declared_id = d.declared_id""", CAMPAIGN)
def campaign_counts(v):
    return cp.campaign_counts(run_campaign(v))


@query("campaign_rank", f"""
SELECT line_id, row_number() OVER (PARTITION BY {P}, staff_key, execution_id
  ORDER BY regime, institution_id, {ORDER}) AS payment_rank
FROM pay WHERE {USABLE}""")
def campaign_rank(v):
    """Rank of a payment under any declaration of its identifier."""
    return cp.ranked_payments(v.pay, "staff_key").select("line_id", "payment_rank")


@query("campaign_rank_name", f"""
SELECT line_id, row_number() OVER (PARTITION BY {P}, name_key, execution_id
  ORDER BY regime, institution_id, {ORDER}) AS payment_rank
FROM pay WHERE name_key <> ''""")
def campaign_rank_name(v):
    """Rank of a payment under any declaration that finds it by name."""
    return cp.ranked_payments(v.pay, "name_key").select("line_id", "payment_rank")


@query("campaign_filtered", f"""
SELECT {CAMPAIGN_KEYS}, cast(sum(payments) AS bigint) AS payments, {money('sum(mass)')} AS mass,
  {money('sum(impact)')} AS impact
FROM campaign_rows GROUP BY {CAMPAIGN_KEYS}""", (FORMULA_SQL, FILTERED_CAMPAIGN_SQL))
def campaign_filtered(v):
    """The campaign over the lines that the business filters keep."""
    return cp.campaign(v.declared, cp.analysis_base(v.pay, None, RULES), FORMULAS)


@query("unique_people_campaign", f"""
SELECT declared_id, staff_key, name_key, coalesce(paid_name, name_key) AS full_name, max(status) AS status,
  string_agg(DISTINCT coalesce(paying_regime, 'NOT PAID'), ', ' ORDER BY coalesce(paying_regime, 'NOT PAID')) AS regimes,
  string_agg(DISTINCT coalesce(official_name, 'NOT PAID'), ', ' ORDER BY coalesce(official_name, 'NOT PAID')) AS institutions,
  max(occurrences) AS occurrences, {money('sum(mass)')} AS mass, {money('sum(impact)')} AS impact
FROM campaign_rows r LEFT JOIN names n ON n.institution_id = r.paying_institution
GROUP BY declared_id, staff_key, name_key, coalesce(paid_name, name_key)""", (*CAMPAIGN, NAMES_SQL))
def unique_people_campaign(v):
    return cp.unique_people(v.declared, v.pay, v.institutions, FORMULAS)


@query("analysis_base", f"""
SELECT line_id, execution_id, {S}, gross_pay FROM listing WHERE execution_id IN ('E1', 'E2', 'E4')""")
def analysis_base(v):
    base = cp.analysis_base(v.pay, ["E1", "E2", "E4"], RULES)
    return base.select("line_id", "execution_id", *SCOPE, "gross_pay")


# --- regime comparison ---------------------------------------------------------------

I = "institution_id, quarter, year"  # noqa: E741
MATCH_KEY = f"CASE WHEN {USABLE} THEN 'M:' || staff_key ELSE 'N:' || name_key END"
PROFILE = f"""min(raw_id) AS raw_id, min(staff_key) AS staff_key, min(trim(last_name || ' ' || first_name)) AS full_name,
  min(name_key) AS name_key, min(grade) AS grade, min(category) AS category, min(unit) AS unit, min(province) AS province,
  count(*) AS payments, cast(sum(gross_pay) AS decimal(38,2)) AS gross, cast(sum(net_pay) AS decimal(38,2)) AS net"""
FIELDS = ["raw_id", "staff_key", "full_name", "name_key", "grade", "category", "unit", "province"]


def compare_sql(financial: str) -> str:
    sides = ",\n    ".join(f"a.{c} AS {c}_a, b.{c} AS {c}_b" for c in FIELDS)
    numbers = ",\n    ".join(
        f"coalesce(a.{c}, 0) AS {c}_a, coalesce(b.{c}, 0) AS {c}_b" for c in ("payments", "gross", "net")
    )
    side = f"""SELECT {I}, {MATCH_KEY} AS match_key, {PROFILE} FROM pay
    WHERE regime = '{{}}' AND ({USABLE} OR name_key <> '') GROUP BY {I}, {MATCH_KEY}"""
    differs = " OR ".join(f"coalesce({c}_a, '') <> coalesce({c}_b, '')" for c in ("grade", "category", "unit", "province"))
    return f"""
side_a AS ({side.format('R1')}),
side_b AS ({side.format('R2')}),
outer_join AS (
  SELECT coalesce(a.institution_id, b.institution_id) AS institution_id, coalesce(a.quarter, b.quarter) AS quarter,
    coalesce(a.year, b.year) AS year, coalesce(a.match_key, b.match_key) AS match_key,
    {sides},
    {numbers}
  FROM side_a a FULL OUTER JOIN side_b b
    ON a.institution_id = b.institution_id AND {same_period('a', 'b')} AND a.match_key = b.match_key),
gaps AS (
  SELECT *, CASE WHEN match_key LIKE 'M:%' THEN 'ID' ELSE 'NAME' END AS key_type,
    cast(gross_a - gross_b AS decimal(38,2)) AS gross_gap, cast(net_a - net_b AS decimal(38,2)) AS net_gap,
    100.0 * abs(cast(gross_a AS double) - cast(gross_b AS double)) /
      greatest(abs(cast(gross_a AS double)), abs(cast(gross_b AS double)), 1) AS gap_percent,
    payments_a > 0 AND payments_b > 0 AS paid_twice
  FROM outer_join),
flags AS (
  SELECT *, paid_twice AND ({financial}) AS financial_gap, paid_twice AND ({differs}) AS admin_gap,
    coalesce(key_type = 'ID' AND name_key_a <> '' AND name_key_b <> '' AND name_key_a <> name_key_b, false) AS conflict,
    CASE WHEN payments_a > 0 THEN name_key_a ELSE name_key_b END AS own_name
  FROM gaps),
staged AS (
  SELECT *, CASE WHEN payments_a = 0 THEN 'ONLY_B' WHEN payments_b = 0 THEN 'ONLY_A' WHEN conflict THEN 'ID_NAME_CONFLICT'
      WHEN payments_a > 1 OR payments_b > 1 THEN 'MULTIPLE_PAYMENT'
      WHEN financial_gap AND admin_gap THEN 'FINANCIAL_AND_ADMIN_GAP' WHEN financial_gap THEN 'FINANCIAL_GAP'
      WHEN admin_gap THEN 'ADMIN_GAP' ELSE 'IDENTICAL' END AS status,
    concat_ws(' ; ', CASE WHEN payments_a > 1 THEN 'Several payments in regime A' END,
      CASE WHEN payments_b > 1 THEN 'Several payments in regime B' END,
      CASE WHEN financial_gap THEN 'Financial gap above the threshold' END,
      CASE WHEN admin_gap THEN 'Administrative data differ' END,
      CASE WHEN conflict THEN 'One identifier, different names' END,
      CASE WHEN paid_twice THEN 'Paid in both regimes' END) AS base_diagnosis
  FROM flags),
noted AS (
  SELECT r.*, r.status IN ('ONLY_A', 'ONLY_B') AND r.own_name <> '' AND EXISTS (
      SELECT 1 FROM staged x WHERE x.institution_id = r.institution_id AND {same_period('x', 'r')}
        AND x.own_name = r.own_name
        AND ((r.status = 'ONLY_A' AND x.payments_b > 0) OR (r.status = 'ONLY_B' AND x.payments_a > 0))) AS same_name
  FROM staged r),
compared AS (
  SELECT *, concat_ws(' ; ', nullif(base_diagnosis, ''),
    CASE WHEN same_name THEN '{cm.SAME_NAME_MESSAGE}' END) AS diagnosis
  FROM noted)
"""


ANY_GAP_SQL = compare_sql("gross_gap <> 0 OR net_gap <> 0")
PERCENT_SQL = compare_sql("gap_percent >= 25.0")
RESULT_COLUMNS = ["institution_id", *PERIOD, "match_key", "key_type",
                  *[f"{c}_{s}" for c in (*FIELDS, "payments", "gross", "net") for s in "ab"],
                  "gross_gap", "net_gap", "round(gap_percent, 6) AS gap_percent", "paid_twice", "financial_gap",
                  "admin_gap", "status", "diagnosis"]


def compared(v: Views, thresholds=cm.Thresholds()):
    return cm.compare_regimes(v.pay, cm.Side("R1"), cm.Side("R2"), thresholds)


@query("compare_regimes", f"SELECT {', '.join(RESULT_COLUMNS)} FROM compared", (ANY_GAP_SQL,))
def compare_regimes(v):
    return compared(v).selectExpr(*RESULT_COLUMNS)


@query("compare_percent", """
SELECT institution_id, quarter, year, match_key, financial_gap, status, diagnosis FROM compared""", (PERCENT_SQL,))
def compare_percent(v):
    """A percentage threshold alone: the unset amount is ignored."""
    rows = compared(v, cm.Thresholds(percent=25))
    return rows.select("institution_id", *PERIOD, "match_key", "financial_gap", "status", "diagnosis")


@query("compare_filter", f"SELECT {I}, match_key, status FROM compared WHERE paid_twice", (ANY_GAP_SQL,))
def compare_filter(v):
    return cm.filter_results(compared(v), cm.Gap.PAID_TWICE).select("institution_id", *PERIOD, "match_key", "status")


@query("compare_summary", f"""
SELECT {I}, count(*) FILTER (payments_a > 0 AND payments_b > 0) AS common,
  count(*) FILTER (payments_a > 0 AND payments_b = 0) AS only_a, count(*) FILTER (payments_b > 0 AND payments_a = 0) AS only_b,
  count(*) FILTER (paid_twice) AS paid_twice, count(*) FILTER (financial_gap) AS financial,
  count(*) FILTER (admin_gap) AS administrative, {money('sum(gross_a)')} AS mass_a, {money('sum(gross_b)')} AS mass_b
FROM compared GROUP BY {I}""", (ANY_GAP_SQL,))
def compare_summary(v):
    return cm.compare_summary(compared(v), ["institution_id", *PERIOD])


@query("compare_full_outer", f"""
SELECT {I}, match_key, payments_a, payments_b, gross_a, gross_b, net_a, net_b FROM outer_join""", (ANY_GAP_SQL,))
def compare_full_outer(v):
    keys = ["institution_id", *PERIOD]
    profile = lambda regime: cm.person_profile(v.pay.where(F.col("regime") == regime), keys)
    columns = ["payments_a", "payments_b", "gross_a", "gross_b", "net_a", "net_b"]
    return cm.full_outer(profile("R1"), profile("R2"), keys).select(*keys, "match_key", *columns)


@query("person_profile", f"""
SELECT {S}, {MATCH_KEY} AS match_key, {PROFILE} FROM pay WHERE {USABLE} OR name_key <> '' GROUP BY {S}, {MATCH_KEY}""")
def person_profile(v):
    return cm.person_profile(v.pay, SCOPE)


@query("same_name_other_id", f"SELECT {I}, match_key, status, own_name FROM noted WHERE same_name", (ANY_GAP_SQL,))
def same_name_other_id(v):
    keys = ["institution_id", *PERIOD]
    rows = cm.same_name_other_id(compared(v), keys)
    return rows.select(*keys, "match_key", "status", cm.own_name().alias("own_name"))


ORDERED = """CASE WHEN status = 'IDENTICAL' THEN 1 ELSE 0 END, abs(gross_gap) DESC NULLS LAST, full_name_a NULLS LAST,
  full_name_b NULLS LAST, match_key, institution_id, quarter, year"""


@query("compare_results", f"""
SELECT {I}, match_key, status, gross_gap, full_name_a, full_name_b FROM compared ORDER BY {ORDERED}""", (ANY_GAP_SQL,))
def compare_results(v):
    """All results in their order; the sort is by ranges, so no task holds a whole scope."""
    rows = compared(v).orderBy(*cm.result_order())
    return rows.select("institution_id", *PERIOD, "match_key", "status", "gross_gap", "full_name_a", "full_name_b")


@query("top_gaps", f"""
SELECT institution_id, quarter, year, match_key, status, gross_gap FROM compared ORDER BY {ORDERED} LIMIT 500""",
       (ANY_GAP_SQL,))
def top_gaps(v):
    return cm.top_gaps(compared(v), 500).select("institution_id", *PERIOD, "match_key", "status", "gross_gap")


