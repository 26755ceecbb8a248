"""Formula resolution and valuation as SQL table expressions, for the oracles."""

from __future__ import annotations

from paywarden.plans.registry import S, same_scope
from paywarden.plans.views import FORMULAS
from paywarden.schema import Rubric

TERM_COLUMNS = {
    "BASE_PAY": "base_pay", "TRANSPORT": "transport", "BONUS": "bonus", "DEDUCTIONS": "deductions",
    "NET_PAY": "net_pay", "GROSS_PAY": "gross_pay",
}


def _row(formula) -> str:
    def text(value):
        return "NULL" if value is None else f"'{value}'"

    weights = dict(formula.terms)
    starts = formula.year * 4 + int(formula.quarter[1:])
    cells = [text(formula.formula_id), text(formula.rubric), text(formula.mode), text(formula.institution_id),
             text(formula.regime), str(starts), str(formula.version)]
    cells += [f"cast({weights.get(code, 0)} AS decimal(12,4))" for code in TERM_COLUMNS]
    return "(" + ", ".join(cells) + ")"


FORMULA_SQL = f"""
formulas(formula_id, rubric, mode, institution_id, regime, starts, version, {', '.join('k_' + c for c in TERM_COLUMNS.values())}) AS (
  VALUES {', '.join(_row(f) for f in FORMULAS if f.active)}),
rubrics(rubric) AS (VALUES {', '.join(f"('{r}')" for r in Rubric.ALL)}),
scopes AS (SELECT DISTINCT {S} FROM pay),
resolved AS (
  SELECT {S}, rubric, coalesce(formula_id, 'DEFAULT') AS formula_id, coalesce(mode, 'ALL_LINES') AS mode,
    coalesce(k_base_pay, 1) AS k_base_pay, coalesce(k_transport, 1) AS k_transport, coalesce(k_bonus, 1) AS k_bonus,
    coalesce(k_deductions, 0) AS k_deductions, coalesce(k_net_pay, 0) AS k_net_pay, coalesce(k_gross_pay, 0) AS k_gross_pay
  FROM (
    SELECT s.institution_id, s.regime, s.quarter, s.year, r.rubric, f.formula_id, f.mode, f.k_base_pay, f.k_transport,
      f.k_bonus, f.k_deductions, f.k_net_pay, f.k_gross_pay,
      row_number() OVER (PARTITION BY s.institution_id, s.regime, s.quarter, s.year, r.rubric ORDER BY
        CASE WHEN f.institution_id IS NOT NULL THEN 4 ELSE 2 END + CASE WHEN f.rubric = r.rubric THEN 1 ELSE 0 END DESC,
        f.starts DESC, f.version DESC) AS place
    FROM scopes s CROSS JOIN rubrics r LEFT JOIN formulas f
      ON f.regime = s.regime AND f.rubric IN (r.rubric, '*')
      AND (f.institution_id IS NULL OR f.institution_id = s.institution_id)
      AND f.starts <= s.year * 4 + cast(substr(s.quarter, 2, 1) AS integer))
  WHERE place = 1)
"""


def value_sql(line: str, formula: str, rank: str) -> str:
    """Amount of a line under a resolved formula, given its rank."""
    total = " + ".join(f"{formula}.k_{c} * {line}.{c}" for c in TERM_COLUMNS.values())
    return (
        f"cast(CASE WHEN {formula}.mode = 'NO_IMPACT' THEN 0"
        f" WHEN {formula}.mode = 'EXTRA_LINES' AND {rank} = 1 THEN 0"
        f" WHEN {formula}.mode = 'ONE_PER_PERSON' AND {rank} > 1 THEN 0 ELSE {total} END AS decimal(18,2))"
    )


def join_formula(line: str, formula: str, rubric: str) -> str:
    return f"JOIN resolved {formula} ON {same_scope(formula, line)} AND {formula}.rubric = {rubric}"
