"""Figures of the whole annex pack without its lines.

The lines of a scope are reduced to one row per identifier and one per name, in
one aggregation each: how many lines are listed, paid or doubtful, what they
amount to under the formula of every rubric, and the first line of each kind.
All annexes are read off these rows, so no line is copied per annex.

Lines found elsewhere need no join of lines with controlling institutions
either. What all institutions pay to a person, less what the own institution
pays, plus what its own filters leave out, is what is found outside the scope.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from paywarden.functions import formulas as fx
from paywarden.functions.filters import FilterRule, own_predicate, retained
from paywarden.functions.text import has_name, usable_id
from paywarden.operators.annexes import ANNEXES, BY_NAME, DECLARED_ORDER, ID, NAME
from paywarden.schema import LINE_ORDER, Mode, Rubric, SCOPE

KINDS = {ID: "id", NAME: "name"}
#: Rubrics of the listed and of the paid lines whose amounts are summed per key.
LISTED = {ID: [Rubric.ANY, Rubric.DUPLICATE_ID, Rubric.MISSING_ID], NAME: [Rubric.ANY, Rubric.DUPLICATE_NAME]}
PAID = {ID: [Rubric.OK_BY_ID, Rubric.PAID_NOT_DECLARED], NAME: [Rubric.OK_BY_NAME, Rubric.PAID_NOT_DECLARED]}
SUM = "decimal(38,2)"
#: Amounts are summed as whole cents in two parts, which is many times quicker than sums of decimals: the parts above
#: and below this bit. They are exact for any amounts of up to 2 ** 33 lines of one scope or person.
BITS = 30
PARTS = ("hi", "lo")


@dataclass(frozen=True)
class Book:
    """The formulas of a run: resolved per scope and rubric, or one that is forced on all rubrics."""

    formulas: tuple[fx.Formula, ...]
    forced: fx.Formula | None = None

    def able(self, rubric: str) -> list[fx.Formula]:
        """Formulas that some scope may use for a rubric, best first."""
        if self.forced:
            return [self.forced]
        return [*(f for f in fx.precedence(list(self.formulas)) if f.rubric in (rubric, Rubric.ANY)), fx.DEFAULT_FORMULA]

    def of_scope(self, rubric: str, value: Callable[[fx.Formula], str]) -> str:
        """What a function says of the formula of a scope, as SQL over the columns of the scope."""
        *others, last = self.able(rubric)
        return fx.case_sql([(fx.applies_sql(f), value(f)) for f in others], value(last))

    def term_lists(self, rubric: str) -> list[tuple]:
        return list(dict.fromkeys(f.terms for f in self.able(rubric) if f.mode != Mode.NO_IMPACT))

    def terms_number(self, rubric: str) -> str:
        lists = self.term_lists(rubric)
        return self.of_scope(rubric, lambda f: "null" if f.mode == Mode.NO_IMPACT else str(lists.index(f.terms)))

    def ranked(self, rubric: str) -> bool:
        return any(f.mode in Mode.RANKED for f in self.able(rubric))

    def impact(self, rubric: str, amount: str, first: str) -> str:
        """What counts of the amount of all lines and that of first lines, by the mode of a scope's formula."""
        modes = {Mode.ALL_LINES: amount, Mode.ONE_PER_PERSON: first, Mode.EXTRA_LINES: f"{amount} - {first}", Mode.NO_IMPACT: "0"}
        return self.of_scope(rubric, lambda f: f"cast(coalesce({modes[f.mode]}, 0) as {SUM})")


# --- lines to one row per key --------------------------------------------------------


def value_of(rubric: str) -> str:
    return f"value_{rubric.lower()}" if rubric != Rubric.ANY else "value_any"


def part_of(cents: str, part: str) -> str:
    return f"shiftright({cents}, {BITS})" if part == "hi" else f"({cents} & {(1 << BITS) - 1})"


def in_parts(value: str) -> list[str]:
    return [f"{value}_{part}" for part in PARTS]


def money_of(high: str, low: str) -> str:
    """An amount from its two parts."""
    return f"cast((cast({high} as decimal(38,0)) * {1 << BITS} + {low}) * 0.01 as {SUM})"


def elsewhere_terms(book: Book) -> list[str]:
    return [f"terms_{i}" for i in range(len(book.term_lists(Rubric.PAID_ELSEWHERE)))]


def valued(lines: DataFrame, rules: list[FilterRule], book: Book, key: str) -> DataFrame:
    """Lines with their full amount under each rubric of a key, and under each list of terms for lines elsewhere.

    The number of the scope's list of terms is a column of its own, which keeps the generated code small.
    """
    rubrics = [*LISTED[key], *PAID[key]]
    money = [c for c in [*fx.BUILT_IN_COMPONENTS.values(), "extra_components"] if c in lines.columns]
    flags = [
        retained(rules).alias("listed"), F.coalesce(~own_predicate(rules), F.lit(False)).alias("left_out"),
        F.expr("coalesce(gross_pay > 0, false)").alias("paid"), (~usable_id(F.col(ID))).alias("no_id"),
        (~has_name(F.col(NAME))).alias("nameless"),
    ]
    numbers = [F.expr(book.terms_number(r)).alias(f"number_{i}") for i, r in enumerate(rubrics)]
    rows = lines.select(key, *SCOPE, *LINE_ORDER, *money, *flags, *numbers)
    amounts = []
    for i, rubric in enumerate(rubrics):
        cases = fx.case_sql([(f"number_{i} = {n}", fx.terms_sql(t)) for n, t in enumerate(book.term_lists(rubric))], "cast(0 as decimal(18,2))")
        amounts.append((value_of(rubric), cases))
    amounts += [(f"terms_{i}", fx.terms_sql(t)) for i, t in enumerate(book.term_lists(Rubric.PAID_ELSEWHERE))]
    cents = [f"cast({amount} * 100 as bigint) as {name}" for name, amount in amounts]
    return rows.selectExpr(key, *SCOPE, *LINE_ORDER, "listed", "left_out", "paid", "no_id", "nameless", *cents)


def subset(name: str, test: str, values: list[str], of_first: list[str] | None) -> list[str]:
    """Number and amounts of the lines that pass a test, and the first of them with some of its amounts."""
    found = [f"count_if({test}) as {name}_n"]
    found += [f"sum(if({test}, {part_of(v, part)}, null)) as {name}_{v}_{part}" for v in values for part in PARTS]
    if of_first is None:
        return found
    return [*found, f"min(if({test}, struct({', '.join([*LINE_ORDER, *of_first])}), null)) as {name}_head"]


def figures(lines: DataFrame, declared: DataFrame, rules: list[FilterRule], book: Book, key: str, heads: bool = False) -> DataFrame:
    """One row per scope and key with what the annexes need of its lines and declarations.

    First lines are looked up where a formula ranks them; ``heads`` adds those that only the people of the annexes need.
    """
    def of_first(rubrics: list[str], always: tuple[str, ...] = ()) -> list[str] | None:
        """Amounts that the first line has to carry, if it is needed at all."""
        carried = [value_of(r) for r in rubrics if book.ranked(r) or r in always]
        return carried if carried or heads else None

    bare = [] if heads else None
    terms = elsewhere_terms(book)
    of_terms = terms if book.ranked(Rubric.PAID_ELSEWHERE) else bare
    measures = subset("listed", "listed", [value_of(r) for r in LISTED[key]], of_first(LISTED[key], (Rubric.ANY,)))
    measures += subset("paid", "listed and paid", [value_of(r) for r in PAID[key]], of_first(PAID[key]))
    if key == ID:
        measures += subset("nameless", "listed and nameless", [], bare)
    else:
        measures += subset("doubtful", "listed and (nameless or no_id)", [value_of(Rubric.ANY)], of_first([Rubric.ANY]))
        measures += subset("no_id", "listed and no_id", [], bare)
    for name, test in (("all", "true"), ("all_paid", "paid"), ("out", "left_out"), ("out_paid", "left_out and paid")):
        measures += subset(name, test, terms, of_terms)
    per_key = valued(lines, rules, book, key).groupBy(key, *SCOPE).agg(*map(F.expr, measures))
    own = ["count(1) as declared_n", "count_if(no_id) as declared_no_id_n"]
    if heads:
        order = f"struct({', '.join(DECLARED_ORDER)})"
        own += [f"min({order}) as declared_head", f"min(if(no_id, {order}, null)) as declared_no_id_head"]
    sheet = declared.select(key, *SCOPE, *DECLARED_ORDER, (~usable_id(F.col(ID))).alias("no_id"))
    both = per_key.join(sheet.groupBy(key, *SCOPE).agg(*map(F.expr, own)), [key, *SCOPE], "full")
    found = with_elsewhere(both, key, terms, of_terms is not None)
    usable = usable_id(F.col(key)) if key == ID else has_name(F.col(key))
    number = F.expr(book.terms_number(Rubric.PAID_ELSEWHERE)).cast("int").alias("terms_number")
    return found.select("*", usable.alias("usable"), (usable & (F.col("declared_n") > 0)).alias("is_declared"), number)


def with_elsewhere(rows: DataFrame, key: str, terms: list[str], ranked: bool) -> DataFrame:
    """Add what is found outside each scope: all institutions less the own one, plus what its filters leave out.

    Counts and amounts that a row has none of become 0.
    """
    everywhere = f"over (partition by {key}, regime, quarter, year)"
    prefixes = {"else": ("all", "out"), "else_paid": ("all_paid", "out_paid")}
    measures = ["n", *(part for t in terms for part in in_parts(t))]
    sums = [f"sum({a}_{m}) {everywhere} as {p}_{m}" for p, (a, _) in prefixes.items() for m in measures]
    firsts = [f"min({a}_head) {everywhere} as {p}_first" for p, (a, _) in prefixes.items()] if ranked else []
    rows = rows.selectExpr("*", *sums, *firsts)
    if ranked:
        # The first line of the other institutions is the first of all, or the next one where that is an own line.
        rows = rows.selectExpr("*", *(f"min(if({a}_head = {p}_first, null, {a}_head)) {everywhere} as {p}_next" for p, (a, _) in prefixes.items()))
    less = [f"coalesce({p}_{m}, 0) - coalesce({a}_{m}, 0) + coalesce({o}_{m}, 0) as {p}_{m}"
            for p, (a, o) in prefixes.items() for m in measures]
    heads = [f"least(if({a}_head = {p}_first, {p}_next, {p}_first), {o}_head) as {p}_head" for p, (a, o) in prefixes.items()] if ranked else []
    rest = [c for c in rows.columns if not c.startswith(("all_", "out_", "else_"))]
    whole = [f"coalesce({c}, 0) as {c}" if c.endswith("_n") else c for c in rest]
    return rows.selectExpr(*whole, *less, *heads)


# --- rows of a key to the annexes ----------------------------------------------------


@dataclass(frozen=True)
class Share:
    """What one key adds to an annex, as SQL: when it does, lines, people, amount of all lines and of the first one.

    Amounts have two parts. ``head`` is the first line, and ``mark`` the kind of person that it stands for.
    """

    test: str
    lines: str | None = None
    people: str | None = None
    amount: tuple[str, ...] | None = None
    first: tuple[str, ...] | None = None
    head: str | None = None
    mark: str = ""


def shares(book: Book, key: str) -> dict[str, list[Share]]:
    """Per annex, what a row of ``figures`` adds to it."""
    kind = KINDS[key]
    any_, double = value_of(Rubric.ANY), Rubric.DUPLICATE_ID if key == ID else Rubric.DUPLICATE_NAME
    ok = Rubric.OK_BY_ID if key == ID else Rubric.OK_BY_NAME

    def of_head(cents: str) -> tuple[str, ...]:
        return tuple(part_of(cents, part) for part in PARTS)

    def of(test: str, name: str, rubric: str, people: str | None = "1", head: bool = True) -> Share:
        value = value_of(rubric)
        first = of_head(f"{name}_head.{value}") if book.ranked(rubric) else None
        return Share(test, f"{name}_n", people, tuple(in_parts(f"{name}_{value}")), first, f"{name}_head" if head else None)

    def only_first(test: str) -> Share:
        amount = of_head(f"listed_head.{any_}")
        return Share(test, "1", "1", amount, amount, "listed_head")

    found = {
        f"first_{kind}": [only_first("usable and listed_n > 0")],
        f"dup_{kind}": [of("usable and listed_n > 1", "listed", double)],
        f"shared_{kind}": [only_first("usable and listed_n > 1")],
        f"present_{kind}": [of("is_declared and paid_n > 0", "paid", ok)],
        f"undeclared_{kind}": [of("not is_declared and paid_n > 0", "paid", Rubric.PAID_NOT_DECLARED)],
        f"declared_first_{kind}": [Share("is_declared", "1", "1", head="declared_head")],
        f"declared_dup_{kind}": [Share("is_declared and declared_n > 1", "declared_n", "1", head="declared_head")],
    }
    lists = elsewhere_terms(book)
    picked = lambda column: fx.case_sql([(f"terms_number = {i}", column(t)) for i, t in enumerate(lists)], "null")
    for names, prefix in (([f"elsewhere_{kind}"], "else"), ([f"elsewhere_{kind}_pos", f"paid_elsewhere_{kind}"], "else_paid")):
        first = amount = None
        if lists:
            amount = tuple(picked(lambda t, part=part: f"{prefix}_{t}_{part}") for part in PARTS)
            first = of_head(picked(lambda t: f"{prefix}_head.{t}")) if book.ranked(Rubric.PAID_ELSEWHERE) else None
        share = Share(f"is_declared and listed_n > 0 and {prefix}_n > 0", f"{prefix}_n", "1", amount, first, f"{prefix}_head")
        found |= dict.fromkeys(names, [share])
    if key == ID:
        by_id = Share("usable and listed_n > 0", None, "1", head="listed_head", mark="M:")
        return found | {
            "listing": [by_id], "identifiers": [by_id],
            "missing_id": [of("not usable and listed_n > 0", "listed", Rubric.MISSING_ID, None, False)],
            "validation": [Share("usable and nameless_n > 0", None, "1", head="nameless_head", mark="M:")],
            "declared": [Share("true", "declared_n"), Share("is_declared", None, "1", head="declared_head", mark="M:")],
            "declared_missing_id": [Share("not usable", "declared_n")],
        }
    # Persons without identifier go by name; each line without either is a person of its own.
    by_name = Share("no_id_n > 0", None, "if(usable, 1, no_id_n)", head="no_id_head", mark="N:")
    sheet = Share("declared_no_id_n > 0", None, "if(usable, 1, declared_no_id_n)", head="declared_no_id_head", mark="N:")
    whole = of("listed_n > 0", "listed", Rubric.ANY, None, False)
    return found | {
        "listing": [whole, by_name], "identifiers": [whole, by_name], "missing_id": [by_name],
        "validation": [of("doubtful_n > 0", "doubtful", Rubric.ANY, None, False), by_name],
        "declared": [sheet], "declared_missing_id": [sheet],
    }


def wanted(book: Book, key: str, names: list[str]) -> dict[str, list[Share]]:
    return {name: found for name, found in shares(book, key).items() if not names or name in names}


def per_scope(rows: DataFrame, book: Book, key: str, names: list[str]) -> DataFrame:
    """(scope, annex, row_count, people, impact) of one key, from sums over its rows; equal sums are taken once."""
    sums: dict[str, str] = {}

    def total(values: list[tuple[str, str | None]]) -> str | None:
        added = [f"coalesce(if({test}, cast({value} as bigint), null), 0)" for test, value in values if value]
        return sums.setdefault(" + ".join(added), f"sum_{len(sums)}") if added else None

    def total_money(values: list[tuple[str, tuple[str, ...] | None]]) -> str | None:
        parts = [total([(test, value and value[i]) for test, value in values]) for i in range(len(PARTS))]
        return money_of(*parts) if all(parts) else None

    entries = []
    for name, parts in wanted(book, key, names).items():
        lines, people = total([(s.test, s.lines) for s in parts]), total([(s.test, s.people) for s in parts])
        amount, first = total_money([(s.test, s.amount) for s in parts]), total_money([(s.test, s.first) for s in parts])
        rubric = BY_NAME[name].rubric
        impact = book.impact(rubric, amount, first or "0") if amount and rubric else "0"
        entries.append(f"struct('{name}' as annex, cast({lines or 0} as bigint) as row_count, "
                       f"cast({people or 0} as bigint) as people, cast({impact} as {SUM}) as impact)")
    # What each row adds is a column before it is summed: sums of plain columns need little generated code.
    added = rows.selectExpr(*SCOPE, *(f"{value} as {name}" for value, name in sums.items()))
    summed = added.groupBy(*SCOPE).agg(*(F.expr(f"sum({name}) as {name}") for name in sums.values()))
    return summed.selectExpr(*SCOPE, f"inline(array({', '.join(entries)}))")


def pack_summary(
    lines: DataFrame, declared: DataFrame, rules: list[FilterRule], formulas: list[fx.Formula], names: list[str] = (),
    keys: list[str] = SCOPE, forced: fx.Formula | None = None,
) -> DataFrame:
    """Lines, persons and impact per annex that has lines; a forced formula takes the place of those of all rubrics."""
    book = Book(tuple(formulas), forced)
    parts = [per_scope(figures(lines, declared, rules, book, key), book, key, names) for key in (ID, NAME) if wanted(book, key, names)]
    family = F.create_map(*[F.lit(x) for a in ANNEXES for x in (a.name, a.family)])
    sums = [f"sum({c}) as {c}" for c in ("row_count", "people")]
    found = reduce(DataFrame.unionByName, parts).groupBy(*keys, "annex").agg(*map(F.expr, [*sums, f"cast(sum(impact) as {SUM}) as impact"]))
    return found.where("row_count > 0").select(*keys, family[F.col("annex")].alias("family"), "annex", "row_count", "people", "impact")


# --- people --------------------------------------------------------------------------


def own_people(rows: DataFrame, line: str, names: list[str]) -> DataFrame:
    """Lines with neither identifier nor name: each is a person of its own in every one of the annexes."""
    alone = rows.where(~usable_id(F.col(ID)) & ~has_name(F.col(NAME)))
    annexes = F.explode(F.array(*[F.lit(n) for n in names])).alias("annex")
    return alone.select(*SCOPE, annexes, F.concat(F.lit("L:"), line).alias("concerned"), F.col(line).alias("line_id"))


def pack_people(lines: DataFrame, declared: DataFrame, rules: list[FilterRule], names: list[str] = ()) -> DataFrame:
    """(scope, annex, concerned, line_id): the first line of every person of every annex.

    The first lines come from the same rows per key as the sums; only lines without any key are read one by one.
    """
    book = Book(())
    parts = []
    for key in (ID, NAME):
        entries = []
        for name, of_key in wanted(book, key, names).items():
            line = "declared_id" if name.startswith("declared") else "line_id"
            for share in of_key:
                if share.head:
                    test, who = (f"usable and {share.test}", f"concat('{share.mark}', {key})") if share.mark else (share.test, key)
                    entries.append(f"if({test}, struct('{name}' as annex, {who} as concerned, {share.head}.{line} as line_id), null)")
        if entries:
            rows = figures(lines, declared, rules, book, key, heads=True)
            parts.append(rows.selectExpr(*SCOPE, f"inline(array_compact(array({', '.join(entries)})))"))
    if alone := [n for n in ("listing", "identifiers", "missing_id", "validation") if not names or n in names]:
        parts.append(own_people(lines.where(retained(rules)), "line_id", alone))
    if alone := [n for n in ("declared", "declared_missing_id") if not names or n in names]:
        parts.append(own_people(declared, "declared_id", alone))
    return reduce(DataFrame.unionByName, parts)
