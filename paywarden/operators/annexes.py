"""The annex pack: the detail lists behind a control report, for every scope at once.

Each annex has a small plan of its own. ``annex_summary`` does not run them one
after the other: it annotates the listing and the declarations once and lets
every line tell in which annexes it is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paywarden.functions import formulas as fx
from paywarden.functions.filters import FilterRule, own_predicate, retained
from paywarden.functions.money import total
from paywarden.functions.text import has_name, person_key, spread_key, usable_id
from paywarden.operators.ranking import first_by, flag_first, repeated
from paywarden.schema import LINE_ORDER, MONEY, MONEY_SUM, Rubric, SCOPE

LISTING, DECLARED, COMPARISON = "listing", "declared", "comparison"
NO_RUBRIC = None

#: Order of the declared lines; a declaration has no more than one import per version.
DECLARED_ORDER = ["source_row", "execution_id", "declared_id"]


@dataclass(frozen=True)
class Annex:
    """Name, family, rubric of the impact, key of the rank, key that identifies a person."""

    name: str
    family: str
    rubric: str | None
    rank_key: str
    person: str


ID, NAME, PERSON = "staff_key", "name_key", "person"

ANNEXES = [
    Annex("listing", LISTING, Rubric.ANY, NAME, PERSON),
    Annex("missing_id", LISTING, Rubric.MISSING_ID, ID, PERSON),
    Annex("validation", LISTING, Rubric.ANY, NAME, PERSON),
    Annex("identifiers", LISTING, Rubric.ANY, NAME, PERSON),
    Annex("first_id", LISTING, Rubric.ANY, ID, ID),
    Annex("dup_id", LISTING, Rubric.DUPLICATE_ID, ID, ID),
    Annex("shared_id", LISTING, Rubric.ANY, ID, ID),
    Annex("first_name", LISTING, Rubric.ANY, NAME, NAME),
    Annex("dup_name", LISTING, Rubric.DUPLICATE_NAME, NAME, NAME),
    Annex("shared_name", LISTING, Rubric.ANY, NAME, NAME),
    Annex("elsewhere_id", LISTING, Rubric.PAID_ELSEWHERE, ID, ID),
    Annex("elsewhere_id_pos", LISTING, Rubric.PAID_ELSEWHERE, ID, ID),
    Annex("elsewhere_name", LISTING, Rubric.PAID_ELSEWHERE, NAME, NAME),
    Annex("elsewhere_name_pos", LISTING, Rubric.PAID_ELSEWHERE, NAME, NAME),
    Annex("declared", DECLARED, NO_RUBRIC, ID, PERSON),
    Annex("declared_missing_id", DECLARED, NO_RUBRIC, ID, PERSON),
    Annex("declared_first_id", DECLARED, NO_RUBRIC, ID, ID),
    Annex("declared_dup_id", DECLARED, NO_RUBRIC, ID, ID),
    Annex("declared_first_name", DECLARED, NO_RUBRIC, NAME, NAME),
    Annex("declared_dup_name", DECLARED, NO_RUBRIC, NAME, NAME),
    Annex("paid_elsewhere_id", COMPARISON, Rubric.PAID_ELSEWHERE, ID, ID),
    Annex("present_id", COMPARISON, Rubric.OK_BY_ID, ID, ID),
    Annex("undeclared_id", COMPARISON, Rubric.PAID_NOT_DECLARED, ID, ID),
    Annex("paid_elsewhere_name", COMPARISON, Rubric.PAID_ELSEWHERE, NAME, NAME),
    Annex("present_name", COMPARISON, Rubric.OK_BY_NAME, NAME, NAME),
    Annex("undeclared_name", COMPARISON, Rubric.PAID_NOT_DECLARED, NAME, NAME),
]
BY_NAME = {annex.name: annex for annex in ANNEXES}

#: Headline findings of the covering letter: label and annex.
FINDINGS = {
    "missing_id": "missing_id",
    "duplicates_by_id": "dup_id",
    "duplicates_by_name": "dup_name",
    "declared_present": "present_id",
    "undeclared": "undeclared_id",
    "paid_elsewhere": "elsewhere_id",
}


def valid(key: str) -> Column:
    return usable_id(F.col(key)) if key == ID else has_name(F.col(key))


def paid_something() -> Column:
    return F.col("gross_pay") > 0


# --- listing and declaration annexes -------------------------------------------------


def missing_id(rows: DataFrame) -> DataFrame:
    return rows.where(~usable_id(F.col(ID)))


def validation(rows: DataFrame) -> DataFrame:
    return rows.where(~usable_id(F.col(ID)) | ~has_name(F.col(NAME)))


def first_per(rows: DataFrame, key: str, order: list[str] = LINE_ORDER) -> DataFrame:
    """The first line of each key of a scope."""
    return first_by(rows.where(valid(key)), [key, *SCOPE], order)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """All lines of the keys that occur more than once in a scope."""
    return repeated(rows.where(valid(key)), [key, *SCOPE])


def shared_once(rows: DataFrame, key: str, order: list[str] = LINE_ORDER) -> DataFrame:
    """The first line of each key that occurs more than once; one aggregation."""
    return first_by(rows.where(valid(key)), [key, *SCOPE], order, min_rows=2)


# --- comparisons ---------------------------------------------------------------------


def declared_keys(declared: DataFrame, key: str) -> DataFrame:
    return declared.where(valid(key)).select(*SCOPE, key).distinct()


def present(listing: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Paid lines of the listing whose key is declared in the same scope."""
    return listing.where(valid(key) & paid_something()).join(declared_keys(declared, key), [key, *SCOPE], "left_semi")


def undeclared(listing: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Paid lines of the listing whose key is not declared. A line without usable key is never declared."""
    keys = declared_keys(declared, key).withColumnRenamed(key, "key_join")
    spread = spread_key(F.col(key), valid(key), F.col("line_id"))
    paid = listing.where(paid_something()).withColumn("key_join", spread)
    return paid.join(keys, ["key_join", *SCOPE], "left_anti").drop("key_join")


def elsewhere(lines: DataFrame, declared: DataFrame, rules: list[FilterRule], key: str) -> DataFrame:
    """Lines of the regime and period outside a filtered scope, of persons declared and listed in it.

    ``institution_id`` is the controlled institution, ``paying_institution`` the one
    of the line. The cohort is distinct, so a line appears once per controlling
    institution.
    """
    listed = lines.where(retained(rules) & valid(key)).select(*SCOPE, key).distinct()
    cohort = declared_keys(declared, key).join(listed, [key, *SCOPE], "left_semi")
    cohort = cohort.withColumnRenamed("institution_id", "control_institution")
    outside = lines.where(valid(key)).withColumn("passes_own", own_predicate(rules))
    found = outside.join(cohort, [key, "regime", "quarter", "year"])
    same = F.col("institution_id") == F.col("control_institution")
    kept = found.where(F.when(same, ~F.col("passes_own")).otherwise(True))
    return (
        kept.drop("passes_own")
        .withColumnRenamed("institution_id", "paying_institution")
        .withColumnRenamed("control_institution", "institution_id")
    )


# --- impact and people ---------------------------------------------------------------


def with_impact(rows: DataFrame, formulas: list[fx.Formula], annex: Annex) -> DataFrame:
    """Impact by the formula of the annex's rubric. First lines are looked up only for formulas that need them."""
    if annex.rubric is None:
        return rows.withColumns({"formula_id": F.lit(fx.NO_FORMULA), "impact": F.lit(0).cast(MONEY)})
    valued = rows.withColumn("formula_id", fx.resolve_id(formulas, annex.rubric))
    if fx.any_ranked(formulas, [annex.rubric]):
        valued = flag_first(valued, [annex.rank_key, *SCOPE], identity=["line_id", *SCOPE])
        return fx.with_value(valued, formulas, "impact", first="first_line").drop("first_line")
    return fx.with_value(valued, formulas, "impact")


def annex_person(annex: Annex, line_id: str = "line_id") -> Column:
    if annex.person == PERSON:
        return person_key(F.col(ID), F.col(NAME), F.col(line_id))
    return F.col(annex.person)


def annex_people(rows: DataFrame, annex: Annex, order: list[str] = LINE_ORDER) -> DataFrame:
    """One representative line per person concerned by an annex."""
    line_id = order[-1]
    keyed = rows.withColumn("concerned", annex_person(annex, line_id))
    return first_by(keyed, ["concerned", *SCOPE], order)


def annex(name: str, lines: DataFrame, declared: DataFrame, rules: list[FilterRule], formulas: list[fx.Formula]) -> DataFrame:
    """One annex by name, with its impact.

    A line of the own listing whose amount depends on nothing but itself is valued first, so that its amount moves in
    place of all that the formulas read.
    """
    listing, about = lines.where(retained(rules)), BY_NAME[name]
    own = about.rubric is not None and Rubric.PAID_ELSEWHERE != about.rubric
    early = own and not fx.any_ranked(formulas, [about.rubric])
    if early:
        listing = with_impact(listing, formulas, about)
    positive = lambda rows: rows.where(paid_something())
    build = {
        "listing": lambda: listing,
        "identifiers": lambda: listing,
        "missing_id": lambda: missing_id(listing),
        "validation": lambda: validation(listing),
        "first_id": lambda: first_per(listing, ID),
        "dup_id": lambda: duplicates(listing, ID),
        "shared_id": lambda: shared_once(listing, ID),
        "first_name": lambda: first_per(listing, NAME),
        "dup_name": lambda: duplicates(listing, NAME),
        "shared_name": lambda: shared_once(listing, NAME),
        "elsewhere_id": lambda: elsewhere(lines, declared, rules, ID),
        "elsewhere_id_pos": lambda: positive(elsewhere(lines, declared, rules, ID)),
        "elsewhere_name": lambda: elsewhere(lines, declared, rules, NAME),
        "elsewhere_name_pos": lambda: positive(elsewhere(lines, declared, rules, NAME)),
        "paid_elsewhere_id": lambda: positive(elsewhere(lines, declared, rules, ID)),
        "paid_elsewhere_name": lambda: positive(elsewhere(lines, declared, rules, NAME)),
        "declared": lambda: declared,
        "declared_missing_id": lambda: missing_id(declared),
        "declared_first_id": lambda: first_per(declared, ID, DECLARED_ORDER),
        "declared_dup_id": lambda: duplicates(declared, ID),
        "declared_first_name": lambda: first_per(declared, NAME, DECLARED_ORDER),
        "declared_dup_name": lambda: duplicates(declared, NAME),
        "present_id": lambda: present(listing, declared, ID),
        "present_name": lambda: present(listing, declared, NAME),
        "undeclared_id": lambda: undeclared(listing, declared, ID),
        "undeclared_name": lambda: undeclared(listing, declared, NAME),
    }
    return build[name]() if early else with_impact(build[name](), formulas, about)


# --- the whole pack in one pass ------------------------------------------------------


def key_figures(listing: DataFrame, declared: DataFrame, key: str, prefix: str) -> DataFrame:
    """Per scope and key: lines, first lines, declared or not; ready to join by spread key.

    First lines are looked up for all lines, for those with a positive gross, and
    for those in the validation annex, because a rank counts inside its annex.
    """
    order = F.struct(*LINE_ORDER)
    doubtful = ~usable_id(F.col(ID)) | ~has_name(F.col(NAME))
    figures = listing.groupBy(key, *SCOPE).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(order).alias("head"),
        F.min(F.when(paid_something(), order)).alias("head_pos"),
        F.min(F.when(doubtful, order)).alias("head_val"),
    )
    known = declared_keys(declared, key).withColumn("is_declared", F.lit(True))
    joined = figures.join(known, [key, *SCOPE], "left")
    heads = [F.col(f"{h}.line_id").alias(f"{prefix}_{h}") for h in ("head", "head_pos", "head_val")]
    flat = joined.select(
        *SCOPE, key, *heads,
        F.when(valid(key), F.col("n")).otherwise(F.lit(0)).alias(f"{prefix}_lines"),
        F.coalesce("is_declared", F.lit(False)).alias(f"{prefix}_declared"),
    )
    firsts = F.array_distinct(F.array_compact(F.array(*[F.col(f"{prefix}_{h}") for h in ("head", "head_pos", "head_val")])))
    unusable = F.transform(firsts, lambda i: F.concat(F.lit("~"), i))
    join_keys = F.when(valid(key), F.array(F.col(key))).otherwise(unusable)
    return flat.withColumn(f"{prefix}_join", F.explode(join_keys)).drop(key)


def annotate(listing: DataFrame, declared: DataFrame) -> DataFrame:
    """The listing with the counts, first-line flags and declared flags all its annexes need."""
    staff, name, line = F.col(ID), F.col(NAME), F.col("line_id")
    keyed = listing.withColumns(
        {"id_join": spread_key(staff, usable_id(staff), line), "name_join": spread_key(name, has_name(name), line)}
    )
    rows = keyed.join(key_figures(listing, declared, ID, "id"), ["id_join", *SCOPE], "left")
    rows = rows.join(key_figures(listing, declared, NAME, "name"), ["name_join", *SCOPE], "left")
    flags = {}
    for prefix in ("id", "name"):
        for head in ("head", "head_pos", "head_val"):
            flags[f"{prefix}_{head}"] = F.coalesce(F.col(f"{prefix}_{head}") == line, F.lit(False))
        flags[f"{prefix}_lines"] = F.coalesce(f"{prefix}_lines", F.lit(0))
        flags[f"{prefix}_declared"] = F.coalesce(f"{prefix}_declared", F.lit(False))
    return rows.withColumns(flags).drop("id_join", "name_join")


#: First-line flags of an annotated line. A rank counts inside its annex, so each annex names the flag that holds there.
ALWAYS, ID_HEAD, NAME_HEAD, NAME_HEAD_VAL, ID_HEAD_POS, NAME_HEAD_POS = range(6)


def membership() -> dict[str, tuple[Column, int]]:
    """Per annex of the listing: whether a line is in it, and its first-line flag there."""
    col, yes = F.col, F.lit(True)
    has_id, named, paid = usable_id(col(ID)), has_name(col(NAME)), paid_something()
    return {
        "listing": (yes, NAME_HEAD),
        "identifiers": (yes, NAME_HEAD),
        "missing_id": (~has_id, ID_HEAD),
        "validation": (~has_id | ~named, NAME_HEAD_VAL),
        "first_id": (has_id & col("id_head"), ALWAYS),
        "dup_id": (col("id_lines") > 1, ID_HEAD),
        "shared_id": ((col("id_lines") > 1) & col("id_head"), ALWAYS),
        "first_name": (named & col("name_head"), ALWAYS),
        "dup_name": (col("name_lines") > 1, NAME_HEAD),
        "shared_name": ((col("name_lines") > 1) & col("name_head"), ALWAYS),
        "present_id": (paid & col("id_declared"), ID_HEAD_POS),
        "undeclared_id": (paid & ~col("id_declared"), ID_HEAD_POS),
        "present_name": (paid & col("name_declared"), NAME_HEAD_POS),
        "undeclared_name": (paid & ~col("name_declared"), NAME_HEAD_POS),
    }


def constant(values: list) -> Column:
    return F.array(*[F.lit(v).cast("string") if v is None else F.lit(v) for v in values])


def exploded(
    rows: DataFrame, members: dict[str, tuple[Column, int]], flags: list[Column], line_id: str, carried: list[str]
) -> DataFrame:
    """One row per line and annex it belongs to, with family, rubric, first-line flag and person.

    Only the number of the annex is exploded; everything about it is looked up by
    that number, which keeps the generated code small.
    """
    names = list(members)
    numbers = F.array_compact(F.array(*[F.when(member, F.lit(i)) for i, (member, _) in enumerate(members.values())]))
    people = F.array(person_key(F.col(ID), F.col(NAME), F.col(line_id)), F.col(ID), F.col(NAME))
    entries = rows.select(
        *SCOPE, *carried, F.array(F.lit(True), *flags).alias("firsts"), people.alias("people"), F.explode(numbers).alias("no")
    )
    about = [BY_NAME[name] for name in names]
    kinds = {PERSON: 0, ID: 1, NAME: 2}
    look_up = lambda values: F.get(constant(values), F.col("no"))
    return entries.select(
        *SCOPE,
        *carried,
        look_up(names).alias("annex"),
        look_up([a.family for a in about]).alias("family"),
        look_up([a.rubric for a in about]).alias("rubric"),
        F.get("firsts", look_up([flag for _, flag in members.values()])).alias("first_line"),
        F.get("people", look_up([kinds[a.person] for a in about])).alias("concerned"),
    )


#: Flags of a line found elsewhere.
FIRST, FIRST_POS = 1, 2


def elsewhere_members(key: str) -> dict[str, tuple[Column, int]]:
    kind, paid = ("id" if key == ID else "name"), paid_something()
    return {
        f"elsewhere_{kind}": (F.lit(True), FIRST),
        f"elsewhere_{kind}_pos": (paid, FIRST_POS),
        f"paid_elsewhere_{kind}": (paid, FIRST_POS),
    }


def flag_elsewhere(rows: DataFrame, key: str) -> DataFrame:
    """First lines among all lines found elsewhere and among the paid ones.

    The flags come back by line id, one row per first line, so a large key does
    not reach the join.
    """
    order = F.struct(*LINE_ORDER)
    firsts = rows.groupBy(key, *SCOPE).agg(
        F.min(order).alias("a"), F.min(F.when(paid_something(), order)).alias("p")
    )
    both = F.col("a.line_id") == F.col("p.line_id")
    entry = lambda line, first, pos: F.struct(
        F.col(line).alias("line_id"), F.lit(first).alias("first_line"), pos.alias("first_pos")
    )
    entries = F.array(
        entry("a.line_id", True, F.coalesce(both, F.lit(False))),
        F.when(~both, entry("p.line_id", False, F.lit(True))),
    )
    marks = firsts.select(*SCOPE, F.inline(F.array_compact(entries)))
    marked = rows.join(marks, ["line_id", *SCOPE], "left")
    return marked.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("first_line", "first_pos")})


def pack_entries(
    lines: DataFrame, declared: DataFrame, rules: list[FilterRule], formulas: list[fx.Formula], names: list[str] = ()
) -> DataFrame:
    """Every (annex, line) of the pack, or of the named annexes, with its person and impact."""
    wanted = lambda members: {n: m for n, m in members.items() if not names or n in names}
    money = [c for c in [*fx.BUILT_IN_COMPONENTS.values(), "extra_components"] if c in lines.columns]
    col = F.col
    flags = [col("id_head"), col("name_head"), col("name_head_val"), col("id_head_pos"), col("name_head_pos")]
    parts = []
    if local := wanted(membership()):
        parts.append(exploded(annotate(lines.where(retained(rules)), declared), local, flags, "line_id", money))
    for key in (ID, NAME):
        if not (outside := wanted(elsewhere_members(key))):
            continue
        rows = elsewhere(lines, declared, rules, key)
        flags = [F.lit(False), F.lit(False)]
        if fx.any_ranked(formulas, [Rubric.PAID_ELSEWHERE]):
            rows, flags = flag_elsewhere(rows, key), [col("first_line"), col("first_pos")]
        parts.append(exploded(rows, outside, flags, "line_id", money))
    of_declared = declared_entries(declared, wanted)
    if not parts:
        return of_declared
    entries = reduce(DataFrame.unionByName, parts)
    resolved = entries.withColumn("formula_id", fx.resolve_by(formulas, "rubric", Rubric.ALL, fx.NO_FORMULA))
    valued = fx.with_value(resolved, formulas, "impact", first="first_line")
    valued = valued.select(*SCOPE, "annex", "family", "concerned", "impact")
    return valued if of_declared is None else valued.unionByName(of_declared)


def declared_entries(declared: DataFrame, wanted) -> DataFrame | None:
    """Entries of the declared annexes that are wanted, if any."""
    line = F.col("declared_id")
    rows = declared
    for key, prefix in ((ID, "id"), (NAME, "name")):
        figures = declared.where(valid(key)).groupBy(key, *SCOPE).agg(
            F.count(F.lit(1)).alias(f"{prefix}_lines"), F.min(F.struct(*DECLARED_ORDER)).alias("h")
        )
        figures = figures.select(
            *SCOPE, F.col(key).alias(f"{prefix}_join"), f"{prefix}_lines", F.col("h.declared_id").alias(f"{prefix}_head")
        )
        rows = rows.withColumn(f"{prefix}_join", spread_key(F.col(key), valid(key), line))
        rows = rows.join(figures, [*SCOPE, f"{prefix}_join"], "left")
    col = F.col
    tests = {
        "declared": F.lit(True),
        "declared_missing_id": ~usable_id(col(ID)),
        "declared_first_id": col("id_head") == line,
        "declared_dup_id": col("id_lines") > 1,
        "declared_first_name": col("name_head") == line,
        "declared_dup_name": col("name_lines") > 1,
    }
    members = wanted({name: (test, ALWAYS) for name, test in tests.items()})
    if not members:
        return None
    entries = exploded(rows, members, [], "declared_id", [])
    return entries.select(*SCOPE, "annex", "family", "concerned", F.lit(0).cast(MONEY).alias("impact"))


def annex_summary(entries: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """Lines, persons and impact per annex.

    Persons are reduced to one row each before they are counted, so the two
    shuffles carry persons, not lines, and no annex is one task's work.
    """
    per_person = entries.groupBy("concerned", "annex", "family", *SCOPE).agg(
        F.count(F.lit(1)).alias("n"), F.sum("impact").cast(MONEY_SUM).alias("impact")
    )
    return per_person.groupBy(*keys, "family", "annex").agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("people"), total(F.col("impact")).alias("impact")
    )


def annex_overview(summary: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Annexes, lines, persons and impact per family."""
    return summary.groupBy(*keys, "family").agg(
        F.count_distinct("annex").alias("annexes"), F.sum("row_count").alias("row_count"),
        F.sum("people").alias("people"), total(F.col("impact")).alias("impact"),
    )


def findings(summary: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The headline findings."""
    label = F.create_map(*[F.lit(x) for finding, name in FINDINGS.items() for x in (name, finding)])
    named = summary.where(F.col("annex").isin(list(FINDINGS.values()))).withColumn("finding", label[F.col("annex")])
    return named.groupBy(*keys, "finding").agg(
        F.sum("row_count").alias("row_count"), F.sum("people").alias("people"), total(F.col("impact")).alias("impact")
    )
