"""Imports and withdrawals of data, with guards and a journal that only grows.

Plain files know no update. A withdrawal rewrites the scopes it touches, drops
those that end up empty, and adds a journal entry.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paywarden.functions.filters import in_scope
from paywarden.schema import DECLARED_LINE, PAY_LINE, SCOPE, SCOPE_LAYOUT
from paywarden.sources import mapping as mp, writers
from paywarden.sources.commits import Tables

IMPORT_PAY, IMPORT_DECLARED = "IMPORT_PAY", "IMPORT_DECLARED"


@dataclass(frozen=True)
class Store:
    """Folders of the tables."""

    root: str

    @property
    def pay(self) -> str:
        return f"{self.root}/pay_line"

    @property
    def declared(self) -> str:
        return f"{self.root}/declared_line"

    @property
    def journal(self) -> str:
        return f"{self.root}/journal"

    @property
    def schemas(self) -> str:
        return f"{self.root}/captured_schema"

    @property
    def results(self) -> str:
        return f"{self.root}/matching_result"

    def raw(self, regime: str) -> str:
        return f"{self.root}/raw_{regime.lower()}"


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    return writers.read_lines(spark, path, schema) if writers.exists(spark, path) else spark.createDataFrame([], schema)


def log(spark: SparkSession, store: Store, **values) -> None:
    writers.journal_entry(spark, **values).write.mode("append").parquet(store.journal)


def import_pay(
    raw: DataFrame, store: Store, scope: dict[str, object], mode: str = "append",
    mapping: dict[str, str] | None = None, required: list[str] = (), source_file: str = "",
) -> str:
    """Load a listing: raw copy, standard lines and journal entry. Returns the import's id."""
    spark = raw.sparkSession
    absent = mp.missing_columns(raw.columns, list(required))
    if absent:
        raise ValueError("Required columns missing: " + ", ".join(absent))
    execution_id = uuid.uuid4().hex
    values = {**scope, "execution_id": execution_id, "source_table": scope.get("source_table", source_file)}
    lines = mp.standardise_pay(raw, values, mapping)
    if mode == "replace":
        writers.replace_scopes(lines, store.pay, [scope])
    else:
        writers.append_lines(lines, store.pay)
    kept_raw, observed = writers.counted(writers.with_lineage(raw, execution_id, scope["quarter"], scope["year"]), "raw_lines")
    writers.write_raw(kept_raw, store.raw(scope["regime"]))
    rows = observed.get["rows"]
    log(spark, store, execution_id=execution_id, operation=IMPORT_PAY, source_file=source_file, mode=mode,
        rows_read=rows, rows_loaded=rows, status="DONE", **{c: scope[c] for c in SCOPE})
    return execution_id


def import_declared(
    raw: DataFrame, store: Store, scope: dict[str, object], mode: str = "append", mapping: dict[str, str] | None = None,
    required: list[str] = (), source_file: str = "", sheet: str = "", results: DataFrame | None = None,
    campaigns: DataFrame | None = None,
) -> str:
    """Load a declaration after checking its structure, its content and, before replacing one, its use."""
    spark = raw.sparkSession
    structure = mp.describe_structure(mp.source_columns(raw), mapping, list(required))
    if not structure.ready:
        raise ValueError("The declaration does not fit: " + "; ".join(structure.issues))
    execution_id = uuid.uuid4().hex
    values = {**scope, "execution_id": execution_id, "source_file": source_file, "source_sheet": sheet}
    lines = mp.standardise_declared(raw, values, structure.mapping)
    quality = mp.declared_quality(lines).first()
    mp.check_declared(quality)
    if mode == "replace":
        current = read_or_empty(spark, store.declared, DECLARED_LINE).where(in_scope(**scope_only(scope)))
        guard(uses(current, "declared_id", results, campaigns))
        writers.replace_scopes(lines, store.declared, [scope])
    else:
        writers.append_lines(lines, store.declared)
    schema = mp.captured_schema(raw, execution_id, structure.mapping, list(required))
    schema.write.mode("append").parquet(store.schemas)
    log(spark, store, execution_id=execution_id, operation=IMPORT_DECLARED, source_file=source_file, mode=mode,
        rows_read=quality["row_count"], rows_loaded=quality["row_count"], status="DONE", **{c: scope[c] for c in SCOPE})
    return execution_id


def scope_only(scope: dict[str, object]) -> dict[str, object]:
    return {c: scope[c] for c in SCOPE}


# --- use by analyses -----------------------------------------------------------------


def uses(lines: DataFrame, line_id: str, results: DataFrame | None, runs: DataFrame | None) -> DataFrame:
    """How many matching runs refer to the lines, and how many other runs to their imports."""
    spark = lines.sparkSession
    none = spark.range(1).select(F.lit(0).cast("long").alias("n"))
    matching = none
    if results is not None:
        used = results.where(F.col(line_id).isNotNull()).select(line_id, "run_id").distinct()
        matching = used.join(lines.select(line_id), line_id, "left_semi").agg(F.count_distinct("run_id").alias("n"))
    other = none
    if runs is not None:
        imports = lines.select("execution_id").distinct()
        other = runs.join(imports, "execution_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return matching.select(F.lit("matching").alias("analysis"), "n").unionByName(
        other.select(F.lit("campaign").alias("analysis"), "n")
    )


def guard(usage: DataFrame) -> None:
    """Refuse to touch data that results refer to."""
    found = [f"{row.n} {row.analysis} run(s)" for row in usage.where("n > 0").collect()]
    if found:
        raise ValueError("The data are used by " + " and ".join(found) + ". Add a new version instead.")


def inspect_scopes(lines: DataFrame, results: DataFrame, campaign_sources: DataFrame, listing_sources: DataFrame,
                   keys: list[str] = SCOPE) -> DataFrame:
    """Lines, imports and use of each scope."""
    counted = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("execution_id").alias("executions")
    )
    used = results.where("line_id is not null").select("line_id", "run_id").distinct()
    matching = lines.select(*keys, "line_id").join(used, "line_id").groupBy(*keys).agg(
        F.count_distinct("run_id").alias("matching_runs")
    )
    imports = lines.select(*keys, "execution_id").distinct()
    by_sources = lambda runs, out: (
        imports.join(runs.select("execution_id"), "execution_id").groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    )
    joined = counted.join(matching, keys, "left")
    joined = joined.join(by_sources(campaign_sources, "campaigns"), keys, "left")
    joined = joined.join(by_sources(listing_sources, "listing_groups"), keys, "left")
    return joined.fillna(0, ["matching_runs", "campaigns", "listing_groups"])


# --- withdrawals ---------------------------------------------------------------------


def kept(rows: DataFrame, delete: Column) -> DataFrame:
    """What a deletion leaves: rows for which the condition is false or unknown."""
    return rows.where(~F.coalesce(delete, F.lit(False)))


def deletion_counts(tables: dict[str, DataFrame], delete: Column) -> DataFrame:
    """Rows a deletion removes from each table."""
    counts = None
    for name, rows in sorted(tables.items()):
        count = rows.agg(F.count_if(delete).alias("deleted"), F.count_if(~F.coalesce(delete, F.lit(False))).alias("kept"))
        count = count.select(F.lit(name).alias("table_name"), "deleted", "kept")
        counts = count if counts is None else counts.unionByName(count)
    return counts


def delete_rows(spark: SparkSession, path: str, schema, delete: Column) -> int:
    """Rewrite the scopes that hold rows to delete. Returns the number of deleted rows."""
    rows = writers.read_lines(spark, path, schema)
    gone = F.coalesce(delete, F.lit(False))
    touched = rows.groupBy(*SCOPE).agg(F.count_if(gone).alias("n"), F.count_if(~gone).alias("left")).where("n > 0")
    scopes = [row.asDict() for row in touched.collect()]  # one row per scope
    if not scopes:
        return 0
    some = spark.createDataFrame([[s[c] for c in SCOPE] for s in scopes if s["left"]], rows.select(*SCOPE).schema)
    writers.replace_scopes(kept(rows, delete).join(F.broadcast(some), SCOPE, "left_semi"), path)
    for scope in scopes:
        if not scope["left"]:
            writers.drop_partition(spark, path, scope)
    return sum(scope["n"] for scope in scopes)


def delete_declared_import(spark: SparkSession, store: Store, execution_id: str, results=None, campaigns=None) -> int:
    """Withdraw an unused declaration import; the journal keeps a trace."""
    entries = writers.current_journal(read_or_empty(spark, store.journal, writers.JOURNAL))
    found = entries.where((F.col("execution_id") == execution_id) & (F.col("operation") == IMPORT_DECLARED)
                          & (F.col("status") != "DELETED")).collect()
    if not found:
        raise ValueError("Declaration import not found or already withdrawn.")
    mine = F.col("execution_id") == execution_id
    lines = writers.read_lines(spark, store.declared, DECLARED_LINE).where(mine)
    guard(uses(lines, "declared_id", results, campaigns))
    deleted = delete_rows(spark, store.declared, DECLARED_LINE, mine)
    for entry in found:
        log(spark, store, execution_id=execution_id, operation=IMPORT_DECLARED, source_file=entry.source_file,
            mode=entry.mode, rows_read=entry.rows_read, rows_loaded=entry.rows_loaded, status="DELETED",
            message=f"Withdrawn ({deleted} lines)", **{c: entry[c] for c in SCOPE})
    return deleted


def delete_pay_scope(spark: SparkSession, store: Store, scope: dict[str, object], results=None, sources=None) -> int:
    """Withdraw the pay lines of a scope, raw copies included, unless analyses use them. Declarations stay."""
    here = in_scope(**scope_only(scope))
    lines = writers.read_lines(spark, store.pay, PAY_LINE).where(here)
    if lines.isEmpty():
        raise ValueError("There are no pay lines in this scope.")
    guard(uses(lines, "line_id", results, sources))
    executions = [r.execution_id for r in lines.select("execution_id").distinct().collect()]  # one per import
    deleted = delete_rows(spark, store.pay, PAY_LINE, here)
    raw = store.raw(scope["regime"])
    if writers.exists(spark, raw):
        delete_raw(spark, raw, executions)
    if writers.exists(spark, store.schemas):
        delete_schemas(spark, store.schemas, executions)
    for execution_id in executions:
        log(spark, store, execution_id=execution_id, operation=IMPORT_PAY, status="DELETED",
            message="Pay lines withdrawn", **scope_only(scope))
    return deleted


def delete_raw(spark: SparkSession, path: str, executions: list[str]) -> None:
    """Rewrite the periods of the raw copy that hold these imports."""
    period = ["year", "quarter"]
    rows = writers.read_raw(spark, path)
    mine = F.col("execution_id").isin(executions)
    touched = rows.where(mine).select(*period).distinct()
    periods = [tuple(r) for r in touched.collect()]
    remaining = kept(rows.join(touched, period, "left_semi"), mine)
    filled = {tuple(r) for r in remaining.select(*period).distinct().collect()}
    remaining.write.partitionBy(*period).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    for year, quarter in periods:
        if (year, quarter) not in filled:
            target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/year={year}/quarter={quarter}")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def delete_schemas(spark: SparkSession, path: str, executions: list[str]) -> None:
    """Drop the captured columns of withdrawn imports; the new table is written before the old one goes."""
    rows = spark.read.parquet(path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    aside = f"{path}-{uuid.uuid4().hex}"
    kept(rows, F.col("execution_id").isin(executions)).write.parquet(aside)
    files = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path_of(path), True)
    files.rename(path_of(aside), path_of(path))


def delete_scope(spark: SparkSession, store: Store, scope: dict[str, object]) -> dict[str, int]:
    """Empty a scope in the pay, declaration and result tables, without a guard. Returns the three counts."""
    here, counts = in_scope(**scope_only(scope)), {}
    for name, path in (("results", store.results), ("pay", store.pay), ("declared", store.declared)):
        counts[name] = 0
        if writers.exists(spark, path):
            counts[name] = writers.read_lines(spark, path, SCOPE_LAYOUT).where(here).count()
            writers.drop_partition(spark, path, scope)
    return counts


# --- the same on tables that change together -----------------------------------------


def withdraw_import(tables: Tables, execution_id: str, results: DataFrame | None = None, campaigns: DataFrame | None = None) -> int:
    """Withdraw an unused declaration import: lines, captured columns and journal entry change in one commit."""
    entries = writers.current_journal(tables.read("journal"))
    mine = F.col("execution_id") == execution_id
    found = entries.where(mine & (F.col("operation") == IMPORT_DECLARED) & (F.col("status") != "DELETED"))
    if found.isEmpty():
        raise ValueError("Declaration import not found or already withdrawn.")
    guard(uses(tables.read("declared").where(mine), "declared_id", results, campaigns))
    with tables.change() as change:
        deleted = change.delete("declared", mine)
        if "schemas" in change.entries:
            change.delete("schemas", mine)
        change.append("journal", withdrawn_entries(found, f"Withdrawn ({deleted} lines)"))
    return deleted


def withdrawn_entries(found: DataFrame, message: str) -> DataFrame:
    """Journal entries that end the given ones."""
    return found.withColumns({"status": F.lit("DELETED"), "message": F.lit(message), "logged_at": F.current_timestamp()})


def withdraw_pay_scope(tables: Tables, scope: dict[str, object], results: DataFrame | None = None, sources: DataFrame | None = None) -> int:
    """Withdraw the pay lines of a scope with their raw copies and captured columns, unless analyses use them."""
    here = in_scope(**scope_only(scope))
    lines = tables.read("pay").where(here)
    if lines.isEmpty():
        raise ValueError("There are no pay lines in this scope.")
    guard(uses(lines, "line_id", results, sources))
    imports = lines.select("execution_id").distinct()
    mine = F.col("execution_id").isin([r.execution_id for r in imports.collect()])  # one per import
    found = writers.current_journal(tables.read("journal")).where(mine & (F.col("operation") == IMPORT_PAY) & here)
    with tables.change() as change:
        deleted = change.delete("pay", here)
        for name in ("raw", "schemas"):
            if name in change.entries:
                change.delete(name, mine & here if set(SCOPE) <= set(change.read(name).columns) else mine)
        change.append("journal", withdrawn_entries(found, "Pay lines withdrawn"))
    return deleted


def empty_scope(tables: Tables, scope: dict[str, object]) -> dict[str, int]:
    """Empty a scope in the pay, declaration and result tables, without a guard. Returns the counts."""
    here = in_scope(**scope_only(scope))
    with tables.change() as change:
        return {name: change.delete(name, here) for name in ("results", "pay", "declared") if name in change.entries}


# --- configuration and runs ----------------------------------------------------------


def upsert_latest(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row per key of two configuration tables."""
    both = current.unionByName(changes, allowMissingColumns=True)
    newest = F.max_by(F.struct(*both.columns), F.struct(version)).alias("row")
    return both.groupBy(*keys).agg(newest).select("row.*")


def write_run(results: DataFrame, path: str, run_id: str, kind: str) -> None:
    """Write the results of a run, then its header: a run without header never happened."""
    results.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").mode("append").parquet(f"{path}/results")
    header = results.sparkSession.createDataFrame([(run_id, kind)], "run_id string, kind string")
    header.withColumn("finished_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/runs")


def finished_runs(spark: SparkSession, path: str) -> DataFrame:
    """Results of the runs that came to their end."""
    return spark.read.parquet(f"{path}/results").join(spark.read.parquet(f"{path}/runs").select("run_id"), "run_id", "left_semi")
