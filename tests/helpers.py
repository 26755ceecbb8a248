"""Small hand-made inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paywarden.sources.mapping import standardise_declared, standardise_pay

SCOPE = {"institution_id": "I1", "regime": "PNC", "quarter": "T1", "year": 2024}


def raw(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    layout = ", ".join(f"`{c}` string" for c in columns) + ", source_row bigint"
    numbered = [(*[None if v is None else str(v) for v in row], i + 2) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, layout)


def pay(spark, rows, execution="E1", columns=("Matricule", "NomPostnom", "Base"), mapping=None, **scope) -> DataFrame:
    stamps = {**SCOPE, **scope, "execution_id": execution, "source_table": f"table_{execution}"}
    return standardise_pay(raw(spark, list(columns), rows), stamps, mapping)


def declared(spark, rows, execution="D1", columns=("Matricule", "Noms"), **scope) -> DataFrame:
    stamps = {**SCOPE, **scope, "execution_id": execution, "source_file": "declared.csv", "source_sheet": "Agents"}
    return standardise_declared(raw(spark, list(columns), rows), stamps)


def by(rows: DataFrame, key: str, value: str) -> dict:
    return {row[key]: row[value] for row in rows.collect()}


def counts(rows: DataFrame, column: str = "status") -> dict:
    return {row[column]: row["count"] for row in rows.groupBy(column).count().collect()}
