"""Every query of the corpus operators: against SQL, on odd rows, and on empty tables."""

from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from fixture import comparable, expected
from paywarden.llm import chat
from paywarden.llm.queries import oracle_sql, queries

GIVEN = "/root/testdata/sf0.001"
#: One row per row of this table.
PER_ROW = {
    "op1_sentencepiece": "documents", "op2_toxicity": "documents", "op3_warc": "pages", "op4_quality_classifier": "documents",
    "op5_near_duplicates": "documents", "op6_fingerprints": "documents", "op7_quality_rules": "documents",
    "op9_source_mixing": "documents", "op10_lm_scoring": "documents", "op12_token_counts": "documents",
    "op13_importance_resampling": "documents",
}
IN_THE_JVM = ["Python", "Pandas", "Arrow"]


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, comparable(frame.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
@pytest.mark.parametrize("where", ["given", "odd"])
def test_same_rows_as_sql(spark, odd, name, where):
    folder = GIVEN if where == "given" else odd
    columns, got = rows_of(queries()[name](spark, folder))
    assert got == expected(folder, oracle_sql()[name], columns)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_odd_rows(spark, odd, name):
    frame = queries()[name](spark, odd)
    assert frame.columns
    if name in PER_ROW:
        assert frame.count() == spark.read.parquet(f"{odd}/{PER_ROW[name]}.parquet").count()
    else:
        frame.collect()


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op8_chat_formatting", "op9_source_mixing"])
def test_native(spark, odd, name):
    plan = queries()[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in IN_THE_JVM if node in plan]


def test_large_conversations_are_cut_by_rows(spark, monkeypatch):
    """Many rows under few turn numbers: parts stay small, and in order they are the whole text."""
    monkeypatch.setattr(chat, "MOST_ROWS", 50)
    rows = [(None, i % 8, "user", f"text {i}") for i in range(700)] + [(None, None, "user", f"last {i}") for i in range(120)]
    rows += [(4, t, "user", f"t{t}") for t in range(40)] + [(5, t, "user", f"t{t}") for t in range(3)]
    rows += [(6, 1000 * t, "user", f"far {t}") for t in range(30)]
    got = defaultdict(dict)
    for r in chat.chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)).collect():
        got[r["conv_id"]][r["part"]] = r
    assert set(got) == {None, 4, 6}
    for conv, parts in got.items():
        own = sorted((chat.NO_TURN if t is None else t, role, text) for c, t, role, text in rows if c == conv)
        assert sorted(parts) == list(range(len(parts)))
        assert "".join(parts[i]["rendered"] for i in range(len(parts))) == "".join(
            f"{chat.OPEN}{role}{chat.END}{text}{chat.CLOSE}{chat.END}" for _, role, text in own
        )
        assert all(r["n_turns"] == len(own) and r["rendered"].count(chat.OPEN) <= 50 for r in parts.values())
    assert [len(got[c]) for c in (None, 4, 6)] == [17, 1, 30]


def test_stages_return_the_columns_of_documents(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    ids = {row["doc_id"] for row in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.dtypes == docs.dtypes
        assert {row["doc_id"] for row in out.select("doc_id").collect()} <= ids
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "near_duplicates", "source_mixing", "sentencepiece"
    ]
