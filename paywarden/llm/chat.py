"""Chat formatting: cumulative snapshots are collapsed, what remains is rendered.

A service that logs a conversation after every turn leaves many conversations
that are prefixes of longer ones. Each turn gets a rolling hash of all turns
up to it. A conversation whose last hash is the hash of an inner turn of
another one is a snapshot and goes; of equal conversations the smallest id
stays. Only DataFrame functions are used.

A conversation's rolling hash is the exclusive or of two 64-bit hashes per
turn. It is reduced to one row per turn number and cut into ranges of rows that
Spark draws: a range of a conversation is one window, the ranges before it add
one value. Conversations of any length thus spread over many tasks.

Defined cases: a conversation is its set of (turn, role, text), so repeated
rows count once and order within one turn is by role and text; a null text is
an empty one, a null role is "unknown"; turns without a number come last; rows
without a conversation id form one conversation; an empty table gives none;
other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paywarden.llm.common import alike, running, written

#: Turn numbers of a rendered part, and its most rows and bytes: a part that has more of them is cut by rows.
SLICE = 512
MOST_ROWS, MOST_BYTES = 4096, 64 << 20
#: Characters of a text by which rows are dealt into ranges.
HEAD = 256
NO_TURN = (1 << 62) - 1

#: How one turn is rendered.
OPEN, CLOSE, END = "<|im_start|>", "<|im_end|>", "\n"


def both(hash_of, *parts: Column) -> Column:
    """128 bits: two 64-bit hashes of the same values under different seeds."""
    return F.struct(hash_of(F.lit(1), *parts).alias("a"), hash_of(F.lit(2), *parts).alias("b"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their slice and hash."""
    turns = conversations.select(
        F.col("conv_id"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(NO_TURN)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    mark = both(F.xxhash64, F.col("turn"), F.col("role"), F.col("text"))
    return turns.withColumn("slice", F.floor(F.col("turn") / SLICE).cast("bigint")).withColumn("mark", mark)


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_snapshots) of the maximal conversations."""
    # Rows of one turn number share the hash of all turns up to and including it.
    short = written(
        turns.groupBy("conv_id", "turn").agg(
            F.bit_xor("mark.a").alias("a"), F.bit_xor("mark.b").alias("b"), F.count("*").alias("n")
        ), "marks",
    )
    turn = [F.col("turn")]
    rolling = running(short, ["conv_id"], turn, turn, F.bit_xor, Column.bitwiseXOR, in_a="a", in_b="b")
    inner = rolling.where(~F.col("last")).select(F.col("in_a").alias("a"), F.col("in_b").alias("b")).distinct()
    whole = short.groupBy("conv_id").agg(
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("n").alias("n_turns")
    )
    unlike = whole.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.max("n_turns").alias("n_turns"), F.count("*").alias("n_copies")
    )
    return unlike.join(inner, ["a", "b"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(END), text, F.lit(CLOSE), F.lit(END))


def chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as text: conv_id, part, n_turns, n_copies, rendered.

    A part is one slice of turn numbers, counted from 0, or a range of its rows if it has very many of them; nearly
    every conversation has one part, and parts in order make up the whole text.
    """
    turns = written(turns_of(conversations), "turns")
    kept = written(collapse(turns), "kept")
    line = rendered(F.col("role"), F.col("text"))
    turns = turns.select("conv_id", "slice", "turn", "role", "text", line.alias("line"), F.octet_length(line).cast("bigint").alias("size"))
    slices = written(alike(turns.groupBy("conv_id", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("size")), kept, "conv_id"), "slices")
    large = (F.col("n") > MOST_ROWS) | (F.col("size") > MOST_BYTES)
    cut = [F.lit(0).cast("bigint").alias(c) for c in ("by_rows", "by_size")]
    keys = slices.where(~large).select("conv_id", "slice", *cut, "n_turns", "n_copies")
    key = ["conv_id", "slice", "by_rows", "by_size"]
    lines = turns.select("conv_id", "slice", *cut, "turn", "role", "text", "line")
    heavy = slices.where(large).select("conv_id", "slice", "n_turns", "n_copies")
    if not heavy.isEmpty():
        order = [F.col("turn"), F.col("role"), F.col("text")]
        dealt = [F.col("turn"), F.col("role"), F.substring("text", 1, HEAD)]
        rows = alike(turns, heavy, "conv_id", "slice").withColumn("one", F.lit(1).cast("bigint"))
        rows = running(rows, ["conv_id", "slice"], order, dealt, F.sum, Column.__add__, rows_upto="one", size_upto="size")
        rows = written(rows.select(
            "conv_id", "slice", F.floor((F.col("rows_upto") - 1) / MOST_ROWS).alias("by_rows"),
            F.floor((F.col("size_upto") - F.col("size")) / MOST_BYTES).alias("by_size"), "turn", "role", "text", "line",
            "n_turns", "n_copies",
        ), "heavy")
        keys = keys.unionByName(rows.select(*key, "n_turns", "n_copies").distinct())
        light = alike(turns, slices.where(~large).select("conv_id", "slice"), "conv_id", "slice")
        lines = light.select("conv_id", "slice", *cut, "turn", "role", "text", "line").unionByName(rows.drop("n_turns", "n_copies"))
    ordered = [F.col(c) for c in key[1:]]
    numbered = running(keys.withColumn("one", F.lit(1).cast("bigint")), ["conv_id"], ordered, ordered, F.sum, Column.__add__, place="one")
    numbered = numbered.select(*key, "n_turns", "n_copies", (F.col("place") - 1).cast("int").alias("part"))
    line = F.struct("turn", "role", "text", "line")
    return (
        alike(lines, numbered, *key).groupBy("conv_id", "part", "n_turns", "n_copies")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "").alias("rendered"))
    )
