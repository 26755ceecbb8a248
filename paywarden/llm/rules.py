"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements
and one bit per failed rule; a policy is a set of bits, so policies of any
version and their ablations are bitwise arithmetic over the ledger, never
another pass over the texts.

Defined cases: a null text has no words; a document without words fails
``few_words``; repeated rows are each judged alike; an empty table gives an
empty ledger; columns other than id and text are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from paywarden.llm.common import SPACE, utf8

#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(0x41, 0x5B))
CONTINUATION = bytes(range(0x80, 0xC0))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen: set[tuple] = set()
    twice: set[tuple] = set()
    for window in windows if len(set(windows)) < len(windows) else ():
        (twice if window in seen else seen).add(window)
    covered, end = 0, 0
    for start, window in enumerate(windows if twice else ()):
        if window in twice:
            covered += start + 3 - max(start, end)
            end = start + 3
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    raw = utf8(text)
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(SPACE)]
    return (
        len(words),
        len(raw.translate(None, SPACE + CONTINUATION)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(raw) - len(raw.translate(None, CAPITALS)),
    )


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def measurements(texts: pa.Array) -> pa.Array:
    columns = list(zip(*(measure(text.as_py()) for text in texts))) or [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], MEASURES)


@dataclass(frozen=True)
class Rule:
    """A failure condition over the measurements, as SQL text that Spark and other engines read alike."""

    name: str
    fails: str


#: The place in the list is the rule's bit; rules are only ever added at the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 25 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("capitals", "100 * n_capitals > 30 * word_chars"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)
BITS = {rule.name: 1 << place for place, rule in enumerate(RULES)}
BASE = ("few_words", "repeated_words")


def mask(*names: str) -> int:
    return sum(BITS[name] for name in set(names))


#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": mask(*BASE),
    "v1": mask(*BASE, "symbols", "repeated_lines"),
    "v2": mask(*BASE, "symbols", "repeated_lines", "capitals", "short_words", "long_words"),
}
CURRENT = "v2"


def failed_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = [F.when(F.expr(rule.fails), F.lit(1 << place)).otherwise(F.lit(0)) for place, rule in enumerate(rules)]
    return sum(bits[1:], bits[0]).cast("bigint")


def passes(failed: Column, policy: int) -> Column:
    return failed.bitwiseAND(F.lit(policy)) == 0


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and the failure bits of every document."""
    measured = docs.select("doc_id", measurements("text").alias("m")).select("doc_id", "m.*")
    return measured.withColumn("failed", failed_bits())


def verdicts(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` under a policy."""
    return entries.withColumn("kept", passes(F.col("failed"), POLICIES[policy]))


def ablations(entries: DataFrame) -> DataFrame:
    """Per policy and rule: documents kept, rejected by the rule, and kept if the rule were left out.

    The ledger shrinks to one row per bit pattern before the policies meet it.
    """
    patterns = entries.groupBy("failed").agg(F.count("*").alias("n"))
    cases = F.array(*[
        F.struct(F.lit(policy).alias("policy"), F.lit(name).alias("rule"), F.lit(bits).cast("bigint").alias("mask"),
                 F.lit(bit).cast("bigint").alias("bit"))
        for policy, bits in POLICIES.items() for name, bit in BITS.items() if bits & bit
    ])
    hits = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return (
        patterns.withColumn("case", F.explode(cases)).select("failed", "n", "case.*")
        .groupBy("policy", "rule")
        .agg(
            count(hits == 0).alias("kept"),
            count(hits.bitwiseAND(F.col("bit")) != 0).alias("rejected_by_rule"),
            count(hits.bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without_rule"),
        )
    )


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with all their columns."""
    judged = docs.select(F.struct("*").alias("row"), measurements("text").alias("m"))
    bits = judged.select("row", "m.*").withColumn("failed", failed_bits())
    return bits.where(passes(F.col("failed"), POLICIES[policy])).select("row.*")
