"""Importance resampling of documents towards the texts of a target.

Features are runs of words, hashed into buckets. A bucket's gain is the
log-ratio of its share among the target's features to its share among all
features; counts are added up in every task first, so what moves is one row per
task and bucket. The gains are an array of one number per bucket, by which
tasks score whole texts. Every document also draws a Gumbel noise from the hash
of its id, so the highest scores are a sample without replacement.

The cutoff is found without sorting the documents. A mergeable quantile sketch
of the scores gives a bracket around it; exact counts of the scores above the
bracket and in it tell whether it holds the cutoff, or on which side it must be
widened. Only the bracket is sorted to locate the cutoff, and the drawn rows above
it to be ranked.

Defined cases: null or empty texts have no features and weight 0; a null id
hashes like an empty one and comes after all others among equal scores; repeated
rows score alike, and where the cutoff falls between equal rows as many of them
are drawn as the share asks for; without documents or target texts all counts
are 0. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paywarden.llm.common import numbered, written
from paywarden.llm.terms import word_blocks

#: Size parameter of the sketch (its rank error is about 0.003), and tasks whose scores one part of it holds.
SKETCH, TASKS = 2000, 64
#: Half the width of the first bracket as a share of all scores; it is four times as wide on each further try.
MARGIN = 0.004


def bucket_blocks(text: str | None, shortest: int, longest: int, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of all runs of words of a whole text, a block at a time."""
    tail: list[bytes] = []
    for words in word_blocks(text):
        held = len(tail)
        words = tail + words
        runs = [
            words[max(0, held + 1 - n):] if n == 1 else [b" ".join(words[i:i + n]) for i in range(max(0, held + 1 - n), len(words) + 1 - n)]
            for n in range(shortest, longest + 1)
        ]
        yield np.fromiter(map(crc32, chain.from_iterable(runs)), np.int64) % buckets
        tail = words[len(words) + 1 - longest:] if longest > 1 else []


def bucket_counts(texts: DataFrame, shortest: int, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for found in bucket_blocks(text.as_py(), shortest, longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counts = texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():  # one row per bucket at most
        total[bucket] = n
    return total


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, 1000 times the log-ratio of its smoothed shares, rounded down."""
    n, all_own, all_target = len(own), int(own.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(all_own + n) / (float(s + 1) * float(all_target + n))
    return np.array([floor(1000 * log(ratio(int(s), int(t)))) for s, t in zip(own, target)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel draw from the hash of the id, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32))))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, shortest: int, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain of a document's features, rounded down."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value
        for batch in batches:
            rows = np.zeros((batch.num_rows, 3), np.int64)
            for at, text in enumerate(batch.column("text")):
                n = total = 0
                for found in bucket_blocks(text.as_py(), shortest, longest, len(of)):
                    n += len(found)
                    total += int(of[found].sum())
                rows[at, 1:] = n, total // n if n else 0
                rows[at, 0] = n if shortest == longest == 1 else sum(map(len, word_blocks(text.as_py())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(rows[:, i]) for i in range(3))], ["doc_id", "n_words", "n_features", "weight"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def sketch(rows: DataFrame) -> DataFrame:
    """One row with a quantile sketch of the scores; parts of some tasks each are merged first."""
    parts = rows.select("score", (F.spark_partition_id() / TASKS).cast("int").alias("part")).groupBy("part").agg(
        F.kll_sketch_agg_bigint("score", SKETCH).alias("held")
    )
    return parts.agg(F.kll_merge_agg_bigint("held").alias("held"))


def bracket(rows: DataFrame, wanted: int, total: int) -> tuple[int, int, int]:
    """(low, high, rows above): scores between which the wanted-th highest lies, by exact counts."""
    scores = written(sketch(rows), "sketch")
    at, below, above = 1 - wanted / total, MARGIN, MARGIN
    while True:
        ends = [F.kll_sketch_get_quantile_bigint("held", F.lit(float(min(1.0, max(0.0, q))))) for q in (at - below, at + above)]
        low, high = scores.select(*ends).first()
        over, upto = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)).first()
        if over < wanted <= upto:
            return low, high, over
        below, above = (below, above * 4) if over >= wanted else (below * 4, above)


def draw(scored: DataFrame, able: Column, percent: int) -> DataFrame:
    """Scored rows with the rank of those that are drawn, null for all others."""
    rows = scored.where(able)
    total = rows.count()
    wanted = percent * total // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    low, high, over = bracket(rows, wanted, total)
    score = F.col("score")
    order = [score.desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("n_words")]
    ahead = numbered(rows.where(score > high), order, "place").withColumn("rank", F.col("place") + 1)
    inside = numbered(rows.where(score.between(low, high)), order, "place").withColumn("rank", F.col("place") + 1 + F.lit(over))
    inside = inside.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.where(~F.coalesce(able, F.lit(False)) | (score < low)).withColumn("rank", F.lit(None).cast("long"))
    columns = [*scored.columns, "rank"]
    return ahead.select(columns).unionByName(inside.select(columns)).unionByName(rest.select(columns))


def resampled(
    docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = 10_000, percent: int = 10,
    least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; the highest scores among those long enough are drawn."""
    gain = gains(bucket_counts(docs, shortest, longest, buckets), bucket_counts(target, shortest, longest, buckets))
    scored = weighed(docs, gain, shortest, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    drawn = draw(written(scored, "scores"), F.col("n_words") >= least_words, percent)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
