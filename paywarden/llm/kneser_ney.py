"""Quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

The model is interpolated over all orders of byte n-grams. Its counts come from
all documents that a label calls good but every fifth of them, which
calibrates: a document is rejected if its perplexity exceeds a quantile of the
calibrating documents of its language. Languages without enough of them in the
whole data share one threshold.

Chunks of texts ask once for every n-gram that occurs in them and say how often
their counted documents have it; shards build their part of the model from the
counts of all chunks, and the answers go back to the chunk.

Defined cases: a null or empty text has no perplexity and is rejected; without
trusted text everything else is kept, as there is nothing to compare with; a
null language is a language of its own; rows that share an id are each scored,
and trusted if the id is; an empty table gives no rows; other columns are
carried by ``keep`` and never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from paywarden.llm.common import lean, lean_pair, text_mark, utf8, written
from paywarden.llm.shards import bordered, chunk_count, chunk_of, in_chunks, seen_grams, summed_by_text, unpacked

#: Bytes of an n-gram, and of those whose table is complete; bound of the trusted documents that ``trusted_sample``
#: counts, and every which of them calibrates instead.
ORDER, LOW, TRUSTED, FOLDS = 5, 2, 20_000, 5
#: Threshold: this quantile of the logarithm of the perplexity.
QUANTILE = 0.99
#: Least calibrating documents of a language, and steps of the logarithm that are counted first.
ENOUGH, STEP = 30, 1e-4
#: Fixed value: bytes that can follow.
ALPHABET = 256


@dataclass(frozen=True)
class Discounts:
    """What is taken off counts of one, two, and three or more."""

    one: float
    two: float
    more: float

    @classmethod
    def of(cls, n1: int, n2: int, n3: int, n4: int) -> Discounts:
        """From the numbers of n-grams that occur once to four times; usual values where those say nothing."""
        if min(n1, n2, n3, n4) == 0:
            return cls(0.5, 1.0, 1.5)
        y = n1 / (n1 + 2 * n2)
        values = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return cls(*(min(max(value, 0.05), most) for value, most in zip(values, (0.95, 1.95, 2.95))))

    def off(self, counts: np.ndarray) -> np.ndarray:
        return np.array([0.0, self.one, self.two, self.more])[np.minimum(counts, 3)]


def suffix(gram: Column, order: int) -> Column:
    """The last ``order`` bytes."""
    return gram.bitwiseAND(F.lit((1 << 8 * order) - 1))


def interpolated(grams: np.ndarray, known: np.ndarray, counts: np.ndarray, discounts: Discounts, low: np.ndarray) -> np.ndarray:
    """Probabilities of one order: discounted counts, and what they leave is spread like the order below.

    ``known`` holds, in order, every counted n-gram after the contexts of ``grams``.
    """
    if not len(known) or not len(grams):
        return low
    contexts, at = np.unique(known >> 8, return_inverse=True)
    total, spare = np.bincount(at, counts), np.bincount(at, discounts.off(counts))
    place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    n = np.where(known[place] == grams, counts[place], 0)
    own = np.minimum(np.searchsorted(contexts, grams >> 8), len(contexts) - 1)
    seen = (n - discounts.off(n) + spare[own] * low) / total[own]
    return np.where(contexts[own] == grams >> 8, seen, low)


def higher_orders(grams: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counted n-grams and their counts, in order, of ORDER down to the first above LOW, from those of ORDER.

    Below that, the count of an n-gram is the number of bytes that occur before it.
    """
    orders = {ORDER: (grams, counts)}
    for order in range(ORDER - 1, LOW, -1):
        orders[order] = np.unique(orders[order + 1][0] % 256**order, return_counts=True)
    return orders


def learned(asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a shard that trusted text has, in order, and their counts."""
    grams, at = np.unique(asked["gram"].to_numpy(), return_inverse=True)
    counts = np.bincount(at, asked["n"].to_numpy(), len(grams)).astype(np.int64)
    return grams[counts > 0], counts[counts > 0]


def tallied(asked: pa.Table) -> pa.Table:
    """(order, gram, n) of a shard: under the counts one to four, how many n-grams of the higher orders occur so often;
    and the counts of the n-grams of LOW bytes."""
    orders = higher_orders(*learned(asked))
    parts = [(order, np.arange(1, 5), np.bincount(np.minimum(n, 5), minlength=6)[1:5]) for order, (_, n) in orders.items()]
    parts.append((LOW, *np.unique(orders[LOW + 1][0] % 256**LOW, return_counts=True)))
    return pa.table({
        "order": pa.array(np.concatenate([np.full(len(grams), order, np.int32) for order, grams, _ in parts])),
        "gram": pa.array(np.concatenate([grams for _, grams, _ in parts]).astype(np.int64)),
        "n": pa.array(np.concatenate([n for _, _, n in parts]).astype(np.int64)),
    })


def low_orders(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probabilities of all 65 536 n-grams of LOW bytes, from those that are counted."""
    tables = {LOW: (grams, counts)}
    for order in range(LOW - 1, 0, -1):
        tables[order] = np.unique(tables[order + 1][0] % 256**order, return_counts=True)
    p = np.full(256, 1.0 / ALPHABET)
    for order in range(1, LOW + 1):
        known, n = tables[order]
        discounts = Discounts.of(*(int(np.count_nonzero(n == c)) for c in (1, 2, 3, 4)))
        every = np.arange(256**order)
        p = interpolated(every, known, n, discounts, p[every % 256 ** max(order - 1, 1)])
    return p


def shared(tallies: pa.Table) -> pa.Table:
    """What all shards need, as one row: the probabilities of LOW bytes and the discounts of the higher orders."""
    tallies = tallies.sort_by("gram")
    of = lambda order: tallies.filter(pc.equal(tallies["order"], order))
    low = low_orders(of(LOW)["gram"].to_numpy(), of(LOW)["n"].to_numpy())
    seen = [Discounts.of(*of(order)["n"].to_pylist()) for order in range(LOW + 1, ORDER + 1)]
    off = [value for d in seen for value in (d.one, d.two, d.more)]
    return pa.table({
        "low": pa.array([pa.compress(low.tobytes(), "zstd", asbytes=True)], pa.binary()),
        "discounts": pa.array([off], pa.list_(pa.float64())),
    })


def asked(chunks: DataFrame, counted: DataFrame) -> DataFrame:
    """(chunk, gram, n): what every chunk needs to know, and how often its counted documents have it."""

    def ask(blobs: pa.Table, ids: pa.Table) -> pa.Table:
        known, streams = set(ids["doc_id"].to_pylist()), ([], [])
        texts = unpacked(blobs) if blobs.num_rows else None
        for doc_id, text in zip(texts["doc_id"].to_pylist(), texts["text"]) if texts else ():
            streams[doc_id in known].append(bordered(utf8(text.as_py()), ORDER))
        grams, counts = seen_grams(*streams, ORDER)
        chunk = blobs["chunk"][0].as_py() if texts else 0
        return pa.table({"chunk": pa.array(np.full(len(grams), chunk, np.int32)), "gram": pa.array(grams), "n": pa.array(counts)})

    return chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(lean_pair(ask), "chunk int, gram bigint, n bigint")


def answered(questions: DataFrame, count: int) -> DataFrame:
    """(chunk, gram, value): log10 of the probability of each n-gram's last byte, for every chunk that asks.

    Questions are dealt into shards by the last LOW bytes of the context. The higher orders of an n-gram are all
    in its shard, with the counts of all chunks, and no more than 256 ** (ORDER - LOW) n-grams share a key. What
    depends on all shards is one row, which each of them gets; it comes from the same shuffled questions.
    """
    shard = F.pmod(F.xxhash64(suffix(F.shiftright("gram", 8), LOW)), F.lit(count)).cast("int")
    dealt = questions.withColumn("shard", shard).repartition(count, "shard")
    tallies = dealt.groupBy("shard").applyInArrow(lean(tallied), "order int, gram bigint, n bigint")
    tallies = tallies.groupBy("order", "gram").agg(F.sum("n").alias("n")).groupBy().applyInArrow(
        shared, "low binary, discounts array<double>"
    )
    everywhere = questions.sparkSession.range(count).select(F.col("id").cast("int").alias("home")).crossJoin(tallies)

    def answer(asked: pa.Table, base: pa.Table) -> pa.Table:
        grams, at = np.unique(asked["gram"].to_numpy(), return_inverse=True)
        if not len(grams):
            return pa.table({"chunk": pa.array([], pa.int32()), "gram": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        low = np.frombuffer(pa.decompress(base["low"][0].as_py(), 8 * 256**LOW, "zstd", asbytes=True))
        off = iter(base["discounts"][0].as_py())
        p, orders = low[grams % 256**LOW], higher_orders(*learned(asked))
        for order in range(LOW + 1, ORDER + 1):
            p = interpolated(grams % 256**order, *orders[order], Discounts(next(off), next(off), next(off)), p)
        return pa.table({"chunk": asked["chunk"], "gram": asked["gram"], "value": np.log10(p)[at]})

    return dealt.groupBy("shard").cogroup(everywhere.groupBy("home")).applyInArrow(lean_pair(answer), "chunk int, gram bigint, value double")


def trusted_documents(labels: DataFrame) -> DataFrame:
    """(id, calibrates) of all good documents; by the hash of their id, one of FOLDS calibrates, all others are counted."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("id")).distinct()
    return written(good.select("id", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)) == 0).alias("calibrates")), "trusted")


def trusted_sample(labels: DataFrame) -> DataFrame:
    """The good documents with at most TRUSTED of them counted, drawn by the hash of their id; all others calibrate.

    For callers that want a bounded model; neither ``judged`` nor ``keep`` uses it.
    """
    good = trusted_documents(labels)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = min(1.0, 1.1 * TRUSTED / max(good.count(), 1))
    drawn = good.where(draw < int(share * (1 << 30))).orderBy(draw, "id").limit(TRUSTED)
    used = drawn.where("not calibrates").select(F.col("id").alias("used"))
    marked = good.join(used, F.col("id") == F.col("used"), "left")
    return written(marked.select("id", F.col("used").isNull().alias("calibrates")), "trusted")


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, mark of the text, calibrates (null: not trusted), n_bytes, log_ppl (log10 per byte; null without text).

    The counted ids meet ids and lengths first and go to the chunks of their texts; which scores calibrate is joined
    to the scores. Texts move once, for the questions and for the scores alike.
    """
    count = chunk_count(docs)
    used = trusted.where(~F.col("calibrates")).select(F.col("id").alias("used"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), chunk_of(count))
    counted = ids.join(used, F.col("doc_id") == F.col("used")).select("chunk", "doc_id").distinct()
    chunks = in_chunks(docs.select("doc_id", "text", "lang").withColumns(text_mark()), count, "lang", "mark_a", "mark_b")
    answers = answered(asked(chunks, counted), count)

    def score(blobs: pa.Table, found: pa.Table) -> pa.Table:
        texts = unpacked(blobs)
        raw = [utf8(text.as_py()) for text in texts["text"]]
        streams = [bordered(text, ORDER) for text in raw]
        sums = summed_by_text(streams, ORDER, found["gram"].to_numpy(), found["value"].to_numpy())
        ppl = [-total / (len(text) + 1) if text else None for total, text in zip(sums.tolist(), raw)]
        return pa.table({
            "doc_id": texts["doc_id"], "lang": texts["lang"], "mark_a": texts["mark_a"], "mark_b": texts["mark_b"],
            "n_bytes": pa.array([len(text) for text in raw], pa.int64()), "log_ppl": pa.array(ppl, pa.float64()),
        })

    layout = "doc_id bigint, lang string, mark_a bigint, mark_b bigint, n_bytes bigint, log_ppl double"
    scores = written(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean_pair(score), layout), "perplexities")
    return scores.join(trusted, F.col("doc_id") == F.col("id"), "left").drop("id")


def thresholds(scores: DataFrame) -> DataFrame:
    """(lang, limit): exact quantiles of the calibrating documents; lang null-safe.

    Counts per step find the step of the quantile, the values inside it the quantile.
    The row whose ``every`` is true serves languages with too few documents.
    """
    step = F.ceil(F.col("log_ppl") / STEP).alias("step")
    values = written(
        scores.where(F.col("calibrates") & F.col("log_ppl").isNotNull()).groupBy("lang", step, "log_ppl").agg(F.count("*").alias("n")),
        "values",
    )

    def reached(counts: DataFrame, key: Column, by: str, before: Column, total: Column) -> DataFrame:
        """The rows from which on QUANTILE of all documents are not above."""
        upto = before + F.sum("n").over(Window.partitionBy(key).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumns({"upto": upto, "all": total}).where(F.col("upto") >= QUANTILE * F.col("all"))

    def limit_by(key: Column) -> DataFrame:
        keyed = values.withColumn("key", key)
        steps = keyed.groupBy("key", "step").agg(F.sum("n").alias("n"))
        total = F.sum("n").over(Window.partitionBy("key"))
        found = reached(steps, F.col("key"), "step", F.lit(0), total).groupBy("key").agg(
            F.min(F.struct("step", (F.col("upto") - F.col("n")).alias("below"), "all")).alias("at")
        ).select(F.col("key").alias("of"), "at.*").withColumnRenamed("step", "at_step")
        inside = keyed.join(F.broadcast(found), F.col("key").eqNullSafe(F.col("of")) & (F.col("step") == F.col("at_step")))
        inside = inside.groupBy("key", "log_ppl", "below", "all").agg(F.sum("n").alias("n"))
        return reached(inside, F.col("key"), "log_ppl", F.col("below"), F.col("all")).groupBy("key").agg(
            F.min("log_ppl").alias("limit"), F.max("all").alias("n")
        )

    own = limit_by(F.col("lang")).where(F.col("n") >= ENOUGH).select(F.col("key").alias("lang"), "limit", F.lit(False).alias("every"))
    return own.unionByName(limit_by(F.lit("")).select(F.lit(None).cast("string").alias("lang"), "limit", F.lit(True).alias("every")))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The scores of every document with its limit and whether it is kept."""
    scores = perplexities(docs, trusted_documents(labels))
    limits = written(thresholds(scores), "limits")
    own = limits.where(~F.col("every")).select(F.col("lang").alias("of"), F.col("limit").alias("own"))
    rest = limits.where("every").agg(F.max("limit").alias("rest"))
    rows = scores.join(own, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn(
        "limit", F.coalesce("own", F.lit(rest.first()["rest"]).cast("double"))
    )
    kept = F.col("log_ppl").isNotNull() & (F.col("limit").isNull() | (F.col("log_ppl") <= F.col("limit")))
    return rows.withColumn("kept", kept)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, limit, kept of every document."""
    return verdicts(docs, labels).select(
        "doc_id", "lang", "n_bytes", F.pow(F.lit(10.0), "log_ppl").alias("perplexity"),
        F.pow(F.lit(10.0), "limit").alias("most"), "kept",
    )


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns.

    A row goes by its own score: verdicts come back by id, language and the mark of the text, which spreads rows
    without id. Rows alike in these have the same score.
    """
    identity = ["doc_id", "lang", "mark_a", "mark_b"]
    rejected = verdicts(docs, labels).where(~F.col("kept")).select(*(F.col(c).alias(f"_{c}") for c in identity)).distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "lang", *(c.alias(name) for name, c in text_mark().items()))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identity])
    return rows.join(rejected, same, "left_anti").select("row.*")
