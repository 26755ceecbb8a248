"""Language-model scores by context-tree weighting.

Every byte of a text is eight binary choices, each with its own context tree:
the node of a choice at depth d is the choice's place within the byte and the d
bytes before it. Each node has a Krichevsky-Trofimov estimate from the training
counts, and a weight: the posterior probability that the source stops there
rather than looking at one more byte, from the block probabilities of the node
and, weighted likewise, of its children. The probability of a choice mixes the
estimates along its path with these weights; the path ends at the deepest node
that training has reached. Code length per byte follows.

A text is read as its lower-cased words, one space between them, and an end
mark, so that its probability is that of the sequence of its tokens. Chunks of
texts ask once for every n-gram and word that occurs in them. The trees are cut
into shards below a few bytes of context; a shard builds its part from the
counts of all training texts and answers the questions of all chunks.

Defined cases: a null or empty text, or one without words, is the end token
alone; a null id is never held out; repeated rows count and score alike; an
empty table gives no rows; without training texts every choice is even.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from paywarden.llm.common import held_out, lean, lean_pair, utf8, written
from paywarden.llm.shards import bordered, chunk_count, in_chunks, seen_grams, summed_by_text, unpacked

#: Depth of the trees in bytes, depth at which they are cut into shards, folds of which one is held out, and the
#: base model's added count.
DEPTH, SHARD, FOLDS, ADDED = 5, 3, 10, 0.1
GRAM = DEPTH + 1
#: Bits of the place within a byte: 1, then the choices made so far.
PLACE_BITS = 8


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words)


def features(chunks: DataFrame) -> DataFrame:
    """(chunk, gram, word, n): each n-gram and each word of a chunk with its count in training texts."""

    def extract(group: pa.Table) -> pa.Table:
        rows = unpacked(group)
        training = [not held for held in rows["held_out"].to_pylist()]
        words: Counter[bytes] = Counter()
        others: set[bytes] = set()
        streams: tuple[list[bytes], list[bytes]] = [], []
        for text, learn in zip(rows["text"], training):
            own = words_of(text.as_py())
            words.update(own) if learn else others.update(own)
            streams[learn].append(bordered(stream(own), GRAM))
        del rows
        for word in others:
            words.setdefault(word, 0)
        del others
        grams, counts = seen_grams(*streams, GRAM)
        size = len(grams) + len(words)
        return pa.table({
            "chunk": pa.array(np.full(size, group["chunk"][0].as_py(), np.int32)),
            "gram": pa.chunked_array([pa.array(grams), pa.nulls(len(words), pa.int64())]),
            "word": pa.chunked_array([pa.nulls(len(grams), pa.binary()), pa.array(list(words), pa.binary())]),
            "n": pa.chunked_array([pa.array(counts), pa.array(list(words.values()), pa.int64())]),
        })

    return chunks.groupBy("chunk").applyInArrow(lean(extract), "chunk int, gram bigint, word binary, n bigint")


# The formulas below take NumPy arrays and columns alike; ``log`` is the logarithm of either kind.


def log_gamma(x, log):
    """Natural logarithm of the gamma function by Stirling's series, eight steps up."""
    high = x + 8
    series = (high - 0.5) * log(high) - high + 0.9189385332046727 + 1 / (12 * high) - 1 / (360 * high**3) + 1 / (1260 * high**5)
    product = x
    for step in range(1, 8):
        product = product * (x + step)
    return series - log(product)


def block(zeros, ones, log):
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5, log) + log_gamma(ones + 0.5, log) - log_gamma(zeros + ones + 1, log) - float(np.log(np.pi))


def estimate(zeros, ones):
    """Probability of a one."""
    return (ones + 0.5) / (zeros + ones + 1)


def at_depth(node, depth: int):
    """The node of the same choice with only the last ``depth`` bytes of context."""
    mask = (1 << 8 * depth + PLACE_BITS) - 1
    return node.bitwiseAND(F.lit(mask)) if isinstance(node, Column) else node & mask


def choice(grams: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, bit) of one of the eight binary choices of each n-gram's last byte."""
    byte = grams & 0xFF
    return grams >> 8 << PLACE_BITS | 1 << bit | byte >> 8 - bit, byte >> 7 - bit & 1


@dataclass
class Level:
    """Nodes of one depth in order: counts, logarithm of the weighted block probability, weight of stopping."""

    node: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    stop: np.ndarray


def shard_levels(grams: np.ndarray, counts: np.ndarray) -> dict[int, Level]:
    """The nodes from SHARD to DEPTH of n-grams that hold every n-gram after the same SHARD bytes."""
    weights, parts = counts.astype(np.float64), []
    for bit in range(8):  # choices share no node, and one at a time takes an eighth of the memory
        nodes, bits = choice(grams, bit)
        node, at = np.unique(nodes, return_inverse=True)
        parts.append((node, *(np.bincount(at, weights * (bits == b), len(node)) for b in (0, 1))))
    node, zeros, ones = (np.concatenate(columns) for columns in zip(*parts))
    order = np.argsort(node)
    node, zeros, ones = node[order], zeros[order], ones[order]
    levels = {DEPTH: Level(node, zeros, ones, block(zeros, ones, np.log), np.ones(len(node)))}
    for depth in range(DEPTH - 1, SHARD - 1, -1):
        below = levels[depth + 1]
        node, at = np.unique(at_depth(below.node, depth), return_inverse=True)
        zeros, ones, under = (np.bincount(at, x, len(node)) for x in (below.zeros, below.ones, below.weighted))
        own = block(zeros, ones, np.log)
        weighted = np.logaddexp(own, under) - np.log(2)
        levels[depth] = Level(node, zeros, ones, weighted, np.minimum(np.exp(own - weighted) / 2, 1.0))
    return levels


def shard_tops(group: pa.Table) -> pa.Table:
    """A shard's nodes at depth SHARD: node, zeros, ones, weighted, stop."""
    grams, at = np.unique(group["gram"].to_numpy(), return_inverse=True)
    counts = np.bincount(at, group["n"].to_numpy(), len(grams))
    top = shard_levels(grams[counts > 0], counts[counts > 0])[SHARD]
    return pa.table({"node": top.node, "zeros": top.zeros, "ones": top.ones, "weighted": top.weighted, "stop": top.stop})


def shard_answers(group: pa.Table, above: pa.Table) -> pa.Table:
    """(chunk, gram, value) for every row of a shard: log10 of the probability of the n-gram's last byte."""
    grams, at = np.unique(group["gram"].to_numpy(), return_inverse=True)
    counts = np.bincount(at, group["n"].to_numpy(), len(grams))
    mixed: dict[int, tuple[np.ndarray, ...]] = {}
    for depth in range(SHARD):
        rows = above.filter(pc.equal(above["depth"], depth)).sort_by("node")
        mixed[depth] = tuple(rows[c].to_numpy() for c in ("node", "acc", "rest", "q"))
    for depth, level in sorted(shard_levels(grams[counts > 0], counts[counts > 0]).items()):
        up, acc, rest, _ = mixed[depth - 1]
        parent = np.searchsorted(up, at_depth(level.node, depth - 1))
        one, acc, rest = estimate(level.zeros, level.ones), acc[parent], rest[parent]
        mixed[depth] = level.node, acc + rest * level.stop * one, rest * (1 - level.stop), acc + rest * one
    values = np.zeros(len(grams))
    for bit in range(8):
        nodes, bits = choice(grams, bit)
        q = np.full(len(nodes), np.nan)
        for depth in range(DEPTH, -1, -1):  # the deepest node that training has reached
            known, _, _, value = mixed[depth]
            open_ = np.flatnonzero(np.isnan(q))
            if len(known) and len(open_):
                wanted = at_depth(nodes[open_], depth)
                place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                hit = known[place] == wanted
                q[open_[hit]] = value[place[hit]]
        q = np.where(np.isnan(q), 0.5, q)
        values += np.log10(np.where(bits == 1, q, 1 - q))
    return pa.table({"chunk": group["chunk"], "gram": group["gram"], "value": values[at]})


def top_levels(tops: DataFrame) -> DataFrame:
    """(depth, node, acc, rest, q) of the nodes above the shards: summed upwards, then mixed downwards.

    ``q`` is the mixed probability of a one if the path ends at the node,
    ``acc`` and ``rest`` are what the nodes down to it give and leave over.
    """
    level, levels = tops, {}
    for depth in range(SHARD - 1, -1, -1):
        up = level.groupBy(at_depth(F.col("node"), depth).alias("node")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("under")
        )
        up = up.withColumn("own", block(F.col("zeros"), F.col("ones"), F.log))
        both = F.greatest("own", "under") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("under"))))
        up = up.withColumn("weighted", both - float(np.log(2)))
        stop = F.least(F.exp(F.col("own") - F.col("weighted")) / 2, F.lit(1.0))
        level = levels[depth] = written(up.select("node", "zeros", "ones", "weighted", stop.alias("stop")), "level")
    mixed, above = [], None
    for depth in range(SHARD):
        one = estimate(F.col("zeros"), F.col("ones"))
        if above is None:
            rows = levels[depth].withColumns({"acc": F.lit(0.0), "rest": F.lit(1.0)})
        else:
            rows = levels[depth].join(
                above.select(F.col("node").alias("up"), "acc", "rest"), at_depth(F.col("node"), depth - 1) == F.col("up")
            )
        above = rows.select(
            F.lit(depth).alias("depth"), "node", (F.col("acc") + F.col("rest") * F.col("stop") * one).alias("acc"),
            (F.col("rest") * (1 - F.col("stop"))).alias("rest"), (F.col("acc") + F.col("rest") * one).alias("q"),
        )
        mixed.append(above)
    return written(reduce(DataFrame.unionByName, mixed), "tops")


def gram_answers(seen: DataFrame, count: int) -> DataFrame:
    """(chunk, gram, value) for every n-gram that a chunk asks for.

    N-grams are dealt by the last SHARD bytes of their context, so a shard holds
    whole subtrees, and no more than 256 ** (GRAM - SHARD) n-grams under one key.
    """
    context = F.shiftright("gram", 8)
    suffix = context.bitwiseAND(F.lit((1 << 8 * SHARD) - 1))
    shard = F.pmod(F.xxhash64(suffix), F.lit(count)).cast("int")
    rows = seen.where(F.col("gram").isNotNull()).select("chunk", "gram", "n", shard.alias("shard")).repartition(count, "shard")
    layout = "node bigint, zeros double, ones double, weighted double, stop double"
    tops = top_levels(written(rows.groupBy("shard").applyInArrow(lean(shard_tops), layout), "level"))
    paths = rows.select(F.col("shard").alias("home"), suffix.alias("suffix")).distinct().select(
        "home", F.explode(F.array(*[
            F.struct(F.lit(d).alias("depth"), F.col("suffix").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("context"))
            for d in range(SHARD)
        ])).alias("p")
    ).select("home", "p.*").distinct()
    above = tops.withColumnRenamed("depth", "of").join(
        paths, (F.col("of") == F.col("depth")) & (F.shiftright("node", PLACE_BITS) == F.col("context"))
    ).select("home", "depth", "node", "acc", "rest", "q")
    return rows.groupBy("shard").cogroup(above.groupBy("home")).applyInArrow(
        lean_pair(shard_answers), "chunk int, gram bigint, value double"
    )


def word_counts(seen: DataFrame) -> DataFrame:
    """(chunk, word, c, first): the count of every word in all training texts, and one row of each word marked."""
    alike = Window.partitionBy("word")
    place = F.row_number().over(alike.orderBy("chunk"))
    return written(seen.where(F.col("word").isNotNull()).select(
        "chunk", "word", F.sum("n").over(alike).alias("c"), (place == 1).alias("first")
    ), "words")


def scored(docs: DataFrame) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn(
        "held_out", held_out(F.col("doc_id"), FOLDS)
    )
    count = chunk_count(docs)
    chunks = in_chunks(marked, count, "held_out")
    seen = written(features(chunks), "features")
    ends = marked.agg(F.count_if(~F.col("held_out"))).first()[0]

    words = word_counts(seen)
    total, kinds = words.where("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, kinds = int(total) + int(ends), int(kinds) + (1 if ends else 0)
    scale = np.log10(total + ADDED * (kinds + 1))

    answers = gram_answers(seen, count).select("chunk", "gram", F.lit(None).cast("binary").alias("word"), "value").unionByName(
        words.select("chunk", F.lit(None).cast("bigint").alias("gram"), "word", F.col("c").cast("double").alias("value"))
    )

    def score(blobs: pa.Table, found: pa.Table) -> pa.Table:
        texts = unpacked(blobs)
        is_gram = found["gram"].is_valid()
        known = found.filter(is_gram)
        own = found.filter(found["word"].is_valid())
        count_of = dict(zip(own["word"].to_pylist(), own["value"].to_pylist()))
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": []}
        streams = []
        for text in texts["text"]:
            row = words_of(text.as_py())
            c = np.fromiter(map(count_of.__getitem__, row), np.float64, len(row))
            out["n_tokens"].append(len(row) + 1)
            out["n_known"].append(int(np.count_nonzero(c)) + (1 if ends else 0))
            out["base_score"].append(float(np.log10(c + ADDED).sum() + np.log10(ends + ADDED) - (len(row) + 1) * scale))
            streams.append(stream(row))
        sums = summed_by_text(
            [bordered(s, GRAM) for s in streams], GRAM, known["gram"].to_numpy(), known["value"].to_numpy()
        )
        size = np.array([len(s) + 1 for s in streams], np.int64)
        return pa.table({
            "doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": out["n_tokens"], "n_known": out["n_known"],
            "train_tokens": pa.array(np.full(len(streams), total, np.int64)), "base_score": out["base_score"], "score": pa.array(sums),
            "n_bytes": pa.array(size), "bits_per_byte": pa.array(-sums / np.log10(2) / size),
        })

    layout = (
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
        "score double, n_bytes bigint, bits_per_byte double"
    )
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean_pair(score), layout)
