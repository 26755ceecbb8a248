"""Ranked lexical search of many queries at once, by common sub-expressions.

All items are evaluated together. Terms that stand in exactly the same items, as
often in each, form one shared term set (an atom). An item is a list of atoms,
those of most items first; equal beginnings of such lists are one node. The
atoms and nodes of all items are a graph in which every shared part exists once.
It is mined by grouping hashes: no pairs of terms or of items are listed.

Tasks read the documents once and write their postings (the terms of the items
that occur, and the number of all terms). After the counts over all documents
are known, tasks read the postings in blocks. For a block they materialise each
atom's accumulator over its documents once, go down the graph level by level,
where a node is its parent plus an atom, and read an item's scores off the node
where it ends. A task keeps the best documents of each item; what moves is that
many rows per item and task.

Items are taken in groups of at most ``GROUP`` bytes of text on average, so the
graph, which every task receives, does not grow with the table of items;
postings and scores are computed group by group.

Defined cases: null or empty texts have no terms; rows with one item id (or with
none) are one item with the terms of all of them; repeated documents and rows
without id are ranked each, null ids last among equal scores; items without
terms, and all items where no document scores above 0, have no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from paywarden.llm.common import shuffle_partitions, written
from paywarden.llm.terms import word_blocks

#: Mean bytes of text in a group of items.
GROUP = 1 << 20
#: Accumulated scores that a task holds for one level of the graph.
CELLS = 1 << 21


def term_counts(text: str | None) -> tuple[Counter, int]:
    """How often each term occurs in a text, and how many terms it has."""
    counts: Counter = Counter()
    for words in word_blocks(text):
        counts.update(words)
    return counts, counts.total()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of all items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, times = [], [], []
            for at, text in enumerate(batch.column("text")):
                found, _ = term_counts(text.as_py())
                ids += [at] * len(found)
                terms += found.keys()
                times += found.values()
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(ids, pa.int64())), pa.array(terms, pa.binary()), pa.array(times, pa.int64())],
                ["item_id", "term", "times"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(count, f"item_id {kind}, term binary, times bigint")
    return rows.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def with_atoms(terms: DataFrame) -> DataFrame:
    """(item_id, term, times, items, atom): terms of the same items, as often in each, share an atom."""
    seen = [F.bit_xor(F.xxhash64(F.lit(seed), "item_id", "times")) for seed in (1, 2)]
    marks = terms.groupBy("term").agg(F.count(F.lit(1)).alias("items"), F.struct(F.count(F.lit(1)), *seen).alias("atom"))
    return terms.join(marks, "term")


def sharing(atoms: DataFrame) -> DataFrame:
    """(item_id, level, atom, times, node, parent, last): each item as a way down the graph.

    A node is known by the set of its atoms, because the order of atoms is the same for all items.
    """
    order = [F.col("items").desc(), "atom"]
    lists = atoms.groupBy("item_id", "atom", "times", "items").agg(F.count(F.lit(1)).alias("terms"))
    along = Window.partitionBy("item_id").orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    set_hash = [F.bit_xor(F.xxhash64(F.lit(seed), "atom", "times")).over(upto) for seed in (3, 4)]
    placed = lists.select(
        "item_id", "atom", "times", F.row_number().over(along).alias("level"), F.struct(*set_hash).alias("node"),
        F.lead("atom").over(along).isNull().alias("last"),
    )
    return placed.withColumn("parent", F.lag("node").over(Window.partitionBy("item_id").orderBy("level")))


@dataclass
class Graph:
    """The items of a group: terms by atom, levels of nodes, and where items end."""

    items: list
    terms: dict[bytes, int]
    atom_of: np.ndarray
    atoms: int
    #: Per level, the parent's place in the level above, the atom, and how often its terms count.
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: Per level, the nodes where items end, and the items' numbers.
    ends: list[tuple[np.ndarray, np.ndarray]]

    @property
    def width(self) -> int:
        return max([1, self.atoms, len(self.items), *(len(parent) for parent, _, _ in self.levels)])


def mined(items: DataFrame) -> Graph:
    """The graph of a group of items, whose size the group bounds."""
    atoms = written(with_atoms(item_terms(items)), "atoms")
    numbers: dict = {}
    of_term = {bytes(term): numbers.setdefault(atom, len(numbers)) for term, atom in atoms.select("term", "atom").distinct().collect()}
    ways = sharing(atoms).orderBy("level").collect()
    known, levels, ends, item_ids = {None: 0}, [], [], []
    for way in ways:
        if way.level > len(levels):
            above, known = known, {}
            levels.append(([], [], []))
            ends.append(([], []))
        if way.node not in known:
            known[way.node] = len(known)
            for column, value in zip(levels[-1], (above[way.parent], numbers[way.atom], way.times)):
                column.append(value)
        if way.last:
            ends[-1][0].append(known[way.node])
            ends[-1][1].append(len(item_ids))
            item_ids.append(way.item_id)
    whole = lambda columns: tuple(np.array(c, np.int64) for c in columns)
    places = {term: i for i, term in enumerate(of_term)}
    return Graph(item_ids, places, np.array(list(of_term.values()), np.int64), len(numbers), list(map(whole, levels)), list(map(whole, ends)))


def postings(docs: DataFrame, graph: Graph) -> DataFrame:
    """(doc_id, n, terms, times): all terms of a document counted, those of the items listed."""
    held = docs.sparkSession.sparkContext.broadcast(graph.terms)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = held.value
        for batch in batches:
            sizes, ends, terms, times = [], [0], [], []
            for text in batch.column("text"):
                found, n = term_counts(text.as_py())
                for term in found.keys() & places.keys():
                    terms.append(places[term])
                    times.append(found[term])
                sizes.append(n)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(values, kind)) for values, kind in ((terms, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(post, f"doc_id {kind}, n bigint, terms array<int>, times array<bigint>")


def weights(rows: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """(weight of each term, documents with terms, all terms)."""
    documents, size = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(terms, np.int64)
    for term, n in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect():
        frequency[term] = n  # one row per term of the group at most
    weight = [floor(1000 * log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency]
    return np.array(weight, np.int64), documents, size


def accumulated(graph: Graph, weight: np.ndarray, documents: int, size: int, block: pa.RecordBatch) -> np.ndarray:
    """Scores (item x document) of a block of postings."""
    n = block.num_rows
    lists = block.column("terms")
    owner = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
    terms = lists.flatten().to_numpy(zero_copy_only=False)
    times = block.column("times").flatten().to_numpy(zero_copy_only=False)
    damping = np.array([75 + 25 * length * documents // size for length in block.column("n").to_pylist()] if size else [], np.int64)
    shares = weight[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * damping[owner]))
    atoms = np.zeros((graph.atoms, n), np.int64)
    np.add.at(atoms, (graph.atom_of[terms], owner), shares)
    scores = np.zeros((len(graph.items), n), np.int64)
    above = np.zeros((1, n), np.int64)
    for (parent, atom, repeats), (node, item) in zip(graph.levels, graph.ends):
        above = above[parent] + atoms[atom] * repeats[:, None]
        scores[item] = above[node]
    return scores


class Best:
    """The highest scores of each item so far, ties to the smaller id, null ids last."""

    def __init__(self, items: int, most: int):
        self.most = most
        self.floor = np.ones(items, np.int64)
        self.rows = np.empty((4, 0), np.int64)

    def add(self, scores: np.ndarray, unknown: np.ndarray, ids: np.ndarray) -> None:
        """Rows hold (item, score, whether the id is null, id)."""
        least = self.floor
        if scores.shape[1] > self.most:
            least = np.maximum(least, np.partition(scores, -self.most, axis=1)[:, -self.most])
        item, at = np.nonzero(scores >= least[:, None])
        found = np.stack([item, scores[item, at], unknown[at], ids[at]])
        self.rows = np.concatenate([self.rows, found], axis=1)
        item, score, null, own = self.rows
        order = np.lexsort((own, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        kept = order[np.arange(len(order)) - first < self.most]
        self.rows = self.rows[:, kept]
        item, score, _, _ = self.rows
        full = np.flatnonzero(np.bincount(item, minlength=len(self.floor)) >= self.most)
        last = np.searchsorted(item, full, side="right") - 1
        self.floor[full] = score[last]


def best_of_tasks(rows: DataFrame, graph: Graph, weight: np.ndarray, documents: int, size: int, most: int) -> DataFrame:
    """(item, score, doc_id): each task's best documents of every item."""
    held = rows.sparkSession.sparkContext.broadcast((graph, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of_term = held.value
        best, step = Best(len(own.items), most), max(16, CELLS // own.width)
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                block = batch.slice(begin, step)
                ids = block.column("doc_id")
                unknown = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                best.add(accumulated(own, of_term, documents, size, block), unknown, values)
        item, value, null, doc_id = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(value), pa.array(doc_id, mask=null.astype(bool))], ["item", "score", "doc_id"]
        )

    return rows.mapInArrow(score, "item bigint, score bigint, doc_id bigint")


def best_of_all(rows: DataFrame, most: int) -> DataFrame:
    """Rows with the rank of the best ones per item; parts of an item's rows are reduced before they meet."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(shuffle_partitions(rows.sparkSession)))
    for keys in (["item", "part"], ["item"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = rows.withColumn("part", part).withColumn("rank", place).where(F.col("rank") <= most)
    return rows


def ranked(docs: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item."""
    spark = docs.sparkSession
    own = items.select("item_id", "text")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, ceil(size / GROUP))
    found = None
    for group in range(groups):
        graph = mined(own.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group))
        rows = written(postings(docs, graph), "postings")
        weight, documents, terms = weights(rows, len(graph.terms))
        best = best_of_all(best_of_tasks(rows, graph, weight, documents, terms, most), most)
        names = spark.createDataFrame(list(enumerate(graph.items)), f"item bigint, item_id {own.schema['item_id'].dataType.simpleString()}")
        part = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found
