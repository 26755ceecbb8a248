"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its 5-word shingles. Documents with equal sets form a
class; the join works on classes. A min-wise signature embeds each set, and a
tree branches on it: a node picks two signature places, and documents that
agree in one go on together. Two sets of similarity s share a branch with
probability s, so from s = 0.75 on a tree keeps a pair together down to any
depth with a probability of 8/9 at least; independent trees raise that to the
target recall (1 - 9**-TREES).

The upper levels are Spark joins; a node of at most NODE documents is one group
of a task, which branches on until its nodes are small and compares them
exhaustively. Trees run in two ways. First every node proposes a spanning
forest of its likeliest pairs, so a group of n near copies costs n pairs, not
n * n; what full sets confirm gives components. Then the nodes that still hold
several components go down the trees and give all likely pairs between them.
Nodes that branching does not thin out, or half of which is one component, are
compared exactly on full sets, in blocks.

Every link is confirmed on full shingle sets. Pairs inside a component found
before are skipped, as they change no component.

Defined cases: a null or empty text, or one without words, has no shingles, is
linked with nothing and kept; with fewer than five words the whole sequence is
the one shingle; rows that share an id are one document, linked by any of their
texts; a row without id is linked with nothing and kept; an empty table gives
no rows; ties cannot occur, ids decide. ``keep`` goes further: rows without id
take part by their texts, after all rows with an id, and of the rows of a kept
document one stays per class; rows without shingles all stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paywarden.llm.common import SPACE, lean_batches, lean_pair, numbered, shuffle_partitions, text_mark, utf8, written
from paywarden.llm.components import components

#: Words of a shingle, and the link condition: PART * intersection >= WHOLE * union.
WORDS, PART, WHOLE = 5, 100, 75
#: Signature places, independent trees, documents of a node that is compared exhaustively, and of one that a task branches.
PLACES, TREES, LEAF, NODE = 128, 8, 40, 4096
#: Documents of a part of a node that gets a spanning forest: all their pairs are held at once.
FOREST_DOCS = 1024
#: Likely pairs agree in this many places at least; a linked pair does not with a probability below 1e-7.
AGREEING = 69
#: Documents of a dense cluster that a task compares with as many others.
BLOCK_DOCS = 1024
#: Levels of a tree in joins and in a task. Dense nodes: the share that goes down together, the mean likeness of all pairs.
DEPTH, TASK_DEPTH, DENSE, ALIKE = 8, 24, 0.85, 0.6
#: Times that spanning forests are proposed.
FORESTS = 1

RANDOM = np.random.default_rng(20240601)
MIX = RANDOM.integers(0, 1 << 63, WORDS + 1, np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = RANDOM.integers(0, 1 << 32, PLACES, np.uint32)
ODD = RANDOM.integers(0, 1 << 31, PLACES, np.uint32) * np.uint32(2) + np.uint32(1)
#: Shingles whose signature is taken at a time, and bytes whose words are hashed at a time.
BLOCK, PIECE = 512, 1 << 18
#: Where the counts of a signature place begin.
SLOTS = 256 * np.arange(PLACES)
#: A word's hash is a polynomial of its bytes' numbers; POWERS and INVERSES hold the powers of its odd base.
LETTERS = RANDOM.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
BASE = int(RANDOM.integers(0, 1 << 62)) * 4 + 3
POWERS = np.cumprod(np.full(2 * PIECE, BASE, np.uint64))
INVERSES = np.cumprod(np.full(2 * PIECE, pow(BASE, -1, 1 << 64), np.uint64))
IS_SPACE = np.isin(np.arange(256), list(SPACE))
NEXT_SPACE = re.compile(rb"[\x20\x09-\x0D]|\Z")


def scrambled(values: np.ndarray) -> np.ndarray:
    """The last steps of a hash: every bit depends on all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def piece_words(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a piece of text, in order."""
    data = np.frombuffer(raw, np.uint8)
    outside = np.ones(len(data) + 2, np.int8)
    outside[1:-1] = IS_SPACE[data]
    edges = np.diff(outside)
    start, end = np.flatnonzero(edges < 0), np.flatnonzero(edges > 0)
    if len(data) <= len(POWERS):
        powers, inverses = POWERS, INVERSES
    else:  # one word longer than a piece
        powers = np.cumprod(np.full(len(data), BASE, np.uint64))
        inverses = np.cumprod(np.full(len(data), INVERSES[0], np.uint64))
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * powers[:len(data)], out=upto[1:])
    return scrambled((upto[end] - upto[start]) * inverses[start] + (end - start).astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of all words; long texts are cut between words."""
    parts, begin = [], 0
    while begin < len(raw):
        end = NEXT_SPACE.search(raw, min(begin + PIECE, len(raw))).start()
        parts.append(piece_words(raw[begin:end]))
        begin = end + 1
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a whole text, as sorted 64-bit hashes."""
    coded = word_hashes(utf8(text).lower())
    if not len(coded):
        return coded
    width = min(WORDS, len(coded))
    count = len(coded) - width + 1
    summed = np.full(count, np.uint64(width)) * MIX[WORDS]
    for place in range(width):
        summed += coded[place:place + count] * MIX[place]
    return np.unique(scrambled(summed))


def signature(found: np.ndarray) -> np.ndarray:
    """Least value of the set under each of the permutations."""
    short, least = (found >> np.uint64(32)).astype(np.uint32), np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(short), BLOCK):
        values = (short[begin:begin + BLOCK, None] ^ FLIP) * ODD
        values ^= values >> np.uint32(15)
        least = np.minimum(least, values.min(axis=0))
    return least


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, size and digest of the shingle set, the places of the roots, one byte of every place, further columns as they are."""
    for batch in batches:
        sizes, first, second, roots, places = [], [], [], [], []
        for text in batch.column("text"):
            found = shingles(text.as_py())
            sizes.append(len(found))
            first.append(int(found.sum().view(np.int64)) if len(found) else 0)
            second.append(int(np.bitwise_xor.reduce(scrambled(found + MIX[0])).view(np.int64)) if len(found) else 0)
            least = signature(found)
            roots.append(least[:2 * TREES].view(np.int32))
            places.append((least & np.uint32(255)).astype(np.uint8).tobytes())
        flat = np.concatenate(roots) if roots else np.empty(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(roots) + 1) * 2 * TREES, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
             lists, pa.array(places, pa.binary()), *(batch.column(c) for c in batch.schema.names[2:])],
            ["doc_id", "n_shingles", "sum", "mark", "top", "sig", *batch.schema.names[2:]],
        )


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and its whole shingle set."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            sets = [shingles(text.as_py()).view(np.int64) for text in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "found"])


def linked(common: Column, size_a: Column, size_b: Column) -> Column:
    return PART * common >= WHOLE * (size_a + size_b - common)


def first_nodes(classes: DataFrame) -> DataFrame:
    """(node, rep, root, was): two branches at the root of every tree; ``was`` is the size of the node above."""
    keys = [F.xxhash64(F.lit(place), F.col("top")[place]) for place in range(2 * TREES)]
    return classes.select(
        F.explode(F.array(*keys)).alias("node"), "rep", F.col("rep").alias("root"), F.lit(None).cast("bigint").alias("was")
    )


def next_nodes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows' documents in the two child nodes; a node's places follow from its key."""
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PLACES)).cast("int")
    step = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(PLACES - 1)).cast("int") + 1
    children = [F.xxhash64("node", place, F.substring("sig", place + 1, F.lit(1))) for place in (first, (first + step) % PLACES)]
    return rows.join(classes.select("rep", "sig"), "rep").select(
        F.explode(F.array(*children)).alias("node"), "rep", "root", F.col("n").alias("was")
    )


def with_nodes(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold more than one component: the node's size and least document, a document drawn
    from it, and its largest component as ``major``."""
    parts = rows.groupBy("node", "root").agg(
        F.count("*").alias("n"), F.min("rep").alias("least"), F.max("was").alias("was"),
        F.min(F.struct(F.xxhash64("node", "rep").alias("draw"), "rep", "root")).alias("drawn"),
    )
    nodes = parts.groupBy(F.col("node").alias("key")).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.min("drawn").alias("drawn"), F.max("was").alias("above"),
        F.max(F.struct("n", "root")).alias("major"), F.count("*").alias("parts"),
    ).where(F.col("parts") > 1)
    return rows.join(nodes, F.col("node") == F.col("key")).select(
        "node", "rep", "root", "n", "least", F.col("drawn.rep").alias("drawn"), F.col("drawn.root").alias("drawn_root"),
        F.col("major.root").alias("major"),
        (F.coalesce(F.col("n") >= DENSE * F.col("above"), F.lit(False)) | (2 * F.col("major.n") >= F.col("n"))).alias("dense"),
    )


def still_open(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The classes that the nodes still hold: what the next joins move."""
    held = rows.select(F.col("rep").alias("held")).distinct()
    return written(classes.join(held, F.col("rep") == F.col("held"), "left_semi").select("rep", "n_shingles", "sig"), "open")


def whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, ids, roots, sizes, signatures) of every node, from rows sorted by node."""
    rest = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([rest, new]) if rest is not None else new).combine_chunks()
        nodes, ids, roots, sizes = (rows[c].to_numpy() for c in ("node", "rep", "root", "n_shingles"))
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(-1, PLACES)
        cuts = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1)]
        for begin, end in zip(cuts, cuts[1:]):
            yield int(nodes[begin]), ids[begin:end], roots[begin:end], sizes[begin:end], sig[begin:end]
        rest = rows.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield int(nodes[cuts[-1]]), ids[cuts[-1]:], roots[cuts[-1]:], sizes[cuts[-1]:], sig[cuts[-1]:]


def lower_nodes(node: int, roots: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """The places of the documents of all small (False) and dense (True) nodes that a node branches into."""
    above = [(np.random.default_rng(node & 0x7FFFFFFFFFFFFFFF), np.arange(len(roots)), 0)]
    while above:
        draw, at, depth = above.pop()
        parts = np.unique(roots[at], return_counts=True)[1]
        if len(parts) < 2:
            continue
        if len(at) <= LEAF:
            yield at, False
            continue
        counts = np.bincount((sig[at] + SLOTS).ravel(), minlength=256 * PLACES).reshape(PLACES, 256)
        splitting = np.flatnonzero(counts.max(axis=1) < len(at))
        thick = np.square(counts / len(at)).sum() >= ALIKE * PLACES or len(parts) < len(at) and 2 * parts.max() >= len(at)
        if thick or depth == TASK_DEPTH or len(splitting) < 2:
            yield at, True
            continue
        for place in draw.choice(splitting, 2, replace=False):
            values = sig[at, place]
            order = np.argsort(values, kind="stable")
            for part in np.split(at[order], np.flatnonzero(np.diff(values[order])) + 1):
                if len(part) > 1:
                    above.append((np.random.default_rng(draw.integers(1 << 62)), part, depth + 1))


def agreements(sizes: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """In how many places two documents of a node agree; 0 if their sizes allow no link."""
    same = np.empty((len(sig), len(sig)), np.int16)
    for begin in range(0, len(sig), LEAF):
        same[begin:begin + LEAF] = (sig[begin:begin + LEAF, None] == sig).sum(axis=2)
    same[PART * np.minimum.outer(sizes, sizes) < WHOLE * np.maximum.outer(sizes, sizes)] = 0
    return same


def forest(roots: np.ndarray, sizes: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(a, b, agreeing): likely pairs that span the components of a node, the likeliest first from where it stands."""
    count = len(roots)
    agreeing = np.where(np.equal.outer(roots, roots), PLACES + 1, agreements(sizes, sig))
    best, near, at = np.full(count, -1), np.zeros(count, np.int64), int(np.argmin(roots))
    inside = np.zeros(count, bool)
    for _ in range(count - 1):
        inside[at], best[at] = True, -2
        better = ~inside & (agreeing[at] > best)
        best[better], near[better] = agreeing[at, better], at
        at = int(np.argmax(best))
        if AGREEING <= best[at] <= PLACES:
            yield int(near[at]), at, int(best[at])


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, component, agreeing): the spanning forests of all nodes, with the component of b."""
    for node, ids, roots, sizes, sig in whole_nodes(batches):
        found: set[tuple[int, int, int]] = set()
        for at, _ in lower_nodes(node, roots, sig):
            found.update((int(at[x]), int(at[y]), n) for x, y, n in forest(roots[at], sizes[at], sig[at]))
        if found:
            a, b, n = (np.array(c) for c in zip(*sorted(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[a], ids[b], roots[b], n)], ["a", "b", "component", "agreeing"])


def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, dense): all likely pairs between the components of small nodes; for dense ones their least document and each."""
    for node, ids, roots, sizes, sig in whole_nodes(batches):
        pairs: set[tuple[int, int]] = set()
        thick: set[tuple[int, int]] = set()
        for at, dense in lower_nodes(node, roots, sig):
            if dense:
                thick.update((int(ids[at].min()), int(i)) for i in ids[at])
                continue
            likely = (agreements(sizes[at], sig[at]) >= AGREEING) & np.not_equal.outer(roots[at], roots[at])
            for x, y in zip(*np.nonzero(likely)):
                if ids[at[x]] < ids[at[y]]:
                    pairs.add((int(ids[at[x]]), int(ids[at[y]])))
        for rows, dense in ((pairs, False), (thick, True)):
            if rows:
                a, b = (pa.array(c, pa.int64()) for c in zip(*sorted(rows)))
                yield pa.RecordBatch.from_arrays([a, b, pa.array([dense] * len(rows))], ["a", "b", "dense"])


def by_node(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows with size and signature of their class, every node in one task, one after the other."""
    known = classes.select(F.col("rep").alias("own"), "n_shingles", "sig")
    held = rows.select("node", "rep", "root").join(known, F.col("rep") == F.col("own"))
    tasks = shuffle_partitions(rows.sparkSession)  # many small tasks: a node costs more time than bytes
    return held.select("node", "rep", "root", "n_shingles", "sig").repartition(tasks, "node").sortWithinPartitions("node")


def in_parts(rows: DataFrame, centre: str) -> DataFrame:
    """Rows of nodes of at most FOREST_DOCS or so: a larger node falls into parts, each with the same one of its documents."""
    parts = F.ceil(F.col("n") / FOREST_DOCS).cast("int")
    small, large = rows.where(F.col("n") <= FOREST_DOCS), rows.where(F.col("n") > FOREST_DOCS)
    dealt = large.select(F.xxhash64("node", F.pmod(F.xxhash64("rep"), parts)).alias("node"), "rep", "root")
    middle = large.where(F.col("rep") == F.col(centre)).select(
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "node", "rep", "root"
    ).select(F.xxhash64("node", F.col("part").cast("bigint")).alias("node"), "rep", "root")
    return small.select("node", "rep", "root").unionByName(dealt).unionByName(middle).distinct()


def proposed(rows: DataFrame, classes: DataFrame, centre: str) -> DataFrame:
    """(a, b): the spanning forests of all nodes, one pair per component: its likeliest."""
    pairs = by_node(in_parts(rows, centre), classes).mapInArrow(lean_batches(forests), "a bigint, b bigint, component bigint, agreeing bigint")
    best = pairs.groupBy("component").agg(F.max(F.struct("agreeing", -F.col("a"), "a", "b")).alias("best"))
    return best.select(F.least("best.a", "best.b").alias("a"), F.greatest("best.a", "best.b").alias("b")).distinct()


def arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A list column as one array per row."""
    lists = column.combine_chunks()
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [values[begin:end] for begin, end in zip(ends, ends[1:])]


def compared(left: pa.Table, right: pa.Table) -> pa.Table:
    """(a, b): links between documents of different components, from their full sets; they span what all links join."""
    found: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        ids, roots = (right[c].to_numpy() for c in ("rep", "root"))
        main, sets = roots == right["major"][0].as_py(), arrays(right["found"])
        # Every shingle of the right side with the documents that have it.
        counts = np.array([len(own) for own in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, holders = values[order], np.repeat(np.arange(len(sets)), counts)[order]
        # The group, of those that links have joined, of every component.
        known, at = np.unique(np.concatenate([left["root"].to_numpy(), roots]), return_inverse=True)
        group, (own_part, parts) = np.arange(len(known)), np.split(at, [left.num_rows])
        for rep, part, own in zip(left["rep"].to_pylist(), own_part, arrays(left["found"])):
            begin, end = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            lengths = end - begin
            at = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            common = np.bincount(holders[at], minlength=len(sets))
            open_ = (group[parts] != group[part]) & (main | (ids > rep))
            links = np.flatnonzero(open_ & (PART * common >= WHOLE * (len(own) + counts - common)))
            joined, first = np.unique(group[parts[links]], return_index=True)
            found += [(rep, int(i)) for i in ids[links[first]]]
            group[np.isin(group, joined)] = group[part]
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def dense_links(rows: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame:
    """The links that dense nodes, rows of (a, b), leave open, by exact comparison.

    Documents that share such nodes form a cluster, in which each stands once. The documents outside the cluster's
    largest component are compared with all of it, in blocks of a bounded number of documents.
    """
    together = rows.select("a", "b")
    clusters = components(together).select(F.col("node").alias("own"), F.col("root").alias("cluster"))
    known = clusters.join(roots.withColumnRenamed("node", "rep"), F.col("own") == F.col("rep"), "left")
    members = written(known.select(F.col("own").alias("rep"), F.coalesce("root", "own").alias("root"), "cluster"), "members")
    sizes = members.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy(F.col("cluster").alias("of")).agg(
        F.ceil(F.sum("n") / BLOCK_DOCS).cast("int").alias("blocks"), F.max(F.struct("n", "root"))["root"].alias("major")
    )
    wanted = members.select(F.col("rep").alias("doc_id"))
    sets = docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lean_batches(full_sets), "doc_id bigint, found array<bigint>")
    known = sets.select(F.col("doc_id").alias("own"), "found")
    placed = written(
        members.join(sizes, F.col("cluster") == F.col("of")).join(known, F.col("rep") == F.col("own"))
        .select("cluster", "rep", "root", "major", "found", "blocks",
                F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")),
        "placed",
    )
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ["rep", "root", "major", "found"]
    left = placed.where(F.col("root") != F.col("major")).select("cluster", F.col("block").alias("i"), every.alias("j"), *columns)
    right = placed.select("cluster", every.alias("i"), F.col("block").alias("j"), *columns)
    return left.groupBy("cluster", "i", "j").cogroup(right.groupBy("cluster", "i", "j")).applyInArrow(
        lean_pair(compared), "a bigint, b bigint"
    )


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets fulfil the link condition."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text")
    sets = written(texts.mapInArrow(lean_batches(full_sets), "doc_id bigint, found array<bigint>"), "sets")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("found").alias(f"set_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(linked(common, F.size("set_a"), F.size("set_b"))).select("a", "b").distinct()


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of nodes with the component of every document."""
    known = roots.withColumnRenamed("node", "own")
    return rows.select("node", "rep").join(known, F.col("rep") == F.col("own"), "left").select(
        "node", "rep", F.coalesce("root", "rep").alias("root"), F.lit(None).cast("bigint").alias("was")
    )


def shared_ids(members: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    several = members.where(F.col("rep").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.min("rep").alias("a"), F.max("rep").alias("high")
    ).where(F.col("a") != F.col("high"))
    return members.join(several, (F.col("doc_id") == F.col("id")) & (F.col("rep") != F.col("a"))).select(
        "a", F.col("rep").alias("b")
    )


def placed(docs: DataFrame, *columns: str) -> DataFrame:
    """Per row: doc_id, n_shingles, rep of its class, component_id, kept; with further bigint columns also sum and mark."""
    layout = ", ".join(["doc_id bigint, n_shingles bigint, sum bigint, mark bigint, top array<int>, sig binary", *(f"{c} bigint" for c in columns)])
    signed = written(docs.select("doc_id", "text", *columns).mapInArrow(lean_batches(signatures), layout), "signatures")
    docs = docs.select("doc_id", "text")
    identity = ["n_shingles", "sum", "mark"]
    carried = [*identity[1:], *columns] if columns else []
    classes = written(
        signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy(*identity)
        .agg(F.min("doc_id").alias("rep"), F.first("top").alias("top"), F.first("sig").alias("sig")),
        "classes",
    )
    rows = written(with_nodes(first_nodes(classes)), "nodes")
    members = written(
        signed.select("doc_id", *identity, *columns).join(classes.select(*identity, "rep"), identity, "left")
        .select("doc_id", "n_shingles", "rep", *carried), "members",
    )
    links = written(shared_ids(members), "links")
    classes = still_open(classes, rows)
    for turn in range(FORESTS):
        pairs = written(proposed(rows, classes, ("least", "drawn")[turn % 2]), "proposed")
        links = written(links.unionByName(confirmed(pairs, docs)), "links")
        roots = components(links)
        rows = written(with_nodes(with_roots(rows, roots)), "nodes")
    in_nodes = open_ = still_open(classes, rows)
    small, dense = [], []
    for _ in range(DEPTH):
        light, thick = (F.col("n") <= LEAF) | (F.col("n") <= NODE) & ~F.col("dense"), F.col("dense")
        small.append(rows.where(light))
        dense.append(rows.where(~light & thick))
        rows = rows.where(~light & ~thick)
        if rows.isEmpty():
            break
        # One level at a time: nodes of one component and dense ones go no further.
        rows = written(with_nodes(written(next_nodes(rows, in_nodes), "children")), "nodes")
        in_nodes = still_open(in_nodes, rows)
    pairs = by_node(reduce(DataFrame.unionByName, small), open_).mapInArrow(lean_batches(open_pairs), "a bigint, b bigint, dense boolean")
    found = written(pairs.distinct(), "candidates")
    more = found.where(~F.col("dense")).select("a", "b")
    thick = reduce(DataFrame.unionByName, [*dense, rows]).select(F.col("least").alias("a"), F.col("rep").alias("b"))
    thick = written(found.where("dense").select("a", "b").unionByName(thick).distinct(), "dense")
    extra = []
    if not more.isEmpty():
        extra.append(confirmed(more, docs))
    if not thick.isEmpty():
        extra.append(dense_links(thick, roots, docs))
    if extra:
        roots = components(written(reduce(DataFrame.unionByName, [links, *extra]), "links"))
    rooted = members.join(roots, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return rooted.select("doc_id", "n_shingles", "rep", component.alias("component_id"), *carried).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept; the least id of a component is kept."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return placed(docs).select("doc_id", "n_shingles", "component_id", "kept")


def text_numbers(rows: DataFrame) -> DataFrame:
    """(mark_a, mark_b, number): ids for the texts of rows without one, above all ids or, without room there, below."""
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    texts = written(rows.where(F.col("doc_id").isNull()).select("mark_a", "mark_b").distinct(), "unnamed")
    count = texts.count()
    if ends["high"] is None or ends["high"] + count < 1 << 63:
        start = 0 if ends["high"] is None else ends["high"] + 1
    elif ends["low"] - count >= -(1 << 63):
        start = ends["low"] - count
    else:
        raise ValueError("The ids leave no room for numbers of the rows without id.")
    ordered = numbered(texts, [F.col("mark_a"), F.col("mark_b")], "place")
    return written(ordered.select("mark_a", "mark_b", (F.col("place") + F.lit(start)).alias("number")), "numbers")


def keep(docs: DataFrame) -> DataFrame:
    """One row of every component's kept id and class, with all its columns.

    Rows without id get numbers by their texts, so they join their class and its near-duplicates. Of a kept id one text
    per class stays, and of rows with this id and text one.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *(c.alias(name) for name, c in text_mark().items()))
    numbers = text_numbers(rows)
    unnamed = rows.where(F.col("doc_id").isNull()).drop("doc_id").join(numbers, ["mark_a", "mark_b"])
    unnamed = written(unnamed.select(F.col("number").alias("doc_id"), "text", "mark_a", "mark_b"), "unnamed_rows")
    whole = rows.where(F.col("doc_id").isNotNull()).unionByName(unnamed)
    # One id may stand for several classes, so a class is known by its set.
    kind = ["doc_id", "n_shingles", "sum", "mark"]
    texts = placed(whole, "mark_a", "mark_b").where(F.col("rep").isNotNull())
    texts = written(texts.groupBy(*kind, "kept", "mark_a", "mark_b").agg(F.count("*").alias("n")), "texts")
    chosen = texts.where("kept").groupBy(*kind).agg(F.min(F.struct("mark_a", "mark_b")).alias("chosen"))
    fates = texts.join(chosen, kind, "left").withColumn(
        "stays", F.coalesce(F.col("kept") & (F.struct("mark_a", "mark_b") == F.col("chosen")), F.lit(False))
    ).where(~F.col("stays") | (F.col("n") > 1))
    known = numbers.select(F.col("number"), F.lit(True).alias("by_text"))
    fates = written(
        fates.join(known, F.col("doc_id") == F.col("number"), "left").select(
            F.when(F.col("by_text").isNull(), F.col("doc_id")).alias("_id"), F.col("mark_a").alias("_a"), F.col("mark_b").alias("_b"), "stays"
        ), "fates",
    )
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("_own"), *text_mark().values())
    own = own.toDF("row", "_own", "mark_a", "mark_b")
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("mark_a") == F.col("_a")) & (F.col("mark_b") == F.col("_b"))
    once = own.join(fates, same, "left_anti").select("row")
    # Every task keeps one row per id and text before rows move.
    several = own.join(fates.where("stays"), same).groupBy("_own", "mark_a", "mark_b").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(several).select("row.*")
