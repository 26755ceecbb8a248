"""Operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

import corpus_pipeline
from paywarden.llm import chosen_path, chunks, components, ctw, kneser_ney, mixing, rules, toxicity, warc
from paywarden.llm.common import held_out
from paywarden.llm.grams import Lookup, blocks
from paywarden.llm.sentencepiece import Tokenizer, decoder, encoder

GIVEN = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{GIVEN}/documents.parquet").orderBy("doc_id").select("doc_id", "text").limit(250).collect()
    odd = ["", " ", "  a   b ", "\n\n\t x", "漢字かな 😀", "a" * 300, "don't; https://example.com/?a=b&c=d \\ ünïcödé", "\x00\x01"]
    return [(r[0], r[1]) for r in rows] + [(100_000 + i, t) for i, t in enumerate(odd)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id bigint, text string, lang string, source string")


def model_bytes(kind: int, scores: random.Random | None = None) -> bytes:
    with open(corpus_pipeline.TOKENIZER, "rb") as file:
        spec = proto.ModelProto.FromString(file.read())
    spec.trainer_spec.model_type = kind
    for piece in spec.pieces if scores else ():
        if piece.type == 1:
            piece.score = -2 - 8 * scores.random()
    return spec.SerializeToString()


def test_bpe_ids_equal_the_library(texts):
    model = model_bytes(2)
    own, library = Tokenizer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for _, text in texts:
        ids = own.encode(text).tolist()
        assert ids == library.encode(text)
        assert own.decode(ids) == text == library.decode(ids)


def test_unigram_way_is_the_best(texts):
    model = model_bytes(1, random.Random(3))
    own, library = Tokenizer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    worth = lambda ids: sum(library.get_score(i) for i in ids)
    for _, text in texts[:120]:
        mine, theirs = own.encode(text).tolist(), library.encode(text)
        assert mine == theirs or worth(mine) >= worth(theirs) - 1e-3
        assert own.decode(mine) == text


def test_decoding_in_spark(spark, docs):
    encode, decode = encoder(spark, corpus_pipeline.TOKENIZER), decoder(spark, corpus_pipeline.TOKENIZER)
    back = docs.withColumn("back", decode(encode("text")["ids"]))
    assert back.where(~F.col("back").eqNullSafe(F.col("text"))).count() == 0


def test_toxicity_on_held_out_labels(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labelled = rows.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id")
    labels = labelled.where(~held_out(F.col("doc_id"), 5)).select("doc_id", "toxic")
    model = toxicity.fit(rows, labels)
    found = toxicity.scored(labelled.where(held_out(F.col("doc_id"), 5)), model)
    counts = Counter((r["toxic"], r["predicted"]) for r in found.join(labelled, "doc_id").collect())
    assert counts[0, 1] <= 0.01 * (counts[0, 0] + counts[0, 1])
    assert counts[1, 1] >= 0.8 * (counts[1, 0] + counts[1, 1])


def test_toxicity_without_both_classes(spark, docs):
    for label, score in ((1, 1.0), (0, 0.0)):
        labels = docs.select("doc_id", F.lit(label).alias("toxic"))
        scores = toxicity.scored(docs.limit(5), toxicity.fit(docs, labels)).collect()
        assert {round(r["score"], 6) for r in scores} == {score}


def test_warc_payloads_come_back(spark, tmp_path):
    html = ["a", "WARC/1.1\r\n\r\nx\r\n\r\n", "\r\n\r\n", "é漢😀\r\n", None, "a"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    found = warc.captures(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert len(found) == len(html)
    payloads = {r["response"]["capture_id"]: bytes(r["response"]["payload"]) for r in found if r["response"]["payload"] is not None}
    for r in found:
        page = int(r["metadata"]["fields"]["page-id"])
        payload = payloads[r["response"]["refers_to"] or r["response"]["capture_id"]]
        assert payload == (html[page] or "").encode()
        assert r["response"]["payload_bytes"] == len(payload)
        assert r["request"]["uri"] == f"http://h/{page}"


# Kneser-Ney -----------------------------------------------------------------


def kneser_ney_brute(training: list[bytes], order: int):
    """p(byte after context) straight from the definition."""
    counts: dict[int, Counter] = {k: Counter() for k in range(1, order + 1)}
    for text in training:
        padded = b"\xff" * (order - 1) + text + b"\xff"
        counts[order].update(padded[i:i + order] for i in range(len(padded) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(gram[1:] for gram in counts[k + 1])
    discounts = {k: kneser_ney.Discounts.of(*(sum(c == n for c in counts[k].values()) for n in (1, 2, 3, 4))) for k in counts}
    after = {k: defaultdict(dict) for k in counts}
    for k in counts:
        for gram, c in counts[k].items():
            after[k][gram[:-1]][gram[-1:]] = c

    def off(d, c):
        return 0 if c == 0 else d.one if c == 1 else d.two if c == 2 else d.more

    def p(gram: bytes, k: int) -> float:
        if k == 0:
            return 1 / 256
        gram = gram[-k:]
        seen, d = after[k].get(gram[:-1]), discounts[k]
        low = p(gram, k - 1)
        if not seen:
            return low
        c = seen.get(gram[-1:], 0)
        return (c - off(d, c) + sum(off(d, x) for x in seen.values()) * low) / sum(seen.values())

    return p


def test_kneser_ney_against_the_definition(spark, docs, texts):
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("quality"))
    trusted = kneser_ney.trusted_sample(labels)
    calibrates = {r["id"]: r["calibrates"] for r in trusted.collect()}
    got = {r["doc_id"]: r for r in kneser_ney.perplexities(docs, trusted).collect()}
    p = kneser_ney_brute([t.encode() for i, t in texts if calibrates.get(i) is False], kneser_ney.ORDER)
    assert abs(sum(p(b"\xff\xffth" + bytes([b]), kneser_ney.ORDER) for b in range(256)) - 1) < 1e-9
    for i, text in texts[:20] + texts[-8:]:
        padded = b"\xff" * (kneser_ney.ORDER - 1) + text.encode() + b"\xff"
        grams = [padded[j:j + kneser_ney.ORDER] for j in range(len(padded) - kneser_ney.ORDER + 1)]
        if not text:
            assert got[i]["log_ppl"] is None
        else:
            assert math.isclose(got[i]["log_ppl"], -sum(math.log10(p(g, kneser_ney.ORDER)) for g in grams) / len(grams), rel_tol=1e-9)
        assert got[i]["calibrates"] == calibrates.get(i)


def test_classifier_keeps_good_and_rejects_junk(spark):
    rows, labels = spark.read.parquet(f"{GIVEN}/documents.parquet"), spark.read.parquet(f"{GIVEN}/labels.parquet")
    verdicts = {r["doc_id"]: r["kept"] for r in kneser_ney.judged(rows, labels).collect()}
    good = [r["doc_id"] for r in labels.where("quality = 1").collect()]
    junk = [r["doc_id"] for r in rows.where(F.regexp_count("text", F.lit("[#$%&*]{3}")) > 20).collect()]
    assert sum(verdicts[i] for i in good) >= 0.98 * len(good)
    assert junk and sum(verdicts[i] for i in junk) <= 0.02 * len(junk)


def test_the_quantile_of_its_language_decides(spark):
    """Every label of quality 0, texts that repeat words among them, against a quantile taken here."""
    given = "/root/testdata/sf0.1"
    rows, labels = spark.read.parquet(f"{given}/documents.parquet"), spark.read.parquet(f"{given}/labels.parquet")
    scores = kneser_ney.perplexities(rows, kneser_ney.trusted_sample(labels)).collect()
    values = defaultdict(list)
    for r in scores:
        if r["calibrates"] and r["log_ppl"] is not None:
            values[r["lang"]].append(r["log_ppl"])
    most = {lang: sorted(v)[math.ceil(kneser_ney.QUANTILE * len(v)) - 1] for lang, v in values.items()}
    assert all(len(v) >= kneser_ney.ENOUGH for v in values.values())
    got = {r["doc_id"]: r for r in kneser_ney.judged(rows, labels).collect()}
    for r in scores:
        expected = r["log_ppl"] is not None and r["log_ppl"] <= most[r["lang"]]
        assert got[r["doc_id"]]["kept"] == expected
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    above = [r["doc_id"] for r in scores if r["doc_id"] in bad and r["log_ppl"] is not None and r["log_ppl"] > most[r["lang"]]]
    assert above and not any(got[i]["kept"] for i in above)


def test_all_trusted_rows_calibrate(spark, monkeypatch):
    """A rare language has a limit of its own, however few documents are counted."""
    monkeypatch.setattr(kneser_ney, "TRUSTED", 50)
    rng = random.Random(8)
    rows = []
    for i in range(640):
        rare = i % 16 == 0
        letters = "abcdef" if not rare else "uvwxyzßäö"
        rows.append((i, " ".join("".join(rng.choices(letters, k=4)) for _ in range(20)), "rare" if rare else "en"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    trusted = kneser_ney.trusted_sample(labels)
    assert trusted.count() == 640 and 0 < trusted.where("not calibrates").count() <= 50
    limits = {(r["lang"], r["every"]) for r in kneser_ney.thresholds(kneser_ney.perplexities(docs, trusted)).collect()}
    assert limits == {("en", False), ("rare", False), (None, True)}


def test_all_trusted_documents_are_counted(spark, docs, texts, monkeypatch):
    """The bound of the sample changes nothing: all good documents but the calibrating ones are in the model."""
    monkeypatch.setattr(kneser_ney, "TRUSTED", 5)
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 != 0, 1).otherwise(0).alias("quality"))
    good = {r["doc_id"] for r in labels.where("quality = 1").collect() if r["doc_id"] is not None}
    counted = {r["id"] for r in kneser_ney.trusted_documents(labels).where("not calibrates").collect()}
    assert counted < good and len(counted) > 0.6 * len(good)
    p = kneser_ney_brute([t.encode() for i, t in texts if i in counted], kneser_ney.ORDER)
    got = {r["doc_id"]: r["perplexity"] for r in kneser_ney.judged(docs, labels).collect()}
    for i, text in [pair for pair in texts if pair[1]][:12]:
        padded = b"\xff" * (kneser_ney.ORDER - 1) + text.encode() + b"\xff"
        grams = [padded[j:j + kneser_ney.ORDER] for j in range(len(padded) - kneser_ney.ORDER + 1)]
        assert math.isclose(math.log10(got[i]), -sum(math.log10(p(g, kneser_ney.ORDER)) for g in grams) / len(grams), rel_tol=1e-9)


def test_rows_go_by_their_own_score(spark):
    rng = random.Random(9)
    good = lambda: " ".join("".join(rng.choices("abcdef", k=4)) for _ in range(20))
    rows = [(i, good(), "en", "s") for i in range(300)]
    rows += [(None, rows[i][1], "en", "s") for i in range(50)] + [(None, "", "en", "s"), (None, None, "en", "s")]
    rows += [(None, "#$%&*" * 30, "en", "s"), (900, rows[7][1], "en", "one"), (900, "#$%&*" * 30, "en", "two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id bigint, quality int")
    got = Counter(tuple(r) for r in kneser_ney.keep(docs, labels).collect())
    own = Counter((r["doc_id"], r["n_bytes"], r["kept"]) for r in kneser_ney.judged(docs, labels).collect())
    assert Counter((i, len(t)) for i, t, _, _ in got.elements()) == Counter(
        {(i, n): c for (i, n, kept), c in own.items() if kept}
    )
    assert sum(c for (i, *_), c in got.items() if i is None) >= 48
    assert (900, rows[7][1], "en", "one") in got and not any(t and "#" in t for _, t, _, _ in got)


# Context-tree weighting -----------------------------------------------------


def tree_brute(training: list[bytes], depth: int):
    """log10 p(byte | bytes before) by recursion over the tree of every choice."""
    nodes: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    children: dict[tuple, set] = defaultdict(set)
    for text in training:
        padded = b"\xff" * depth + text + b"\xff"
        for i in range(depth, len(padded)):
            for bit in range(8):
                place = 1 << bit | padded[i] >> 8 - bit
                for d in range(depth + 1):
                    nodes[padded[i - d:i], place][padded[i] >> 7 - bit & 1] += 1
                    if d < depth:
                        children[padded[i - d:i], place].add(padded[i - d - 1:i])

    def kt(node):
        a, b = nodes[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo: dict[tuple, tuple[float, float]] = {}

    def weighted(node):
        """(log weighted probability, weight of stopping)."""
        if node not in memo:
            context, place = node
            own = kt(node)
            if len(context) == depth:
                memo[node] = own, 1.0
            else:
                below = sum(weighted((c, place))[0] for c in children[node])
                total = np.logaddexp(own, below) - math.log(2)
                memo[node] = total, math.exp(own - total) / 2
        return memo[node]

    def log_p(before: bytes, byte: int) -> float:
        total = 0.0
        for bit in range(8):
            place, choice = 1 << bit | byte >> 8 - bit, byte >> 7 - bit & 1
            path = [(before[len(before) - d:], place) for d in range(depth + 1)]
            path = [node for node in path if node in nodes]
            p = None
            for node in reversed(path):
                own = (nodes[node][choice] + 0.5) / (sum(nodes[node]) + 1)
                p = own if p is None else weighted(node)[1] * own + (1 - weighted(node)[1]) * p
            total += math.log10(0.5 if p is None else p)
        return total

    return log_p


def test_tree_weighting_against_the_definition(spark, docs, texts):
    few = texts[:25] + texts[-8:]
    got = {r["doc_id"]: r for r in ctw.scored(docs.where(F.col("doc_id").isin([i for i, _ in few]))).collect()}
    rows = {i: t.encode().lower().split() for i, t in few}
    learn = [i for i in rows if zlib.crc32(str(i).encode()) % 10]
    log_p = tree_brute([b" ".join(rows[i]) for i in learn], ctw.DEPTH)
    counts = Counter(w for i in learn for w in rows[i])
    total, kinds = sum(counts.values()) + len(learn), len(counts) + 1
    for i, row in rows.items():
        padded = b"\xff" * ctw.DEPTH + b" ".join(row) + b"\xff"
        score = sum(log_p(padded[j - ctw.DEPTH:j], padded[j]) for j in range(ctw.DEPTH, len(padded)))
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (kinds + 1))) for c in [*(counts[w] for w in row), len(learn)])
        r = got[i]
        assert r["held_out"] == (i not in learn) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(row) + 1, sum(w in counts for w in row) + 1)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-7)


# Near-duplicates ------------------------------------------------------------


@pytest.mark.parametrize("leaf, node, part", [(40, 4096, 1024), (8, 24, 12)])
def test_near_duplicates_of_a_hot_group(spark, monkeypatch, leaf, node, part):
    """Copies, near copies and a passage that many share: components equal brute force, also if nodes must go down by joins."""
    for name, value in (("LEAF", leaf), ("NODE", node), ("FOREST_DOCS", part)):
        monkeypatch.setattr(chosen_path, name, value)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(260):
        kind = i % 4
        if kind == 0:
            own = list(base)
            for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 5, 7])):
                own[at] = word()
        elif kind == 1:
            own = passage + [word() for _ in range(rng.choice([14, 20, 30, 200]))]
        elif kind == 2:
            own = list(base)[:rng.randint(88, 120)]
        else:
            own = [word() for _ in range(rng.randint(0, 9))]
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in sets}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == find(i)) for i, r in got.items())


def test_dense_blocks_need_no_signature():
    """A pair above the threshold is linked whatever its signatures say; margins lose less than one link in ten million."""
    def side(rows):
        return pa.table({
            "rep": [r for r, _ in rows], "root": [r for r, _ in rows], "major": [1] * len(rows), "n_shingles": [len(s) for _, s in rows],
            "sig": pa.array([[r] * chosen_path.PLACES for r, _ in rows], pa.list_(pa.int32())),
            "found": pa.array([sorted(s) for _, s in rows], pa.list_(pa.int64())),
        })

    near, far, most = set(range(12, 112)), set(range(50, 150)), set(range(100))
    got = chosen_path.compared(side([(7, near), (9, far)]), side([(1, most), (7, near), (8, set(range(13, 113))), (9, far)]))
    assert sorted(zip(*got.to_pydict().values())) == [(7, 1), (7, 8)]
    lost = sum(math.comb(chosen_path.PLACES, k) * 0.75**k * 0.25 ** (chosen_path.PLACES - k) for k in range(chosen_path.AGREEING))
    assert lost < 1e-7


def test_rows_that_share_an_id(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, one), (5, two), (5, one), (9, two), (2, one), (None, one), (7, None)]
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, 0, True), (2, 2, True), (5, 2, False), (5, 2, False), (5, 2, False), (7, 7, True), (9, 2, False)
    ]


def test_one_row_of_a_group_stays(spark):
    """Rows repeated under one id, copies without id and near copies without id."""
    text = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    rows = [(3, text("a"), "s")] * 50 + [(3, text("a").upper(), "s"), (8, text("a"), "s"), (3, text("b"), "s")]
    rows += [(None, text("a"), "s")] * 20 + [(None, text("c"), "t")] * 30 + [(None, text("c", 39), "t")]
    rows += [(None, text("d"), "u"), (11, text("d", 39), "u"), (12, text("e"), "u"), (None, "", "v"), (None, "", "v"), (13, None, "v")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    got = chosen_path.keep(docs)
    assert got.dtypes == docs.dtypes
    named = Counter((r["doc_id"], (r["text"] or "").lower()) for r in got.collect() if r["doc_id"] is not None)
    unnamed = Counter(r["text"][:1] for r in got.collect() if r["doc_id"] is None)
    assert named == {(3, text("a")): 1, (3, text("b")): 1, (11, text("d", 39)): 1, (12, text("e")): 1, (13, ""): 1}
    assert unnamed == {"c": 1, "": 2}


def test_dense_blocks_give_spanning_links():
    """Of a block in which all are linked, as many links come out as join its components."""
    sets = [sorted({*range(100), 1000 + i}) for i in range(30)]
    rows = pa.table({
        "rep": range(30), "root": [i // 3 * 3 for i in range(30)], "major": [0] * 30, "found": pa.array(sets, pa.list_(pa.int64())),
    })
    links = list(zip(*chosen_path.compared(rows.slice(3), rows).to_pydict().values()))
    joined = {i: i // 3 * 3 for i in range(30)}
    for a, b in links:
        old, new = joined[a], joined[b]
        assert old != new
        joined = {i: new if r == old else r for i, r in joined.items()}
    assert len(links) == 9 and len(set(joined.values())) == 1


def test_links_contracted_in_pieces(monkeypatch):
    """Whatever a task holds at a time, its links span the same components, every node under a lesser one."""
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i + 1, i) for i in range(300, 360)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links[i:i + 20])], ["a", "b"]) for i in range(0, 210, 20)
    ]

    def parts(edges):
        group = {x: {x} for e in links for x in e}
        for a, b in edges:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
        return {frozenset(g) for g in group.values()}

    for held in (1 << 20, 50):
        monkeypatch.setattr(components, "HELD", held)
        got = [e for batch in components.contracted(iter(batches)) for e in zip(*batch.to_pydict().values())]
        assert all(a > b for a, b in got) and parts(got) == parts(links)
    assert list(components.contracted(iter([]))) == []


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)]
    edges += [(900, i) for i in range(901, 960)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(500):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


# Fingerprints ---------------------------------------------------------------


def test_fingerprints_against_single_texts(spark, docs, texts):
    rows = texts + [(50_000, texts[3][1]), (50_001, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r for r in chunks.fingerprints(frame).collect()}
    ordered = sorted(rows, reverse=True)
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        text, following = text or "", following or ""
        changed = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        own, other, after = (chunks.fingerprint(t.encode()) for t in (text, changed, following))
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == chunks.as_text(own) and r["edited_fingerprint"] == chunks.as_text(other)
        assert r["near_edited"] == chunks.containment(own, other) and r["near_next"] == chunks.containment(own, after)
    assert got[50_000]["fingerprint"] == got[texts[3][0]]["fingerprint"]


def test_fingerprints_of_a_hot_id(spark, monkeypatch):
    """A third of the rows without id and a third under one id: many tasks share them, and results stay the same."""
    rng = random.Random(12)
    text = lambda: " ".join("".join(rng.choices("abcdef", k=4)) for _ in range(rng.randint(0, 90)))
    rows = [(None, text()) for _ in range(100)] + [(40, text()) for _ in range(100)] + [(i, text()) for i in range(20, 70) for _ in range(2)]
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 4000)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(n for _, n in chunks.ranges(frame))[-2:] > [5, 5]
    least = {i: min(t for j, t in rows if j == i) for i in {i for i, _ in rows}}
    down = [*sorted((i for i in least if i is not None), reverse=True), None]
    below = dict(zip(down, down[1:] + down[:1]))
    expected = Counter()
    for i, t in rows:
        following = least[below[i]]
        own, after = chunks.fingerprint(t.encode()), chunks.fingerprint(following.encode())
        changed = chunks.edited(t, following).encode()
        expected[i, chunks.as_text(own), hashlib.sha256(changed).hexdigest(), chunks.containment(own, after)] += 1
    held = chunks.fingerprints(frame).withColumn("task", F.spark_partition_id()).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["edited_sha256"], r["near_next"]) for r in held) == expected
    assert max(Counter(r["task"] for r in held).values()) < 100


def test_chunks_resist_shifts():
    rng = random.Random(4)
    raw = bytes(rng.choices(b"abcdefghijklmnop ", k=1_300_000))
    sizes = np.diff([0, *chunks.boundaries(raw)])
    assert sizes.sum() == len(raw) and sizes[:-1].min() >= chunks.LEAST and sizes.max() <= chunks.MOST
    assert 40 < sizes.mean() < 110
    moved = chunks.fingerprint(raw[:500] + b"inserted" + raw[500:])
    assert chunks.containment(chunks.fingerprint(raw), moved) > 0.99


# Rules, mixing, n-grams -----------------------------------------------------


def test_ablations(spark, docs):
    entries = rules.ledger(docs)
    found = {(r["policy"], r["rule"]): r for r in rules.ablations(entries).collect()}
    failed = [r["failed"] for r in entries.collect()]
    for (policy, rule), r in found.items():
        bits, bit = rules.POLICIES[policy], rules.BITS[rule]
        assert r["kept"] == sum(f & bits == 0 for f in failed)
        assert r["rejected_by_rule"] == sum(f & bit != 0 for f in failed)
        assert r["kept_without_rule"] == sum(f & bits & ~bit == 0 for f in failed)
    assert len(found) == sum(bin(bits).count("1") for bits in rules.POLICIES.values())


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("most")).collect():
        assert abs(r["n"] - r["t"]) <= r["most"]
    assert rows.where(F.col("taken") > 3 * F.col("size")).count() == 0


def test_mix_comes_near_its_targets_without_ids(spark):
    """A third of the ids null, and another third the same: rows are told apart by their texts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(
        F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit(7)).otherwise(F.col("doc_id")).alias("doc_id"), "text", "source"
    ).distinct()
    sized, limit = mixing.plan(docs)
    own = limit.withColumnRenamed("source", "own")
    rows = sized.join(own, sized["source"].eqNullSafe(own["own"])).withColumn(
        "taken", F.col("size") * (F.col("copies") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)))
    found = rows.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("most")).collect()
    assert len(found) > 3 and all(abs(r["n"] - r["t"]) <= r["most"] for r in found)


def test_mixed_rows_are_as_many_as_taken(spark, docs):
    taken = mixing.mix(docs).where("size > 0").agg(F.sum(F.col("taken") / F.col("size"))).first()[0]
    assert mixing.mixed(docs).where(mixing.words(F.col("text")) > 0).count() == taken


def test_grams_do_not_cross_texts():
    found = [(k, o) for keys, owner in blocks([b"abcd", b"", b"xyz"], 3) for k, o in zip(keys.tolist(), owner.tolist())]
    assert found == [(0x616263, 0), (0x626364, 0), (0x78797A, 2)]
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 50_000))
    assert (Lookup(keys).rows(keys[::-1].copy()) == np.arange(len(keys))[::-1]).all()


def test_repeated_words_are_covered_once():
    assert rules.repeated_words("a b c a b c".split()) == 6
    assert rules.repeated_words("a a a a".split()) == 4
    assert rules.repeated_words("a b c d a b x a b c".split()) == 6
    assert rules.repeated_words(["a", "b"]) == 0
    assert all(c in SPACE for c in "\x0b\x0c")


def test_a_common_passage_ends_in_small_nodes():
    """Texts half alike are thinned out in a task: no dense node, few likely pairs; a near copy among them is found."""
    core, count = [f"core{i}" for i in range(64)], 900
    texts = [" ".join(core + [f"own{n}x{i}" for i in range(32)]) for n in range(count - 1)]
    texts.append(" ".join(core + [f"own0x{i}" for i in range(31)] + ["other"]))
    sets = [chosen_path.shingles(text) for text in texts]
    least = [chosen_path.signature(found) for found in sets]
    sig = [(x & np.uint32(255)).astype(np.uint8).tobytes() for x in least]
    seen, met = set(), 0
    for node in range(2):
        rows = pa.RecordBatch.from_pydict({
            "node": pa.array([node] * count, pa.int64()), "rep": pa.array(range(count), pa.int64()),
            "root": pa.array(range(count), pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "sig": sig,
        })
        for batch in chosen_path.open_pairs(iter([rows])):
            assert not any(batch["dense"].to_pylist())
            seen.update(zip(batch["a"].to_pylist(), batch["b"].to_pylist()))
            met += batch.num_rows
    assert (0, count - 1) in seen
    assert met < 0.4 * count * count / 2


def test_forest_of_near_copies_grows_with_them():
    """A node of near copies proposes fewer pairs than documents, over batch borders too."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:i % 40] + [f"n{i}"] + words[i % 40 + 1:]) for i in range(300)]
    sets = [chosen_path.shingles(text) for text in texts]
    rows = pa.table({
        "node": pa.array([7] * 300 + [8] * 300, pa.int64()), "rep": pa.array([*range(300)] * 2, pa.int64()),
        "root": pa.array([*range(300)] * 2, pa.int64()), "n_shingles": pa.array([len(s) for s in sets] * 2, pa.int64()),
        "sig": [(chosen_path.signature(s) & np.uint32(255)).astype(np.uint8).tobytes() for s in sets] * 2,
    })
    whole = [b.to_pydict() for b in chosen_path.forests(iter(rows.to_batches(max_chunksize=600)))]
    cut = [b.to_pydict() for b in chosen_path.forests(iter(rows.to_batches(max_chunksize=37)))]
    assert whole == cut
    linked = {}
    for part in whole:
        for a, b in zip(part["a"], part["b"]):
            linked.setdefault(b, a)
    assert len({(a, b) for p in whole[:1] for a, b in zip(p["a"], p["b"])}) <= 16 * 300
    assert len(linked) >= 299
