"""Ranked search, token counts and importance resampling against plain definitions, on odd, repeated and very long texts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from math import floor, log
from zlib import crc32

import pyarrow as pa
import pytest

import public_tokenizers
from paywarden.llm import resampling, search, terms, token_counts

DOCS = "doc_id bigint, text string, n string, rank bigint"
ITEMS = "item_id bigint, text string, terms string"
NOT_A_TERM = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text: str | None) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in NOT_A_TERM.split(lowered) if w]


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    rng = random.Random(3)
    base = ["the", "of", "AND", "zu", "é", "漢字", "x1", "rare", "Ünit", "two-part"] + [f"w{i}" for i in range(60)]
    made = [" ".join(rng.choices(base, k=rng.randint(1, 80))) for _ in range(150)]
    made += [" ".join(base[:4] * 30)] * 40  # a group of copies
    return [None, "", " .!\n", "the", *made, "the of " * 20_000]


def rows(texts, step=3):
    """Documents with repeated and missing ids."""
    return [(None if i % 11 == 0 else i // 2 * step, t, "x", 7) for i, t in enumerate(texts)]


# --- ranked search --------------------------------------------------------------------------------------------------


def brute_search(docs, items, most):
    counts = [Counter(plain_terms(t)) for _, t, *_ in docs]
    n, size = sum(1 for c in counts if c), sum(c.total() for c in counts)
    frequency = Counter(term for c in counts for term in c)
    weight = {t: floor(1000 * log((2 * n + 2) / (2 * df + 1))) for t, df in frequency.items()}
    wanted = defaultdict(Counter)
    for item, text, *_ in items:
        wanted[item].update(plain_terms(text))
    out = []
    for item, own in wanted.items():
        found = []
        for (doc_id, *_), c in zip(docs, counts):
            m = 75 + (25 * c.total() * n) // size
            score = sum(k * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in own.items() if t in c)
            if score:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:most], 1)]
    return out


def in_order(found):
    return sorted(map(tuple, found), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def item_rows():
    texts = ["the of zu", "the of zu rare rare", "the of w1 w2", "w1 w2 w3", None, "", "..", "none_of_these_known ?", "é 漢字 THE", "two-part"]
    return [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)] + [(1, "extra w9", "x"), (1, "extra w9", "x")]


@pytest.mark.parametrize("most", [1, 7, 500])
def test_search_equals_the_definition(spark, texts, most):
    docs, items = rows(texts), item_rows()
    got = search.ranked(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert in_order(got.collect()) == in_order(brute_search(docs, items, most))


def test_search_by_groups_of_items_and_small_blocks(spark, texts, monkeypatch):
    monkeypatch.setattr(search, "GROUP", 40)
    monkeypatch.setattr(search, "CELLS", 100)
    monkeypatch.setattr(terms, "BLOCK", 64)
    docs, items = rows(texts), item_rows()
    got = search.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 5)
    assert in_order(got.collect()) == in_order(brute_search(docs, items, 5))


def test_shared_parts_exist_once(spark):
    shared = " ".join(f"s{i}" for i in range(30))
    items = [(i, f"{shared} all own{i}", "x") for i in range(40)] + [(40 + i, f"all own{i}", "x") for i in range(40)]
    graph = search.mined(spark.createDataFrame(items, ITEMS))
    assert graph.atoms == 42  # the 30 shared terms, the one of all items, and one of each pair of items
    assert [len(parent) for parent, _, _ in graph.levels] == [1, 41, 40]
    assert sorted(graph.items) == list(range(80))


def test_search_without_rows(spark, texts):
    docs, items = spark.createDataFrame(rows(texts), DOCS), spark.createDataFrame(item_rows(), ITEMS)
    assert search.ranked(docs, items.limit(0)).count() == search.ranked(docs.limit(0), items).count() == 0


# --- token counts ---------------------------------------------------------------------------------------------------


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(own.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


def awkward() -> list[str]:
    rng = random.Random(8)
    parts = [" ", "  ", "   ", "\n", "\t", "a", "the", "ing", "▁", "漢", "字", "😀", "é", "é", "\x00", "　", "<s>", "</s>", "<unk>",
             "<0x41>", "<|endoftext|>", "1234", "!!", "Zürich", "'s", "ﬁ", "\r\n", "​", "  the"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(400)] + [" ", "  ", "x" * 3000, "漢" * 3000, " " * 999]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("part", [1, 2, 3, 7, 50])
def test_cuts_leave_the_count_as_it_is(name, part):
    path, count = public_tokenizers.path(name), library(name)
    own = token_counts.counter(open(path, "rb").read(), name[name.rindex("."):])
    given = awkward()
    got = token_counts.lengths(pa.array(given), own, part=part, batch=200).tolist()
    assert got == [count(t) for t in given]


def test_long_texts_are_cut_and_others_are_whole(spark):
    own = token_counts.counter(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read(), ".model")
    words = "many words of a long text " * 20_000
    assert max(len(p) for p, _ in token_counts.parts_of(words, own, 1000)) < 1100
    assert max(len(p) for p, _ in token_counts.parts_of("漢字" * 9000, own, 1000)) < 1100
    assert [p for p, _ in token_counts.parts_of("a" * 9000, own, 1000)] == ["a" * 9000]


def test_token_counts_of_rows(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    count = library("piece_bpe_32k.model")
    docs = rows([*texts, *awkward()])
    got = token_counts.counted(spark.createDataFrame(docs, DOCS), path, 30).collect()
    assert sorted(map(str, got)) == sorted(
        str(got[0].__class__(doc_id=i, n_bytes=len((t or "").encode()), n_tokens=count(t or ""), over_limit=count(t or "") > 30)) for i, t, *_ in docs
    )
    with pytest.raises(ValueError):
        token_counts.token_counter(spark, "vocabulary.txt")


# --- importance resampling ------------------------------------------------------------------------------------------


def plain_features(text, shortest, longest):
    words = [w.encode() for w in plain_terms(text)]
    return [b" ".join(words[i:i + n]) for n in range(shortest, longest + 1) for i in range(len(words) + 1 - n)]


def brute_resampled(docs, target, shortest, longest, buckets, percent, least, seed):
    of = lambda text: [crc32(f) % buckets for f in plain_features(text, shortest, longest)]
    own, goal = Counter(b for _, t, *_ in docs for b in of(t)), Counter(b for _, t, *_ in target for b in of(t))
    gain = {b: floor(1000 * log((goal[b] + 1) * (own.total() + buckets) / ((own[b] + 1) * (goal.total() + buckets)))) for b in own}
    out = []
    for doc_id, text, *_ in docs:
        found = of(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + floor(-1000 * log(-log((h + 0.5) / 2**32))), len(plain_terms(text)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {id(r): rank for rank, r in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in out]


@pytest.mark.parametrize("shortest, longest, percent, least", [(1, 1, 10, 20), (1, 2, 50, 0), (2, 3, 100, 5), (1, 1, 1, 20), (1, 1, 10, 10**9)])
def test_resampling_equals_the_definition(spark, texts, monkeypatch, shortest, longest, percent, least):
    monkeypatch.setattr(terms, "BLOCK", 100)
    docs = rows(texts)
    target = [(i, t, "x", 7) for i, t in enumerate(texts[5:20])]
    got = resampling.resampled(
        spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(target, DOCS), shortest, longest, 50, percent, least, 9
    )
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    expected = brute_resampled(docs, target, shortest, longest, 50, percent, least, 9)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("wanted", [1, 2, 300, 301, 950, 999, 1000])
def test_the_bracket_is_widened_until_it_holds_the_cutoff(spark, monkeypatch, wanted):
    monkeypatch.setattr(resampling, "MARGIN", 1e-9)
    monkeypatch.setattr(resampling, "SKETCH", 8)
    scores = [5] * 300 + list(range(-650, 0)) + [7, 8] * 25
    rows = spark.createDataFrame([(s,) for s in scores], "score bigint").repartition(6)
    low, high, above = resampling.bracket(rows, wanted, len(scores))
    assert above == sum(s > high for s in scores) < wanted <= sum(s >= low for s in scores)


def test_equal_rows_at_the_cutoff_are_drawn_as_often_as_asked(spark):
    docs = spark.createDataFrame([(1, "word " * 30, "x", 7)] * 200, DOCS)
    ranks = [r["rank"] for r in resampling.resampled(docs, docs, percent=15).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 31)) and ranks.count(None) == 170
