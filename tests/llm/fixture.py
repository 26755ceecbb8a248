"""A small folder of tables with every odd case, and how results are compared."""

from __future__ import annotations

import datetime
import decimal
import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

TABLES = "documents labels pages conversations benchmark".split()


def words(rng: random.Random, n: int) -> list[str]:
    syllables = "the an ou re ti on es Er éa ch !! ## |".split()
    return ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)]


def documents(rng: random.Random) -> list[dict]:
    base = words(rng, 400)
    texts: list[str | None] = [None, "", " \n\t ", "one", "a b c d", "A B C D", "one two three four five", "\x1c odd space \x85 x"]
    texts += ["same text of a copy " * 3] * 5
    for cut in (0, 3, 6, 40, 60, 90, 150):  # near copies on both sides of the threshold
        changed = list(base)
        for at in range(cut):
            changed[at * 2] = f"x{cut}y{at}"
        texts.append(" ".join(changed))
    texts += [" ".join(words(rng, rng.randint(1, 300))) for _ in range(40)]
    texts += ["\n".join(["a line that repeats itself here"] * 9 + words(rng, 60)), " ".join(words(rng, 6000)), "漢字 😀 " * 70, "ab" * 5000]
    sources = [None, "a", "b", "c", "d", "ä"]
    rows = [{"doc_id": 3 * i + 7, "text": t, "lang": rng.choice(["en", "de", None]), "source": rng.choice(sources)} for i, t in enumerate(texts)]
    # Columns that operators use as names of their own.
    extra = {"row": "x", "size": 1.5, "chunk": -1, "n": 2, "target": "t", "gram": None, "failed": 0, "n_chars": 5, "hash": 1, "own": "z"}
    return [r | extra for r in rows]


def pages() -> list[dict]:
    tricky = "<p>WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n</p>\r\n\r\n"
    html = [None, "", "", tricky, tricky, "<p>é漢😀</p>", "<p>é漢😀</p>", "x", "\r\n\r\n", "long " * 5000]
    return [{"page_id": 5 * i, "url": [None, "http://a.example/ b", "http://ä.example/\r\nX: y"][i % 3], "html": h, "digest": "d", "row_no": 0}
            for i, h in enumerate(html)]


def conversations(rng: random.Random) -> list[dict]:
    rows = []
    talk = [("user", "hi"), ("assistant", None), (None, "go on"), ("assistant", "yes"), ("user", "")]
    for conv, upto in enumerate([1, 2, 5, 5, 3, 4]):
        rows += [{"conv_id": conv, "turn": t, "role": r, "text": x} for t, (r, x) in enumerate(talk[:upto])]
    rows += [{"conv_id": 20, "turn": t, "role": "user", "text": f"t{t}"} for t in range(1500)]
    rows += [{"conv_id": 21, "turn": t, "role": "user", "text": f"t{t}"} for t in range(700)]
    rows += [{"conv_id": 22, "turn": t, "role": "user", "text": f"t{t}" if t != 600 else "other"} for t in range(700)]
    rows += [{"conv_id": 23, "turn": 0, "role": "user", "text": x} for x in ("tie b", "tie a", "tie a")]
    rows += [{"conv_id": 24, "turn": None, "role": "user", "text": "no number"}, {"conv_id": 24, "turn": 4, "role": "user", "text": "four"}]
    rng.shuffle(rows)
    return [r | {"slice": "s", "mark": 0, "a": 1} for r in rows]


def labels(docs: list[dict]) -> list[dict]:
    return [{"doc_id": d["doc_id"], "quality": [1, 0, None, 1][i % 4], "toxic": [0, 1, None][i % 3], "text": "clash"} for i, d in enumerate(docs)]


def benchmark(docs: list[dict]) -> list[dict]:
    """Items from the documents: equal texts, equal ids, no id, no text, no terms."""
    texts = [d["text"] for d in docs[3:40:4]] + ["the same words the same", "the same words the same", "THE same", None, "", "! ?", "漢字 漢字"]
    ids = [*range(len(texts) - 2), None, 4]
    return [{"item_id": i, "text": t, "term": "x", "n": 1, "rank": 0, "score": 0.5} for i, t in zip(ids, texts)]


LAYOUT = {
    "benchmark": [("item_id", pa.int64()), ("text", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("rank", pa.int64()),
                  ("score", pa.float64())],
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("row", pa.string()),
                  ("size", pa.float64()), ("chunk", pa.int32()), ("n", pa.int64()), ("target", pa.string()), ("gram", pa.string()),
                  ("failed", pa.int64()), ("n_chars", pa.int64()), ("hash", pa.int64()), ("own", pa.string())],
    "labels": [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32()), ("text", pa.string())],
    "pages": [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("digest", pa.string()), ("row_no", pa.int64())],
    "conversations": [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("slice", pa.string()),
                      ("mark", pa.int64()), ("a", pa.int64())],
}


def write(folder: Path, empty: bool = False) -> str:
    rng = random.Random(5)
    docs = documents(rng)
    rows = {"documents": docs, "labels": labels(docs), "pages": pages(), "conversations": conversations(rng),
            "benchmark": benchmark(docs)}
    for name in TABLES:
        table = pa.Table.from_pylist([] if empty else rows[name], schema=pa.schema(LAYOUT[name]))
        pq.write_table(table, folder / f"{name}.parquet", row_group_size=20)
    return str(folder)


def plain(value):
    if isinstance(value, decimal.Decimal):
        return str(value.normalize() + 0)
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def comparable(rows) -> list[tuple]:
    return sorted(tuple(plain(v) for v in row) for row in rows)


def expected(folder: str, sql: str, columns: list[str]) -> list[tuple]:
    with duckdb.connect() as connection:
        for name in TABLES:
            connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
        result = connection.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(columns)
        return comparable([row[names.index(c)] for c in columns] for row in result.fetchall())
