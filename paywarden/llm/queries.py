"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from paywarden.llm import chat, chosen_path, chunks, ctw, kneser_ney, mixing, resampling, rules, search, sentencepiece, token_counts, toxicity, warc
from paywarden.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

#: Tokens that a text may have before it is over the limit of op12.
CONTEXT = 4096


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece.encoded(table(spark, folder, "documents"), corpus_pipeline.TOKENIZER)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id"), 5))
    model = toxicity.fit(docs, labels)
    return toxicity.scored(docs, model).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", "predicted")


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, folder, "documents"))


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.fingerprints(table(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    entries = rules.verdicts(rules.ledger(table(spark, folder, "documents")))
    base = rules.mask(*rules.BASE)
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.passes(F.col("failed"), base)).alias("base_failed"), "kept", "failed",
    )


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.chats(table(spark, folder, "conversations"))


def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return ctw.scored(table(spark, folder, "documents"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counted(table(spark, folder, "documents"), corpus_pipeline.TOKENIZER, CONTEXT)


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_toxicity": op2_toxicity,
        "op3_warc": op3_warc,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_fingerprints": op6_fingerprints,
        "op7_quality_rules": op7_quality_rules,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_source_mixing": op9_source_mixing,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_lexical_search": op11_lexical_search,
        "op12_token_counts": op12_token_counts,
        "op13_importance_resampling": op13_importance_resampling,
        "pipeline": corpus_pipeline.run,
    }


#: RFC 4648 base32 of a SHA-1, letter by letter from its hexadecimal digits.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
top AS (SELECT payload, max(page_id) AS top FROM p GROUP BY payload)
SELECT page_id, cast(strlen(payload) AS bigint) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(((cast('0x' || substr(h || '0', cast((5 * i) // 4 + 1 AS bigint), 2) AS integer) >> cast(3 - (5 * i) % 4 AS integer)) & 31) + 1 AS bigint), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN top USING (payload)
"""

RULES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i:i + 2] AS tri FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM win) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, cast(len(ws) AS bigint) AS n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS bigint) AS word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
  FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN cover USING (r)),
f AS (SELECT *, cast({" + ".join(f"CASE WHEN {rule.fails} THEN {1 << place} ELSE 0 END" for place, rule in enumerate(rules.RULES))}
  AS bigint) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed & {rules.mask(*rules.BASE)} <> 0 AS base_failed, failed & {rules.POLICIES[rules.CURRENT]} = 0 AS kept, failed
FROM f
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT doc_id, cast(coalesce(n, 0) AS bigint) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
  doc_id <= coalesce(low, doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
"""

CHAT_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, {chat.NO_TURN}) AS turn, coalesce(role, 'unknown') AS role,
    coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list([turn::varchar, role, text] ORDER BY turn, role, text) AS turns, list(turn ORDER BY turn) AS ks,
    count(*) AS n_turns FROM t GROUP BY conv_id),
inner_part AS (SELECT DISTINCT turns[1:i] AS turns FROM
  (SELECT turns, ks, unnest(range(1, len(turns))) AS i FROM c) WHERE ks[i] <> ks[i + 1]),
u AS (SELECT min(conv_id) AS conv_id, turns, max(n_turns) AS n_turns, count(*) AS n_copies FROM c GROUP BY turns),
k AS (SELECT * FROM u ANTI JOIN inner_part USING (turns)),
parts AS (SELECT conv_id, turn // {chat.SLICE} AS slice, n_turns, n_copies,
    string_agg('{chat.OPEN}' || role || chr(10) || text || '{chat.CLOSE}' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM t JOIN k USING (conv_id) GROUP BY ALL)
SELECT conv_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY slice) - 1 AS integer) AS part, n_turns, n_copies, rendered
FROM parts
"""

MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS bigint) AS size,
    cast('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '') || ':' || md5(coalesce(text, ''))), 1, 9) AS bigint) AS h FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size,
    ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap,
    sum(3 * source_size) OVER up AS caps, sum(w) OVER up AS ws, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    row_number() OVER up AS place
  FROM s WINDOW up AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT rest, open_w FROM (
    SELECT 0 AS place, any_value(total) AS rest, any_value(all_w) AS open_w FROM o
    UNION ALL SELECT place, total - caps, all_w - ws FROM o) x
  WHERE open_w > 0 AND rest <= coalesce((SELECT o.cap * open_w / o.w FROM o WHERE o.place = x.place + 1), rest)
  ORDER BY place LIMIT 1),
g AS (SELECT source, source_size, least(cast(rest AS double) * w / cast(open_w AS double), cast(cap AS double)) AS target FROM o, level),
b AS (SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS bigint) ELSE 0 END AS copies FROM g),
groups AS (SELECT source, h, sum(size) AS n FROM d GROUP BY ALL),
ends AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS e FROM groups),
taken AS (SELECT ends.source, ends.h FROM ends JOIN b ON ends.source IS NOT DISTINCT FROM b.source
  WHERE 2 * (e - n) + n <= 2 * (target - copies * source_size))
SELECT doc_id, size, source_size, target,
  cast(size * (copies + CASE WHEN taken.h IS NULL THEN 0 ELSE 1 END) AS bigint) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN taken ON taken.source IS NOT DISTINCT FROM d.source AND taken.h = d.h
"""


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{TERM}') AS ws FROM documents),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, cast(coalesce(sum(len(ws)), 0) AS bigint) AS n_terms FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
t AS (SELECT term, cast(floor(1000 * ln(cast(2 * any_value(n_docs) + 2 AS double) / (2 * count(*) + 1))) AS bigint) AS w FROM p, s GROUP BY term),
a AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ws) * n_docs) // n_terms))) AS part
  FROM p JOIN t USING (term) JOIN d USING (r), s),
o AS (SELECT item_id, r, cast(sum(k * part) AS bigint) AS score FROM q JOIN a USING (term) GROUP BY ALL)
SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS integer) AS rank, doc_id, score
FROM o JOIN d USING (r) WHERE score > 0
QUALIFY rank <= 20
"""

#: CRC-32 byte by byte, its table of remainders by the rule of the reversed polynomial.
CRC_TABLE = (
    "list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), "
    "lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))"
)
RESAMPLE_SQL = f"""
WITH tab AS MATERIALIZED (SELECT {CRC_TABLE} AS remainders),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{TERM}') AS ws FROM documents),
b AS (SELECT regexp_extract_all({LOWER}, '{TERM}') AS ws FROM benchmark),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(ws) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM b) GROUP BY ALL),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
crc AS (SELECT word, xor(4294967295, list_reduce(list_concat([4294967295],
    list_transform(range(1, len(h), 2), lambda i: cast('0x' || substr(h, i, 2) AS bigint))),
    lambda c, x: xor(c >> 8, remainders[xor(c & 255, x) + 1]))) % 10000 AS bucket FROM words, tab),
own AS (SELECT bucket, sum(n) AS s FROM dw JOIN crc USING (word) GROUP BY bucket),
tgt AS (SELECT bucket, sum(n) AS t FROM bw JOIN crc USING (word) GROUP BY bucket),
al AS (SELECT (SELECT coalesce(sum(n), 0) FROM dw) AS all_s, (SELECT coalesce(sum(n), 0) FROM bw) AS all_t),
gain AS (SELECT bucket, cast(floor(1000 * ln(cast((coalesce(t, 0) + 1) * (all_s + 10000) AS double)
    / cast((s + 1) * (all_t + 10000) AS double))) AS bigint) AS g FROM own LEFT JOIN tgt USING (bucket), al),
w AS (SELECT r, cast(floor(cast(sum(n * g) AS double) / cast(sum(n) AS double)) AS bigint) AS weight
  FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY r),
sc AS (SELECT r, doc_id, cast(len(ws) AS bigint) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast(cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id AS varchar), '')), 1, 8) AS bigint) AS double)
      + 0.5) / 4294967296))) AS bigint) AS score FROM d LEFT JOIN w USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM sc LEFT JOIN k USING (r)
"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "op3_warc": WARC_SQL, "op5_near_duplicates": NEAR_SQL, "op7_quality_rules": RULES_SQL, "op8_chat_formatting": CHAT_SQL,
        "op9_source_mixing": MIX_SQL, "op11_lexical_search": SEARCH_SQL, "op13_importance_resampling": RESAMPLE_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: text for name, text in sql.items() if text}
