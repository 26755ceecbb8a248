from pyspark.sql import functions as F

from paywarden.functions import money as mn, text as tx


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalise_examples(spark):
    values = [" AB-12 / ç ", "straße", "ﬁ é", "Ⅷ-½", None, "Ñandú", "𝐀𝟏", "日本 7", "N.U"]
    expected = ["AB12C", "STRASSE", "FIE", "VIII12", "", "NANDU", "A1", "7", "NU"]
    assert column(spark, values, tx.normalise) == expected
    assert [tx.plain_identifier(v) for v in values] == expected


def test_normalise_agrees_with_decomposition_for_every_character(spark):
    chars = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(f"a{c}1", tx.plain_identifier(f"a{c}1")) for c in chars], "v string, x string")
    assert rows.where(tx.normalise(F.col("v")) != F.col("x")).count() == 0


def test_sanitise(spark):
    values = ["L\x1eYLY", "a\x00\x01b", "x" * 32772, "tab\tline\n", "￾!"]
    result = column(spark, values, tx.sanitise)
    assert result[0] == "L YLY" and result[1] == "a b" and len(result[2]) == 32772
    assert result[3] == "tab\tline\n" and result[4] == " !"


def test_full_name_and_spread_key(spark):
    rows = spark.createDataFrame([("A", ""), ("", "B"), ("A", "B"), (None, None)], "l string, f string")
    assert [r[0] for r in rows.select(tx.full_name(F.col("l"), F.col("f"))).collect()] == ["A", "B", "A B", ""]
    keys = spark.createDataFrame([("", "1"), ("NU", "2"), ("K", "3")], "k string, line string")
    spread = keys.select(tx.spread_key(F.col("k"), tx.usable_id(F.col("k")), F.col("line")))
    assert [r[0] for r in spread.collect()] == ["~1", "~2", "K"]


def test_parse_money(spark):
    values = ["12.345", "1e3", "1 234,5", "abc", None, " 7 ", "-3"]
    assert [str(v) for v in column(spark, values, mn.parse_money)] == ["12.35", "1000.00", "0.00", "0.00", "0.00", "7.00", "-3.00"]
