import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill.functions import accents, chars, text
from quillmill.plans import queries


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(*columns).first()


CASES = [
    ("don't", ["don", "'", "t"]), ("a b", ["a", "b"]), ("a​b", ["ab"]), ("a b", ["ab"]), ("a\u007fb", ["ab"]), ("a﻿b", ["a﻿b"]), ("a�b\x00", ["ab"]),
    ("中文ab", ["中", "文", "ab"]), ("\U00020000x", ["\U00020000", "x"]), ("Ａb", ["ａ", "b"]), ("¿Qué?", ["¿que", "?"]), ("a·b", ["a", "·", "b"]), ("ÄÖÜß", ["aouß"]), ("Øre", ["øre"]), ("ẞ", ["ß"]), ("İ", ["i"]),
    ("ΣΑΣ", ["σασ"]), ("a≠b", ["a", "=", "b"]), ("한", ["한"]), ("가힣", ["가힣"]), ("[CLS] x", ["[", "cls", "]", "x"]), ("", []), ("  \t\n ", []), ("́", []),
    ("Café naïve façade coöperate résumé überstraße", "cafe naive facade cooperate resume uberstraße".split()), ("Hello, 世界!", ["hello", ",", "世", "界", "!"]),
    ("This is, a small: ASCII-only sentence with punctuation!!!", ["this", "is", ",", "a", "small", ":", "ascii", "-", "only", "sentence", "with", "punctuation", "!", "!", "!"]),
    ("\U00010400", ["\U00010428"]), ("\U00010570", ["\U00010570"]), ("\U0001d15e", ["\U0001d157\U0001d165"]),
]


def test_basic_tokenize(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(-1, None)], "i int, t string")
    got = {r["i"]: r["w"] for r in rows.select("i", text.basic_tokenize(F.col("t")).alias("w")).collect()}
    assert got[-1] is None
    for i, (t, want) in enumerate(CASES):
        assert got[i] == want, t


def test_options(spark):
    assert one(spark, "中文ab", text.basic_tokenize(F.col("t"), tokenize_chinese_chars=False))[0] == ["中文ab"]
    assert one(spark, "ÄÖÜß", text.basic_tokenize(F.col("t"), do_lower_case=False))[0] == ["ÄÖÜß"]
    assert one(spark, "a b\tc\r\nd", text.whitespace_tokenize(F.col("t")))[0] == ["a", "b", "c", "d"]
    assert one(spark, "AÄZ", text.ascii_lower(F.col("t")))[0] == "aÄz"
    assert one(spark, b"a\xffb", text.clean_text(chars.valid_utf8(F.col("t"))), kind="binary")[0] == "ab"


def test_fold_table(spark):
    """translate() and the rest agree with the rule for every code point that has one."""
    every = [chr(c) for c in range(1, 0x1F000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([("x" + c + "y",) for c in every], "t string")
    got = [r[0] for r in rows.select(text.lower_strip(F.col("t"))).collect()]
    wrong = [hex(ord(c)) for c, g in zip(every, got) if g != "x" + accents.fold_char(c) + "y"]
    assert wrong == []


def test_fold_rule():
    for c in "ÀÉÎõü":
        assert accents.fold_char(c) == unicodedata.normalize("NFD", c)[0].lower()
    assert accents.fold_char("ೀ") == "ೕ" and accents.fold_char("ୈ") == "େ"


@pytest.mark.parametrize(
    "name, inside, outside",
    [
        ("is_punctuation", "!/:@[`{~·‐⁯、〿！ｱ｠︰⺀・", "a1 ¡¿«»§¶é中"),
        ("is_control", "\x01\x1f\x7f\x9f​‏‪⁤", "\t\n\r ﻿­a"),
        ("is_whitespace", "\t\n\r      　", "a​ \x0b"),
        ("is_chinese", "一鿿㐀豈\U00020000\U0002f800", "あ가a〇"),
        ("is_dropped", "\x01�  ​", "\ta  "),
    ],
)
def test_classes(spark, name, inside, outside):
    f = getattr(chars, name)
    rows = spark.createDataFrame([(c, True) for c in inside] + [(c, False) for c in outside], "c string, want boolean")
    assert rows.where(f(F.col("c")) != F.col("want")).count() == 0


def test_predicates_count_empty_texts(spark, tmp_path):
    """An empty text is one row of code -1, as in the SQL; a null is none."""
    texts = [None, "", "", "a🐍a", "\x00 ", "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.char_predicates(spark, str(tmp_path)).collect()))
    assert [r[:2] for r in got] == [(-1, 2), (0, 1), (10, 1), (32, 1), (97, 2), (0x1F40D, 1)]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.sql(queries.oracle_sql()["char_predicates"]).fetchall())
