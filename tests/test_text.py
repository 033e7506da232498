import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from kinfold.functions import keys as K
from kinfold.functions import text as X

NAMES = [
    ("Acme Widgets Inc.", "acme widgets inc", "acme widgets", "acme widgets", "acme widgets", ["acme", "widgets"]),
    ("Widgets, Acme & Co", "widgets acme and co", "widgets acme and", "acme widgets", "acme widgets", ["widgets", "acme"]),
    ("Tech Data Corp", "tech data corp", "data", "data", "data", ["data"]),
    ("Services Group International", "services group international", "", "", "", []),
    ("The A and An Ltd", "the a and an ltd", "the a and an", "a an and the", "", []),
    ("Straße ½ ﬁn", "strae 12 fin", "strae 12 fin", "12 fin strae", "12 strae", ["strae"]),
    ("Café Société S.A.", "cafe societe s a", "cafe societe s a", "cafe s societe", "cafe societe", ["cafe", "societe"]),
    ("AT＆T", "at and t", "at and t", "t", "t", []),
    ("日本", "", "", "", "", []),
    ("None", "", "", "", "", []),
    ("", "", "", "", "", []),
    (None, "", "", "", "", []),
    ("nan", "nan", "nan", "nan", "nan", []),
    ("Data Data Storage", "data data storage", "data data storage", "data data storage", "data data", ["data", "data", "storage"]),
]
ADDRESSES = [
    ("221B Baker St, London 90210", "221b baker st london 90210", "90210_221b", "90210", ["90210"]),
    ("12 Main Rd, 10001-2345", "12 main rd 10001 2345", "12_main", "10001_2345", ["12", "10001", "2345"]),
    ("Main Rd", "main rd", "", "", []),
    ("12", "12", "", "", ["12"]),
    ("Suite_7 The Mall", "suite 7 the mall", "7_suite", "", []),
    ("None", "", "", "", []),
    ("none", "none", "", "", []),
    ("12² ３４ 1_2 7-8", "122 34 1 2 7 8", "", "122", ["３４", "7", "8"]),
    (None, "", "", "", []),
]


def test_names(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(NAMES)], "i int, x string")
    norm = X.normal_name(F.col("x"))
    t = X.tokens(norm)
    rows = df.select("i", X.normal_text(F.col("x")), norm, K.sorted_key(t), K.first_two_key(t), K.core_tokens(t)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == [r[1:] for r in NAMES]


def test_addresses(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ADDRESSES)], "i int, x string")
    norm = X.normal_text(F.col("x"))
    t = X.tokens(norm)
    rows = df.select("i", norm, K.number_street_key(t), K.zip_number_key(t), X.numbers(F.col("x"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == [r[1:] for r in ADDRESSES]


def test_address_words(spark):
    df = spark.createDataFrame([("5 Oak St., Apt 3, PO Box 9 NO. 4 first",)], "x string")
    assert df.select(X.normal_address(F.col("x"))).first()[0] == "5 oak street apartment 3 pobox 9 number 4 first"


def test_fold_is_nfkd_without_what_is_not_ascii(spark):
    rng = random.Random(3)
    pool = [chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000]
    some = ["".join(rng.choice(pool if rng.random() < 0.3 else pool[:0x500]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    want = [unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode() for x in some]
    got = spark.createDataFrame(list(enumerate(some)), "i int, x string").select("i", X.ascii_fold(F.col("x"))).orderBy("i").collect()
    assert [r[1] for r in got] == want


@pytest.mark.parametrize("text", ["a b", " a b c ", "a\x1cb\x1d", "", "　", "x\n\ty"])
def test_raw_words_split_at_unicode_space(spark, text):
    assert spark.createDataFrame([(text,)], "x string").select(X.raw_word_count(F.col("x"))).first()[0] == len(text.split())


def test_numbers_match_word_boundaries(spark):
    rng = random.Random(5)
    some = ["".join(rng.choice("12 aé_-²３́½,") for _ in range(rng.randint(0, 15))) for _ in range(600)]
    got = spark.createDataFrame(list(enumerate(some)), "i int, x string").select("i", X.numbers(F.col("x"))).orderBy("i").collect()
    assert [r[1] for r in got] == [re.findall(r"\b\d+\b", x) for x in some]
