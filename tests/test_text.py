import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from chronolith.functions import Fold, containment, edit_distance, grams, jaccard, key_length, normalize
from chronolith.functions.text import DOUBLE, PAD, SINGLE


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(("raw", "folded"), [("José", "jose"), ("Łódź", "lodz"), ("Straße", "strasse"), ("Æon", "aeon"), ("  Ada   Lovelace ", "ada lovelace"), ("a  b c", "a b c"), ("", ""), (" \t", ""), ("Œuvre ĳ", "oeuvre ij"), ("Привет", "привет")])
def test_normalize(spark, raw, folded):
    assert one(spark, normalize(F.col("a"), Fold.LATIN), a=raw) == folded


def test_no_fold_keeps_marks(spark):
    assert one(spark, normalize(F.col("a"), Fold.NONE), a="José  X") == "josé x"


def test_fold_table_covers_lower_case_latin():
    letters = [chr(c) for c in range(0xDF, 0x180) if unicodedata.category(chr(c)) == "Ll"]
    assert [x for x in letters if x not in SINGLE and x not in DOUBLE] == []


def test_grams(spark):
    assert one(spark, grams(F.col("a"), 3), a="") == [PAD * 3]
    assert one(spark, grams(F.col("a"), 2), a="aaa") == [PAD + "a", "aa", "a" + PAD]
    assert one(spark, grams(F.col("a"), 1), a="aba") == ["a", "b"]
    assert one(spark, key_length(F.col("a")), a="x" * 300) == 255


def test_measures_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
    pairs = [(word(), word(), rng.randint(0, 5)) for _ in range(1500)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def gram_set(t):
        p = PAD * 2 + t + PAD * 2
        return {p[i : i + 3] for i in range(len(t) + 2)} if t else {PAD * 3}

    frame = spark.createDataFrame(pairs, "a string, b string, k int")
    got = frame.select("a", "b", "k", *[edit_distance(F.col("a"), F.col("b"), k).alias(f"d{k}") for k in range(6)], jaccard(grams(F.col("a")), grams(F.col("b"))).alias("j"), containment(grams(F.col("a")), grams(F.col("b"))).alias("c")).collect()
    for r in got:
        d, x, y = edits(r["a"], r["b"]), gram_set(r["a"]), gram_set(r["b"])
        assert [r[f"d{k}"] for k in range(6)] == [d if d <= k else None for k in range(6)]
        assert r["j"] == pytest.approx(len(x & y) / len(x | y)) and r["c"] == pytest.approx(len(x & y) / len(x))
