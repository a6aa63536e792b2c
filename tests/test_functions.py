"""Worked examples of the text functions and the entry grammar."""

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import grammar, text, vectors


def on(spark, function, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "entry, names",
    [
        ("Caprylic/Capric Triglyceride", ["caprylic", "capric triglyceride"]),
        ("rosa canina flower/leaf extract", ["rosa canina flower extract", "rosa canina leaf extract"]),
        ("vp/va copolymer", ["vp va copolymer"]),
        ("x (lauryl/myristyl) ether", ["x lauryl ether", "x myristyl ether"]),
        ("aloe ferment filtrate", ["aloe ferment filtrate"]),
        ("aloe extract water", ["aloe extract", " water", ""]),
        ("titanium dioxide/silica nano", ["titanium dioxide", "silica nano"]),
        ("aqua", ["aqua"]),
        ("", [""]),
    ],
)
def test_expand(spark, entry, names):
    assert on(spark, grammar.expand, entry, "string") == names


@pytest.mark.parametrize(
    "tokens, merged",
    [
        (["sodium-", "chloride", "aqua"], ["sodiumchloride", "aqua"]),
        (["a-", "b-", "c"], ["ab-", "c"]),
        (["(sweet", "almond) oil"], ["(sweet almond) oil"]),
        (["(a", "(b)"], ["(a", "(b)"]),
        (["x-"], ["x-"]),
        ([], []),
    ],
)
def test_merge_pairs(spark, tokens, merged):
    assert on(spark, text.merge_pairs, tokens, "array<string>") == merged


@pytest.mark.parametrize("tokens, cleaned", [(["Ingredients: Aqua,", "Benzophenone-3,", "a b Öl"], "ingredients: aqua benzophenone3 öl"), ([], ""), (["..."], "")])
def test_clean_tokens(spark, tokens, cleaned):
    assert on(spark, text.clean_tokens, tokens, "array<string>") == cleaned


def test_strip_takes_all_white_space(spark):
    assert on(spark, text.strip, " \t a b\n ", "string") == "a b"


@pytest.mark.parametrize("path, stem, ending", [("/a/b.c/0083.v1.jpg", "0083.v1", "jpg"), ("x.png", "x", "png")])
def test_paths(spark, path, stem, ending):
    assert on(spark, text.stem, path, "string") == stem
    assert on(spark, lambda c: text.last_part(text.file_name(c), "."), path, "string") == ending


def test_to_bool(spark):
    assert on(spark, text.to_bool, "Yes", "string") is True
    assert on(spark, text.to_bool, "0", "string") is False
    with pytest.raises(Exception, match="not a boolean"):
        on(spark, text.to_bool, "maybe", "string")


def test_stars_leave_a_blank(spark):
    assert on(spark, text.without_stars, " Limonene *", "string") == "limonene "


def test_vectors(spark):
    assert on(spark, vectors.norm, [3.0, 4.0], "array<float>") == 5.0
    assert on(spark, vectors.normalised, [3.0, 4.0], "array<float>") == [0.6, 0.8]
    assert on(spark, vectors.normalised, [0.0, 0.0], "array<float>") == [0.0, 0.0]
