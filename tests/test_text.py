import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from textloom.functions import text as T

STEMS = {
    "running": "run", "studies": "study", "carefully": "care", "management": "manage", "darkness": "dark", "cats": "cat", "glass": "glass", "king": "king", "bed": "bed", "updated": "updat",
    "cares": "car", "is": "is", "be": "be", "surprisingly": "surpri", "singly": "singly", "agreeing": "agre", "seeing": "se", "falling": "fall", "passing": "pass", "hopping": "hop", "hoped": "hop",
    "dies": "die", "ties": "tie", "goes": "goe", "classes": "class", "glasses": "glass", "less": "less", "buses": "bus", "gas": "gas", "carelessness": "careless", "helpfulness": "helpful",
    "movements": "movement", "moment": "mo", "thes": "the", "agreed": "agre", "needed": "need", "beautifully": "beauti", "cheerful": "cheer", "awful": "awful", "spring": "spr", "string": "str",
    "bring": "bring", "speed": "spe", "red": "red", "2024s": "2024",
}


def test_stem_vectors(spark):
    df = spark.createDataFrame(list(STEMS.items()), "token string, want string").withColumn("got", T.stem(F.col("token")))
    assert df.where("got <> want").collect() == []
    assert {w: T.stem_py(w) for w in STEMS} == STEMS


def direct(w):
    """The suffix rules one by one, as a check of the expressions."""
    cut = None
    for suffix, least in (("ingly", 6), ("ing", 5), ("ed", 4)):
        if w.endswith(suffix) and len(w) > least:
            cut = w[: -len(suffix)]
            break
    if cut is not None:
        w = cut[:-1] if len(cut) > 1 and cut[-1] == cut[-2] and cut[-1] not in "sl" else cut
    for group in ((("fully", 6), ("ful", 5)), (("ness", 5),), (("ment", 5),)):
        for suffix, least in group:
            if w.endswith(suffix) and len(w) > least:
                w = w[: -len(suffix)]
                break
    if w.endswith("ies") and len(w) > 4:
        return w[:-3] + "y"
    if w.endswith("es") and len(w) > 4:
        return w[:-2]
    if w.endswith("s") and not w.endswith("ss") and len(w) > 3:
        return w[:-1]
    return w


@settings(max_examples=2000, deadline=None)
@given(st.text("abelsngi2", min_size=2, max_size=4), st.lists(st.sampled_from(["ing", "ingly", "ed", "ful", "fully", "ness", "ment", "s", "es", "ies", "ss"]), max_size=3))
def test_stem_matches_rules(stem, suffixes):
    word = stem + "".join(suffixes)
    assert T.stem_py(word) == direct(word)


@pytest.mark.parametrize(
    "text,want",
    [("The Quick Brown Fox", ["quick", "brown", "fox"]), ("C++ programming in 2024!", ["program", "2024"]), ("inverted index", ["invert", "index"]), ("longer text to check how sckres are behaving", ["longer", "text", "check", "sckr", "behav"]),
     ("cafés Kelvin", ["caf", "elvin"]), ("", []), ("a i", [])],
)
def test_tokens(spark, text, want):
    assert T.tokenize_py(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t"))).first()[0] == want


def test_null_text(spark):
    assert spark.createDataFrame([(None,)], "t string").select(T.tokens(F.col("t"))).first()[0] is None


def test_stop_words():
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS)) == 97
