"""F-operators on the fixed emoji table (FIXTURES §2) and their properties."""

import pytest
from pyspark.sql import functions as F

from mojiframe.functions import text as TX
from mojiframe.operators.variants import add_notebook_variants, add_variants, text_column, variant_to_column

ZWJ, VS16, KEYCAP = "\u200d", "\ufe0f", "\u20e3"
FAMILY = "\U0001F468" + ZWJ + "\U0001F469" + ZWJ + "\U0001F467"
ROWS = [
    # input, x_emoji, has_emoji, x_text (F4+strip), text_only (F5), x_desc (F6+strip)
    ("Great job \U0001F644!", "\U0001F644", True, "Great job !", "Great job !",
     "Great job  face_with_rolling_eyes !"),
    ("\U0001F602\U0001F602 café", "\U0001F602\U0001F602", True, "café", "café",
     "face_with_tears_of_joy  face_with_tears_of_joy  café"),
    ("plain", "<NO_EMOJI>", False, "plain", "plain", "plain"),
    ("\u0020\u0020plain \u3000", "<NO_EMOJI>", False, "plain", "plain", "plain"),
    ("love ❤" + VS16, "❤", True, "love", "love " + VS16, "love  red_heart"),
    ("\U0001F44D\U0001F3FD", "\U0001F44D\U0001F3FD", True, "", "", "thumbs_up_medium_skin_tone"),
    (FAMILY, "\U0001F468\U0001F469\U0001F467", True, "", ZWJ + ZWJ, "family_man_woman_girl"),
    ("go \U0001F1EC\U0001F1E7", "<NO_EMOJI>", False, "go", "go \U0001F1EC\U0001F1E7", "go  United_Kingdom"),
    ("1" + VS16 + KEYCAP + " and 7", "<NO_EMOJI>", False, "and 7", "1" + VS16 + KEYCAP + " and 7",
     "keycap_1  and 7"),
    ("© 2024", "©", True, "2024", "2024", "copyright  2024"),
    (None, "<NO_EMOJI>", False, "nan", "nan", "nan"),
    ("", "<NO_EMOJI>", False, "", "", ""),
    ('he said "hi"\nthere', "<NO_EMOJI>", False, 'he said "hi"\nthere', 'he said "hi"\nthere',
     'he said "hi"\nthere'),
]


@pytest.fixture(scope="module")
def variants(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ROWS)], "id int, text string")
    return {r.id: r for r in add_notebook_variants(add_variants(df)).collect()}


@pytest.mark.parametrize("i", range(len(ROWS)))
def test_fixture_row(variants, i):
    _, x_emoji, flag, x_text, text_only, x_desc = ROWS[i]
    r = variants[i]
    assert r.x_emoji == x_emoji
    assert r.has_emoji is flag
    assert r.x_text == x_text
    assert r.text_only == text_only
    assert r.x_desc == x_desc
    assert r.x_full == ("nan" if ROWS[i][0] is None else ROWS[i][0])


def test_properties(spark):
    df = spark.createDataFrame([(r[0],) for r in ROWS if r[0] is not None], "t string")
    out = df.select(
        (TX.extract_emoji(TX.remove_emoji_sequences("t")) == "").alias("clean"),
        (TX.remove_emoji_sequences(TX.remove_emoji_sequences("t")) == TX.remove_emoji_sequences("t")).alias("idem"),
        (TX.has_emoji("t") == (TX.extract_emoji("t") != "")).alias("flag"),
    ).collect()
    assert all(r.clean and r.idem and r.flag for r in out)


def test_is_emoji_single_code_point(spark):
    df = spark.createDataFrame([("\U0001F644",), ("a",), ("\U0001F1EC",), ("#",), ("\U0001F644\U0001F644",)], "c string")
    assert [r[0] for r in df.select(TX.is_emoji("c")).collect()] == [True, False, False, False, False]


def test_word_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("Don't go, café i_2 a",)], "t string").select(TX.word_tokens("t").alias("tk"))
    r = df.select("tk", TX.word_ngrams(F.col("tk"), 1, 2).alias("g")).collect()[0]
    assert r.tk == ["don", "go", "café", "i_2"]
    assert r.g == ["don", "go", "café", "i_2", "don go", "go café", "café i_2"]


def test_char_ngrams(spark):
    df = spark.createDataFrame([("AbC  dé",)], "t string").select(TX.char_text("t").alias("ct"))
    g = df.select(TX.char_ngrams("ct", 3, 4)).collect()[0][0]
    s = "abc dé"
    assert g == [s[i:i + 3] for i in range(len(s) - 2)] + [s[i:i + 4] for i in range(len(s) - 3)]


def test_text_column_detection(spark):
    assert text_column(spark.createDataFrame([("x", "y")], "tweet string, text string")) == "tweet"
    assert text_column(spark.createDataFrame([("y",)], "text string")) == "text"
    with pytest.raises(ValueError):
        text_column(spark.createDataFrame([("y",)], "body string"))
    with pytest.raises(ValueError):
        variant_to_column("nope")


def test_no_python_in_text_plan(spark):
    df = spark.createDataFrame([("a \U0001F644",)], "text string")
    plan = add_variants(df)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
