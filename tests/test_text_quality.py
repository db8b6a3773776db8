"""Normalization, scripts and quality rules on texts that are made to trip one of them."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import quality as Q
from corpusforge.functions import script as S
from corpusforge.functions import text as X

PROSE = "The river turned slowly past the old mill, and nobody on the bank seemed to notice it. " * 8


def each(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[1] for r in df.select("i", column(F.col("text")).alias("x")).orderBy("i").collect()]


def test_invisible_quotes_whitespace(spark):
    texts = ["a​b‮c﻿\x07d\te\nf", "‘x’ “y” ″", "  a \t  b \n\n\n\n c  \r\n ", None, "", "\x85　"]
    got = each(spark, texts, X.normalize_native)
    assert got == ["abcd e\nf", "'x' \"y\" \"", "a b\n\nc", "", "", ""]
    assert each(spark, got, X.normalize_native) == got


@pytest.mark.parametrize("form", X.FORMS)
def test_unicode_forms(spark, form):
    texts = ["plain ascii", "ﬁne ＡＢ", "é é", None, "″"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["text"] for r in X.normalize_column(df, form=form).collect()}
    quote = str.maketrans("′″", "'\"")
    assert got == {i: unicodedata.normalize(form, t or "").translate(quote) for i, t in enumerate(texts)}


def test_unknown_form():
    with pytest.raises(ValueError, match="unknown Unicode form"):
        X.unicode_form("NFX")


SAMPLES = {
    "latin": PROSE,
    "cyrillic": "Река медленно текла мимо старой мельницы, и никто этого не заметил. " * 9,
    "greek": "Το ποτάμι κυλούσε αργά δίπλα στον παλιό μύλο και κανείς δεν το πρόσεξε. " * 9,
    "hebrew": "הנהר זרם לאט ליד הטחנה הישנה ואיש לא שם לב לכך בכלל. " * 9,
    "arabic": "كان النهر يجري ببطء قرب الطاحونة القديمة ولم يلاحظ ذلك أحد. " * 9,
    "devanagari": "नदी पुरानी चक्की के पास धीरे बहती रही और किसी ने ध्यान नहीं दिया। " * 9,
    "bengali": "নদীটি পুরনো কলের পাশ দিয়ে ধীরে বয়ে গেল আর কেউ তা লক্ষ্য করল না। " * 9,
    "hangul": "강은 오래된 방앗간 옆을 천천히 흘렀고 아무도 그것을 알아채지 못했다. " * 9,
    "han": "河水慢慢地流过古老的磨坊旁边而岸上没有一个人注意到这件事情。" * 9,
    "japanese": "川は古い水車小屋のそばをゆっくりと流れ、誰もそれに気づかなかった。" * 9,
    "thai": "แม่น้ำไหลช้าๆผ่านโรงสีเก่าและไม่มีใครบนฝั่งสังเกตเห็นเลย" * 9,
}


def test_scripts_are_found_and_prose_passes(spark):
    df = spark.createDataFrame([(k, v.strip()) for k, v in SAMPLES.items()], "name string, text string")
    for r in Q.assess(df).collect():
        assert r["quality"]["script"] == r["name"]
        assert r["quality"]["passed"], (r["name"], r["quality"]["failures"])
        assert r["quality"]["space_delimited"] == (r["name"] not in ("han", "japanese", "thai"))


def test_script_ties_and_none(spark):
    df = spark.createDataFrame([(0, "аb"), (1, "bа"), (2, "12 !?"), (3, None)], "i int, text string")
    got = {r["i"]: (r["script"], r["script_confidence"]) for r in S.with_script(df).collect()}
    assert got == {0: ("cyrillic", 0.5), 1: ("latin", 0.5), 2: ("unknown", 0.0), 3: ("unknown", 0.0)}


JUNK = {
    "word_count": "Home About Contact",
    "mean_word_length": "a b c d e f g. " * 40,
    "symbol_to_word_ratio": "# tag # other # more. " * 30,
    "alpha_word_ratio": "100 200 300 word. " * 60,
    "bullet_line_ratio": "\n".join(["- point of a list that is long."] * 1 + [f"- point {i} of a list with words." for i in range(20)]),
    "ellipsis_line_ratio": "\n".join(f"Number {i} begins a line and then..." for i in range(20)),
    "terminal_punctuation_ratio": "\n".join(f"Menu entry number {i} without an end" for i in range(20)),
    "repetition_ratio": "The same line stands here again and again.\n" * 20,
    "boilerplate_markers": PROSE + " Privacy Policy, Terms of Use, Cookie Policy, All Rights Reserved.",
}


def test_each_rule_has_a_text_that_fails_it(spark):
    df = spark.createDataFrame([*JUNK.items(), ("none", PROSE.strip())], "name string, text string")
    got = {r["name"]: r["quality"] for r in Q.assess(df).collect()}
    for name in JUNK:
        assert name in got[name]["failures"], name
        assert len(got[name]["rules"]) == len(Q.DEFAULT_RULES)  # no rule is left out after a failure
    assert got["none"]["passed"] and got["none"]["failures"] == []


def test_empty_texts_fail_and_do_not_crash(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n ",)], "text string")
    for r in Q.assess(df).collect():
        assert not r["quality"]["passed"] and "word_count" in r["quality"]["failures"]


def test_words(spark):
    texts = ["don't stop-gap 5th ab2c परीक्षण", "étude", "x" * 60_000, "a-" * 30_000 + "b", "河" * 60_000]
    got = each(spark, texts, lambda c: F.size(Q.words(c)))
    assert got == [6, 1, 1, 1, 1]


def test_custom_rule(spark):
    rule = Q.Rule("lines", lambda m: m["lines"], None, 2)
    df = spark.createDataFrame([(0, "a\nb\nc"), (1, "a")], "i int, text string")
    got = {r["i"]: r["quality"] for r in Q.assess(df, rules=(rule,)).collect()}
    assert got[0]["failures"] == ["lines"] and got[1]["passed"] and got[1]["script"] is None


def test_measures_of_random_texts(spark):
    r = random.Random(0)
    texts = ["".join(r.choices("ab #.…\n-*é1", k=r.randint(0, 60))) for _ in range(200)]
    texts = [t for t in each(spark, texts, X.normalize_native)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for row in Q.with_measures(df).collect():
        t, m = row["text"], row["m"]
        lines = [x.strip(" ") for x in t.split("\n") if x.strip(" ")]
        assert m["tokens"] == len(t.split()) and m["lines"] == len(lines)
        assert m["symbols"] == t.count("#") + t.count("...") + t.count("…")
        assert m["alpha_tokens"] == sum(any(c.isalpha() for c in w) for w in t.split())
        assert m["bullets"] == sum(x[0] in "*-" for x in lines)
        assert m["line_chars"] - m["distinct_line_chars"] == sum(map(len, lines)) - sum(map(len, set(lines)))


def test_tidy_guard_agrees_with_the_whole_chain(spark):
    """Normalization passes over texts that no step would change; scripts look for others than Latin only in what Latin leaves."""
    r = random.Random(8)
    parts = ["a", "b ", " ", "\n", "\n\n", " \n", "\t", "\r\n", "‘", "”", "″", "　", "​", "\x85", "\x1c", "é", "我", "я", "."]
    texts = ["".join(r.choices(parts, k=r.randrange(9))) for _ in range(1500)]
    quick = each(spark, texts, X.normalize_native)
    assert quick == each(spark, texts, lambda c: X.collapse_whitespace(X.fold_quotes(X.strip_invisible(c))))
    plain = lambda c: F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, X.H_SPACE, " "), X.BLANK_LINES, "\n\n"), r" *\n *", "\n"), F.lit(" \n"))
    stripped = lambda c: F.regexp_replace(F.regexp_replace(c, X.INVISIBLE, ""), X.CONTROL, "")
    assert quick == each(spark, texts, lambda c: plain(F.translate(stripped(c), X.QUOTES_FROM, X.QUOTES_TO)))


def test_unicode_forms_take_some_rows_at_a_time(spark):
    """A batch of texts was once decoded and returned whole."""
    sizes = lambda batches: (b.__class__.from_pydict({"n": [b.num_rows]}) for b in batches)
    df = spark.range(1000).select(F.concat(F.lit("é"), "id").alias("text")).coalesce(1)
    from corpusforge.session import slices

    assert X._in_form(df, "NFKC").count() == 1000
    assert max(r["n"] for r in df.mapInArrow(lambda x: sizes(slices(x)), "n long").collect()) == 256
