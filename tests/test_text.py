import pytest
from pyspark.sql import functions as F

from namesift.functions import fixed, prompts
from namesift.functions import text as X


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, value, column, kind="string"):
    return values(spark, [(value,)], f"x {kind}", column)[0][0]


@pytest.mark.parametrize(
    "raw, label",
    [
        (" Amélie: The Movie! ", " amlie the movie"),
        ("...", ""),
        ("", ""),
        ("two  spaces  ", "two  spaces"),
        ("line\nbreak", "linebreak"),
        ("Straße 7", "strae 7"),
        (None, None),
    ],
)
def test_normalize_label(spark, raw, label):
    assert one(spark, raw, X.normalize_label(F.col("x"))) == label


def test_canonical_key(spark):
    assert one(spark, " The  Dark   Knight!", X.canonical_key(F.col("x"))) == "_the_dark_knight"


@pytest.mark.parametrize(
    "raw, cleaned",
    [("Up.", "Up"), ("Up..", "Up."), ("", ""), ("Unknown", None), ("Unknown.", None), ("N/A", None), (None, None), ("unknown", "unknown"), ("a.\n", "a.\n")],
)
def test_clean_answer(spark, raw, cleaned):
    assert one(spark, raw, X.clean_answer(F.col("x"))) == cleaned


@pytest.mark.parametrize(
    "left, right, kind",
    [
        ("up", "up", "exact"),
        ("up", "up in the air", "overlap"),
        ("up in the air", "up", "overlap"),
        ("up", "down", "none"),
        ("", "up", "none"),
        ("up", "", "none"),
        ("", "", "none"),
        (None, "up", "none"),
        ("up", None, "none"),
    ],
)
def test_match_type(spark, left, right, kind):
    got = values(spark, [(left, right)], "a string, b string", X.match_type(F.col("a"), F.col("b")))
    assert got == [(kind,)]


def test_empty_text_matches_only_under_the_old_rule(spark):
    kind = X.match_type(F.col("a"), F.col("b"), allow_empty=True)
    assert values(spark, [("", "up")], "a string, b string", kind) == [("overlap",)]


def test_row_question_drops_missing_parts(spark):
    question = X.row_question(F.lit("What film"), [(" by ", F.col("x")), (" with ", F.lit("B"))], "?")
    assert one(spark, None, question) == "What film with B?"
    assert one(spark, "A", question) == "What film by A with B?"


def test_search_terms_keep_a_space_for_missing_parts(spark):
    assert one(spark, None, X.search_terms(F.lit("a"), F.col("x"), F.lit("b"))) == "a  b"


@pytest.mark.parametrize(
    "sentence, category",
    [
        ("In May the new cases rose", "new confirmed"),
        ("On Monday France total confirmed was", "total confirmed"),
        ("In May there were deaths cases", "deaths"),
        ("In May the deaths cases", "total deaths"),
        ("too short", ""),
        ("a b c d", "d"),
    ],
)
def test_template_category(spark, sentence, category):
    got = one(spark, sentence, X.template_category(F.col("x")))
    words = sentence.split(" ")
    expected = fixed.COUNT_TEMPLATES.get(" ".join(words[3:5]), " ".join(words[3:5]))
    assert got == expected
    if category not in ("deaths",):
        assert got == category


@pytest.mark.parametrize(
    "name, full, answer",
    [
        ("Mara", "Mara Quist", "Y"),
        ("Mara", "QUIST MARA", "N"),
        ("Mara", "MARA QUIST", "Y"),
        ("Mar", "Mara Quist", "N"),
        ("", "Mara", "Unknown"),
        (None, "Mara", "Unknown"),
        ("Mara", "???", "Unknown"),
    ],
)
def test_first_name_match(spark, name, full, answer):
    got = values(spark, [(name, full)], "a string, b string", X.first_name_match(F.col("a"), F.col("b")))
    assert got == [(answer,)]


@pytest.mark.parametrize(
    "raw, category", [("the cat and the dog", "en"), ("le chat", "fr"), ("the le", "Unknown"), ("xyz", "Unknown"), ("", "Unknown"), (None, "Unknown")]
)
def test_lexicon_category(spark, raw, category):
    lexicon = {"en": ["the", "and"], "fr": ["le"]}
    assert one(spark, raw, X.lexicon_category(F.col("x"), lexicon)) == category


@pytest.mark.parametrize(
    "url, title, words",
    [
        ("https://a.org/films/the-dark_knight.html", "the dark knight", "films the dark knight.html"),
        ("a.org", "", ""),
        ("https://a.org/", "", ""),
        ("https://a.org/x?q=1#top", "x?q=1#top", "x?q=1#top"),
        ("https://a.org/ab/cd", "ab", "ab cd"),
    ],
)
def test_url(spark, url, title, words):
    assert values(spark, [(url,)], "x string", X.url_title(F.col("x")), X.url_words(F.col("x"))) == [(title, words)]


def test_page_title_and_links(spark):
    html = '<title>A b</title><b><a href="/x">x</a><a href="/y">y</a><a href="/z">'
    assert one(spark, html, X.page_title(F.col("x"))) == "A b"
    assert one(spark, "<p>none", X.page_title(F.col("x"))) == ""
    assert one(spark, None, X.page_title(F.col("x"))) == ""
    assert one(spark, html, X.page_links(F.col("x"), 2)) == ["/x", "/y"]


def test_sentences(spark):
    assert one(spark, "One. Two!  Three?\nfour", X.sentences(F.col("x"))) == ["One.", "Two!", "Three?", "four"]
    assert one(spark, "", X.sentences(F.col("x"))) == []


def test_prompts(spark):
    import json

    made = json.loads(one(spark, 'say "hi"\n', prompts.entity_prompt(F.col("x"), "title")))
    assert [m["role"] for m in made] == ["user"] * 4
    assert made[1]["content"] == 'say "hi"\n'
    assert made[2]["content"] == "Respond ONLY with the title ONLY title"
    assert one(spark, None, prompts.entity_prompt(F.col("x"), "title")) is None
    listed = json.loads(one(spark, "t", prompts.category_prompt(F.col("x"), ["a", "b"])))[1]["content"]
    assert listed.endswith("categories: ['a', 'b']")
    name = json.loads(one(spark, "Mara", prompts.first_name_prompt(F.col("x"), F.lit("Mara Q"))))[1]["content"]
    assert name == "Is Mara the first name of Mara Q?"


def test_bind_computes_once_and_keeps_null(spark):
    assert one(spark, 3, X.bind(F.col("x") + 1, lambda v: v * v), "int") == 16
    assert one(spark, None, X.bind(F.col("x") + 1, lambda v: v * v), "int") is None


def test_reciprocal_rank(spark):
    assert one(spark, 4, X.reciprocal_rank(F.col("x")), "int") == 0.25
    assert one(spark, None, X.reciprocal_rank(F.col("x")), "int") == 0.0
