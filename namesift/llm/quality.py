"""Quality rules applied line first, then to the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesift.llm.common import documents, packed

# White space of the contract: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>•"
STOPS = ".!?…。！？"
BOILERPLATE = (
    "(?i)(cookie|all rights reserved|privacy policy|terms of (use|service)|click here|subscribe"
    "|sign (in|up)|log ?in to|enable javascript|lorem ipsum|skip to content)"
)
# Words of a line up to which a boilerplate phrase fails it, and words that go with each separator or shout at least.
BOILERPLATE_WORDS, WORDS_EACH = 12, 5
# A document fails that loses more than this share of the characters of its lines.
MOST_LOST = 0.5


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def _n(text: Column, marks: str) -> Column:
    """How many characters of ``text`` are among ``marks``."""
    return F.char_length(text) - F.char_length(F.translate(text, marks, ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def repeated_words(tokens: Column, window: int = 5) -> Column:
    """Words that lie in a run of ``window`` words found twice or more.

    Words are hashed once and runs are compared as 64-bit hashes of these. Most texts have no repeated
    run, which one hash set shows; for the others equal runs are brought together by a sort, and
    the words they cover are added up along the text.
    """

    def runs(own: Column) -> Column:
        last = F.size(own) - window
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(window)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])),
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(
            let(pairs, places),
            start,
            lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    hashed = let(F.transform(tokens, lambda w: F.xxhash64(w)), runs)
    several = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(tokens) < window, F.lit(0)).otherwise(several)


def line_fails(line: Column) -> Column:
    """Whether a trimmed line is no prose: navigation, symbols, shouting, no sentence end, repeats, boilerplate.

    Separators and shouts have to be many for the words of the line, and a boilerplate phrase fails a short line only, so
    one of them in a long paragraph does no harm. Quotation marks of any kind separate nothing.
    """
    length = F.char_length(line)

    def rules(own: Column) -> Column:
        n = F.size(own)
        separators = _n(line, SEPARATORS)
        shouted = length - F.char_length(F.replace(line, F.lit("!!"), F.lit("")))
        return (
            ((separators >= 3) & (WORDS_EACH * separators >= n))
            | ~line.rlike(f"[{STOPS}]")
            | ((shouted >= 6) & (WORDS_EACH * shouted >= 2 * n))
            | (10 * _n(line, SYMBOLS) > length)
            | ((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
            | (3 * F.size(F.array_distinct(own)) < n)
        )

    return let(F.split(line, f"[{SPACES}]+"), rules)


def rated(docs: DataFrame) -> DataFrame:
    """(doc, counts, cleaned text, verdict) for every row of ``docs``, in one pass without a shuffle.

    Lines without a word are left out of the clean text. Every other line is held against
    the line rules; the document is kept if the base rules pass and its failing lines
    hold at most half of its characters. A null text counts as an empty one: it has
    no words and fails. ``doc`` is the row as a struct.

    The row passes through a one-element explode. A later filter on a verdict cannot be pushed below it, where
    it would work the text out anew at every use.
    """
    whole = F.coalesce("doc.text", F.lit(""))
    worded = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    judged = F.transform(
        "lines",
        lambda x: let(
            F.btrim(x, F.lit(SPACES)),
            lambda s: F.struct(x.alias("line"), F.char_length(s).alias("n"), line_fails(s).alias("fails")),
        ),
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    rows = packed(docs).select("doc", words(whole).alias("words"), worded.alias("lines"))
    rows = rows.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
        _n(whole, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        judged.alias("judged"),
    )
    rows = rows.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "line_chars": total(F.col("judged")),
            "lost_chars": total(F.filter("judged", lambda x: x["fails"])),
            "clean": F.array_join(F.transform(F.filter("judged", lambda x: ~x["fails"]), lambda x: x["line"]), "\n"),
        }
    )
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= F.col("line_chars") * MOST_LOST)
    rows = rows.withColumn("kept", kept).drop("judged")
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("r")).select("r.*")


def clean(docs: DataFrame) -> DataFrame:
    """The documents kept, with their failing lines removed from ``text``."""
    return rated(docs).where("kept").select(F.col("doc").withField("text", F.col("clean")).alias("doc")).select("doc.*")


def op7_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    rows = rated(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select(F.col("doc.doc_id").alias("doc_id"), *[c for c in rows.columns if c not in ("doc", "clean")])


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, [x FOR x IN string_split_regex(text, '[ \\t-\\r]+') IF x <> ''] AS words,
    [x FOR x IN string_split(text, chr(10)) IF trim(x, {_TRIM}) <> ''] AS lines FROM t),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM (
    SELECT r, unnest(range(1, len(words) - 3)) AS i, array_to_string(words[i : i + 4], ' ') AS gram FROM w)),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM g, range(0, 5) AS o(k) WHERE n > 1 GROUP BY r),
s AS (SELECT r, trim(unnest(lines), {_TRIM}) AS s FROM w),
f AS (
  SELECT r, s, length(s) AS n, string_split_regex(s, '[ \\t-\\r]+') AS own,
    (length(s) - length(translate(s, '{SEPARATORS}', '')) >= 3 AND {WORDS_EACH} * (length(s) - length(translate(s, '{SEPARATORS}', ''))) >= len(own))
      OR NOT regexp_matches(s, '[{STOPS}]')
      OR (length(s) - length(replace(s, '!!', '')) >= 6 AND {WORDS_EACH} * (length(s) - length(replace(s, '!!', ''))) >= 2 * len(own))
      OR 10 * (length(s) - length(translate(s, '{SYMBOLS}', ''))) > length(s)
      OR (len(own) <= {BOILERPLATE_WORDS} AND regexp_matches(s, '{BOILERPLATE}'))
      OR 3 * len(list_distinct(own)) < len(own) AS fails
  FROM s),
c AS (SELECT r, sum(n) AS line_chars, coalesce(sum(n) FILTER (fails), 0) AS lost_chars FROM f GROUP BY r),
a AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[ \\t-\\r]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
    coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN p USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND lost_chars <= line_chars * {MOST_LOST} AS kept FROM b
"""
