"""Column expressions on text. All run inside the JVM and move no rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from namesift.functions import fixed

TOKEN = r"[\p{L}\p{N}]+"
SENTENCE_MARK = "\u0001"
HELD_MARK = "\u0002"
HELD_POINT = "(^|[^0-9A-Za-z])((?:(?:{}|[A-Z])[.])+)"
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "St", "vs", "No", "Fig", "e[.]g", "i[.]e")


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once however often ``then`` uses it.

    A filter on a computed column is pushed below the projection and repeats the
    expression at each use; a costly value bound here stays one evaluation.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def word_run(words: Column, start: Column, n: int) -> Column:
    """Up to ``n`` words from position ``start`` (from 0), joined by spaces."""
    return F.concat_ws(" ", *[F.get(words, start + k) for k in range(n)])


def normalize_label(text: Column) -> Column:
    """ASCII letters, digits and spaces only, no trailing spaces, lower case.

    ``\\p{Alnum}`` is the ASCII class; on long texts it scans several times faster
    than the same characters written as ranges.
    """
    kept = F.regexp_replace(text, r"[^\p{Alnum} ]", "")
    return F.lower(F.rtrim(kept))


def canonical_key(text: Column) -> Column:
    """Normalized label with each run of spaces turned into one underscore."""
    return F.regexp_replace(normalize_label(text), " +", "_")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sentences(text: Column, abbreviations: Sequence[str] = ABBREVIATIONS) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space.

    The point of a listed abbreviation or of a single capital letter ends nothing.
    """
    held = F.regexp_replace(text, HELD_POINT.format("|".join(abbreviations)), "$1$2" + HELD_MARK)
    marked = F.regexp_replace(held, r"([.!?])[ \n\t\r]+", "$1" + SENTENCE_MARK)
    marked = F.translate(marked, HELD_MARK, "")
    return F.filter(F.split(marked, SENTENCE_MARK), lambda s: s != "")


def clean_answer(answer: Column, sentinels: Sequence[str] = (fixed.UNKNOWN, "N/A")) -> Column:
    """Drop one trailing period; an answer that says "not found" becomes NULL."""
    bare = F.regexp_replace(answer, r"\.\z", "")
    return F.when(~bare.isin(*sentinels), bare)


def is_answered(answer: Column) -> Column:
    """True for an answer that is neither NULL nor the not-found word in any case."""
    return F.coalesce(F.lower(answer) != fixed.UNKNOWN.lower(), F.lit(False))


def nullable_text(column: Column) -> Column:
    """Value as text; numbers lose their fraction first, as years do."""
    return column.cast("string")


def whole_number_text(column: Column) -> Column:
    return column.cast("int").cast("string")


def search_terms(*parts: Column) -> Column:
    """Parts in order, one space between; a missing part is an empty string."""
    return F.concat_ws(" ", *[F.coalesce(nullable_text(p), F.lit("")) for p in parts])


def row_question(start: Column, parts: Sequence[tuple[str, Column]], end: str) -> Column:
    """A question from a row: ``start``, each prefix with its value, ``end``.

    A part whose value is NULL is left out together with its prefix.
    """
    pieces = [F.concat(F.lit(prefix), value) for prefix, value in parts]
    return F.concat_ws("", start, *pieces, F.lit(end))


def display_name(key: Column) -> Column:
    """``some_key`` shown as ``Some Key``."""
    return F.initcap(F.translate(key, "_", " "))


def template_category(
    sentence: Column,
    rules: Mapping[str, str] = fixed.COUNT_TEMPLATES,
    positions: Sequence[int] = (3, 4),
) -> Column:
    """Category of a templated sentence from the words at fixed positions.

    A word past the end of the sentence is left out; words no rule names are
    returned as they are.
    """
    words = F.split(sentence, " ")
    found = F.concat_ws(" ", *[F.get(words, F.lit(p)) for p in positions])
    mapped = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    return F.coalesce(F.element_at(mapped, found), found)


def first_name_match(name: Column, full_name: Column) -> Column:
    """``Y`` if the name is the first word of the full name, ``N`` if not.

    Both are normalized; a name or full name with nothing left is ``Unknown``.
    """
    left = F.trim(normalize_label(name))
    right = F.trim(normalize_label(full_name))
    first = F.get(F.split(right, " "), F.lit(0))
    empty = F.coalesce((left == "") | (right == ""), F.lit(True))
    return F.when(empty, fixed.UNKNOWN).when(left == first, "Y").otherwise("N")


def lexicon_category(text: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """The category whose lexicon lists the most words of the text.

    Counted inside the row, so nothing is shuffled. No hit, or two categories
    level at the top, is ``Unknown``.
    """

    def hits(words: Column, listed: Sequence[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*listed)))

    def scores(words: Column) -> Column:
        return F.array(
            *[F.struct(hits(words, listed).alias("n"), F.lit(name).alias("name")) for name, listed in lexicon.items()]
        )

    def pick(scored: Column) -> Column:
        def leader(top: Column) -> Column:
            level = F.filter(scored, lambda s: s["n"] == top)
            return F.when((top > 0) & (F.size(level) == 1), F.get(level, F.lit(0))["name"])

        best = bind(F.array_max(F.transform(scored, lambda s: s["n"])), leader)
        return F.coalesce(best, F.lit(fixed.UNKNOWN))

    return bind(bind(tokens(text), scores), pick)


# ---- pages -----------------------------------------------------------------


def page_title(html: Column) -> Column:
    """Text of the first ``<title>``, empty if there is none."""
    return F.coalesce(F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit(""))


def page_links(html: Column, n: int, anchor: str = r'<a href="([^"]*)"') -> Column:
    """The first ``n`` captures of ``anchor`` in page order."""
    return F.slice(F.regexp_extract_all(html, F.lit(anchor), F.lit(1)), 1, n)


def page_text(html: Column) -> Column:
    """Page with its tags replaced by spaces."""
    return F.regexp_replace(html, "<[^>]*>", " ")


def url_segments(url: Column) -> Column:
    """Path segments after the host; an address without a path has none."""
    parts = F.split(F.regexp_replace(url, "^[a-z]+://", ""), "/")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def url_words(url: Column) -> Column:
    """All path segments as words."""
    return F.trim(F.regexp_replace(F.array_join(url_segments(url), " "), "-|_", " "))


def url_title(url: Column) -> Column:
    """The longest path segment as words, the first of equals, without ``.html``."""
    bare = F.transform(url_segments(url), lambda s: F.regexp_replace(s, r"\.html", ""))
    longest = F.array_max(F.transform(bare, lambda s: F.length(s)))
    pick = F.get(F.filter(bare, lambda s: F.length(s) == longest), F.lit(0))
    return F.coalesce(F.regexp_replace(pick, "-|_", " "), F.lit(""))


# ---- matching --------------------------------------------------------------


def matches(left: Column, right: Column, allow_empty: bool = False) -> Column:
    """Equal, or one contains the other.

    An empty text is contained in every text and would match anything, so it
    matches nothing unless ``allow_empty`` keeps that rule.
    """
    hit = (left == right) | F.contains(left, right) | F.contains(right, left)
    if not allow_empty:
        hit = hit & (left != "") & (right != "")
    return F.coalesce(hit, F.lit(False))


def match_type(left: Column, right: Column, allow_empty: bool = False) -> Column:
    hit = matches(left, right, allow_empty)
    return F.when(hit & (left == right), "exact").when(hit, "overlap").otherwise("none")


def match_code(kind: Column) -> Column:
    return F.when(kind == "exact", 2).when(kind == "overlap", 1).otherwise(0)


def reciprocal_rank(rank: Column) -> Column:
    """One over the rank; a missing rank scores 0."""
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))
