"""Names that are written in several ways: folded letters, sound keys and similarity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namesift.functions.text import bind

# Letters with a mark and the letter without, one for one; and letters written as two.
MARKED = "àáâãäåāăąçćčďđèéêëēėęěğìíîïīįıłñńňòóôõöøōőřśšşșťţțùúûüūůűųýÿžźż"
UNMARKED = "aaaaaaaaacccddeeeeeeeegiiiiiiilnnnoooooooorsssstttuuuuuuuuyyzzz"
TWO = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"))
# Letters that sound alike, in the order they are replaced.
SOUNDS = (
    ("[^a-z]", ""),
    ("^(kn|gn|pn)", "n"),
    ("^wr", "r"),
    ("ph", "f"),
    ("sch|sh|sz", "s"),
    ("tch|ch|ck|q", "k"),
    ("c([eiy])", "s$1"),
    ("c", "k"),
    ("x", "ks"),
    ("z", "s"),
    ("v|w", "f"),
    ("d|th", "t"),
    ("b", "p"),
    ("g", "k"),
    ("j|y", "i"),
    ("([a-z])[aeiouh]+", "$1"),
    ("[aeiou]", "a"),
    ("(.)\\1+", "$1"),
)
LONGEST = 64
BOOST, PREFIX, FROM = 0.1, 4, 0.7


def folded(name: Column) -> Column:
    """Lower case, letters without marks, everything but letters and single spaces dropped, trimmed."""
    text = F.translate(F.lower(name), MARKED, UNMARKED)
    for written, plain in TWO:
        text = F.replace(text, F.lit(written), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[^a-z ]", ""), " +", " "))


def sound_key(name: Column) -> Column:
    """What a folded name sounds like: names that sound alike in several languages share it."""
    text = name
    for pattern, sound in SOUNDS:
        text = F.regexp_replace(text, pattern, sound)
    return text


def _letters(text: Column) -> Column:
    return F.filter(F.split(F.substring(text, 1, LONGEST), ""), lambda c: c != "")


def _jaro(a: Column, b: Column) -> Column:
    """Jaro similarity of two arrays of letters, in one fold over the first: each letter takes the first equal free one near it."""
    m, n = F.size(a), F.size(b)
    near = F.greatest(F.floor(F.greatest(m, n) / 2).cast("int") - 1, F.lit(0))
    none = F.array().cast("array<int>")

    def take(taken: Column, i: Column) -> Column:
        places = F.sequence(F.greatest(i - near, F.lit(0)), F.least(i + near, n - 1))
        open_places = F.filter(places, lambda j: (F.get(b, j) == F.get(a, i)) & ~F.array_contains(taken["b"], j))
        found = F.when(F.greatest(i - near, F.lit(0)) <= F.least(i + near, n - 1), F.get(open_places, F.lit(0)))
        both = F.struct(F.concat(taken["a"], F.array(i)).alias("a"), F.concat(taken["b"], F.array(found)).alias("b"))
        return F.when(found.isNotNull(), both).otherwise(taken)

    start = F.struct(none.alias("a"), none.alias("b"))

    def similarity(t: Column) -> Column:
        hits = F.size(t["a"])
        left = F.transform(t["a"], lambda i: F.get(a, i))
        right = F.transform(F.sort_array(t["b"]), lambda j: F.get(b, j))
        moved = F.size(F.filter(F.zip_with(left, right, lambda x, y: x != y), lambda d: d))
        k = hits.cast("double")
        return F.when(hits == 0, 0.0).otherwise((k / m + k / n + (k - F.floor(moved / 2)) / k) / 3)

    taken = F.aggregate(F.sequence(F.lit(0), m - 1), start, take)
    return F.when((m > 0) & (n > 0), bind(taken, similarity)).otherwise(F.when((m == 0) & (n == 0), 1.0).otherwise(0.0))


def jaro_winkler(left: Column, right: Column) -> Column:
    """Similarity from 0 to 1 that favours a shared start; names count up to ``LONGEST`` letters. NULL if a side is."""

    def whole(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        same = F.filter(F.sequence(F.lit(1), F.lit(PREFIX)), lambda k: (k <= F.size(a)) & (k <= F.size(b)) & (F.slice(a, 1, k) == F.slice(b, 1, k)))
        return bind(_jaro(a, b), lambda s: F.when(s > FROM, s + F.size(same) * BOOST * (1 - s)).otherwise(s))

    pair = F.struct(_letters(left).alias("a"), _letters(right).alias("b"))
    return F.when(left.isNotNull() & right.isNotNull(), bind(pair, whole))


def name_similarity(name: Column, full_name: Column) -> Column:
    """How alike a first name and the first word of a full name are once folded; NULL if either has no letter left."""

    def compared(pair: Column) -> Column:
        return F.when((pair["a"] != "") & (pair["b"] != ""), jaro_winkler(pair["a"], pair["b"]))

    sides = F.struct(folded(name).alias("a"), F.get(F.split(folded(full_name), " "), F.lit(0)).alias("b"))
    return bind(sides, compared)


def same_sound(name: Column, full_name: Column) -> Column:
    """Whether a first name and the first word of a full name sound alike."""
    first = F.get(F.split(folded(full_name), " "), F.lit(0))
    return F.coalesce((sound_key(folded(name)) == sound_key(first)) & (folded(name) != ""), F.lit(False))
