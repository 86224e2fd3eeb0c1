"""Main text of web pages: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import functools
import html
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Labelled pages the field is trained on: those of the smallest hashes; documented bound.
TRAIN_PAGES = 120
ROUNDS = 12
# Pages parsed at first for each page to train on, and how many times more if too few of them label themselves.
PARSED, MORE = 16, 64
# Innermost elements around a block that are looked at, and how many different ones a task keeps the features of.
NEAREST = 32
KEPT = 1024

# Element kinds of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select"
    " summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Names under which pages keep what is not the main text.
ASIDE_TAGS = frozenset("nav header footer aside form menu button select".split())
ASIDE_NAMES = re.compile(r"(^|[-_])(ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|footer|header|menu|nav\w*|notice|popup|promo|related|reply|share|sidebar|social|sponsor\w*|subscribe|widget)($|[-_])")
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = re.compile(r"(^|[-_])(article|body|content|entry|main|post|story|text)($|[-_])")

_MARKUP = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    """Text of a leaf block with its ``NEAREST`` elements, outermost first, and the share of its text in links."""

    text: str
    tags: tuple[str, ...]
    names: frozenset[str]
    links: float


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order: runs of text that no block element breaks.

    Broken markup is read as far as it goes: unclosed elements last until an outer
    one ends, comments and raw elements that do not end last to the end. Raw elements
    such as scripts have no text, whether or not their tag ends in a slash. Character references are decoded
    and white space is made one space. Work grows with the length of the page, however deep its elements lie.
    """
    page = page or ""
    stack: list[tuple[str, frozenset[str]]] = []
    out: list[Block] = []
    text: list[str] = []
    open_tags: defaultdict[str, int] = defaultdict(int)
    none: frozenset[str] = frozenset()
    linked = at = 0

    def shut_from(i: int) -> None:
        for t, _ in stack[i:]:
            open_tags[t] -= 1
        del stack[i:]

    def flush() -> None:
        nonlocal linked
        if not text:
            return
        whole = " ".join("".join(text).split())
        if whole:
            near = stack[-NEAREST:]
            out.append(Block(whole, tuple([t for t, _ in near]), none.union(*[ns for _, ns in near]), linked / len(whole)))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece)
            text.append(piece)
            if open_tags["a"]:
                linked += len(piece)

    while (m := _MARKUP.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        closing, name, rest, closing_broken, name_broken, rest_broken = m.groups()
        if name is None:
            closing, name, rest = closing_broken, name_broken, rest_broken
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not (name == "svg" and rest.endswith("/")):
                end = _CLOSING[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            text.append(" ")
        if name in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1) if open_tags[name] else ():
                if stack[i][0] == name:
                    shut_from(i)
                    break
            continue
        if shut := CLOSES.get(name):
            for i in range(len(stack) - 1, -1, -1) if any(open_tags[t] for t in shut) else ():
                if stack[i][0] in shut:
                    shut_from(i)
                    break
                if stack[i][0] in BLOCKS and name == "p":
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "menu", "select"):
                    break
        elif name in BLOCKS:
            for i in range(len(stack) - 1, -1, -1) if open_tags["p"] else ():
                if stack[i][0] == "p":
                    shut_from(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        found = frozenset(w for m in _NAMES.finditer(rest) for w in (m.group(1) or m.group(2) or m.group(3) or "").lower().split()) if rest else none
        stack.append((name, found))
        open_tags[name] += 1
    add(page[at:])
    flush()
    return out


@functools.lru_cache(maxsize=KEPT)
def around(tags: tuple[str, ...], names: frozenset[str]) -> list[str]:
    """Features of the elements around a block, which the blocks beside it mostly share.

    Sorted, so that sums over them do not depend on the order of a set.
    """
    out = [f"in:{t}" for t in sorted(set(tags))]
    out += [f"name:{n}" for n in sorted(names)]
    if any(ASIDE_NAMES.search(n) for n in names):
        out.append("aside name")
    if any(MAIN_NAMES.search(n) for n in names):
        out.append("main name")
    return out


def features(block: Block, at: int, n: int) -> list[str]:
    """Ancestor tags and names, and what the text looks like."""
    words = len(_WORD.findall(block.text))
    out = ["bias", f"own:{block.tags[-1] if block.tags else ''}", f"words:{min(words, 64).bit_length()}", f"links:{round(block.links * 4)}", f"place:{4 * at // n}"]
    out += around(block.tags, block.names)
    if block.text[-1] in ".!?…":
        out.append("ends")
    if "©" in block.text:
        out.append("copyright")
    if block.text.count(",") > 1:
        out.append("commas")
    return out


def marked(block: Block) -> bool:
    """The label a page's own markup gives a block: inside its main element and in nothing set aside."""
    aside = any(t in ASIDE_TAGS for t in block.tags) or any(ASIDE_NAMES.search(n) for n in block.names)
    main = any(t in MAIN_TAGS for t in block.tags) or any(MAIN_NAMES.search(n) for n in block.names)
    return main and not aside


def variants(found: list[Block], rng: random.Random) -> Iterator[tuple[list[Block], list[bool]]]:
    """The labelled page, and the same page in other markup with more set beside its text.

    Labels are those of the blocks before the change: renamed elements keep them,
    and added menus, notices, forms and comments are not main text.
    """
    labels = [marked(b) for b in found]
    yield found, labels
    rename = {"article": rng.choice(["div", "main", "section"]), "nav": rng.choice(["div", "nav"]), "footer": rng.choice(["div", "footer"])}
    names = {"article": rng.choice(["content", "post", "entry", "story"]), "nav": "menu", "footer": "footer"}

    def changed(b: Block) -> Block:
        extra = {names[t] for t in b.tags if t in rename and rename[t] == "div"}
        return Block(b.text, tuple(rename.get(t, t) for t in b.tags), b.names | extra, b.links)

    rows = [(changed(b), y) for b, y in zip(found, labels, strict=True)]
    prose = [b.text for b, y in rows if y] or ["text"]
    base = ("html", "body")
    added = [
        Block(rng.choice(prose), (*base, "aside", "p"), frozenset(["sidebar"]), 0.0),
        Block(rng.choice(prose)[:80], (*base, "div", "p"), frozenset([rng.choice(["cookie", "notice", "banner"])]), 0.0),
        Block(rng.choice(prose)[:60], (*base, "form", "label"), frozenset(), 0.0),
        Block(rng.choice(prose), (*base, *rng.choice([("article", "section"), ("section",), ("div",)]), "p"), frozenset([rng.choice(["comment", "comments", "reply"])]), 0.0),
        Block(rng.choice(prose), (*base, "article", "div"), frozenset([rng.choice(["ad", "advert", "promo", "sponsored"])]), 0.0),
        Block(rng.choice(prose)[:40], (*base, "header", "p"), frozenset(), 0.0),
    ]
    for b in added:
        rows.insert(rng.randrange(len(rows) + 1), (b, False))
    yield [b for b, _ in rows], [y for _, y in rows]


class Field:
    """Conditional random field with two labels: weights of features and of neighbouring labels."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, 2))
        self.moves = np.zeros((2, 2))
        # The weights again by feature: on the few of a block, plain sums are cheaper than arrays.
        self.known: dict[str, list[float]] = {}

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[r].sum(axis=0) for r in rows])

    def train(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS, rate: float = 0.3) -> None:
        """Stochastic ascent of the conditional likelihood, with forward and backward sums."""
        for rows, _ in pages:
            for f in (f for r in rows for f in r):
                self.index.setdefault(f, len(self.index))
        self.weights = np.zeros((len(self.index), 2))
        coded = [([[self.index[f] for f in r] for r in rows], np.array(y)) for rows, y in pages if rows]
        rng = random.Random(0)
        for k in range(rounds):
            rng.shuffle(coded)
            step = rate / (1 + k)
            for rows, y in coded:
                s, n = self.scores(rows), len(rows)
                ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
                ahead[0] = s[0]
                for i in range(1, n):
                    ahead[i] = s[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + self.moves, axis=0)
                for i in range(n - 2, -1, -1):
                    behind[i] = np.logaddexp.reduce(self.moves + (s[i + 1] + behind[i + 1])[None, :], axis=1)
                whole = np.logaddexp.reduce(ahead[-1])
                single = np.exp(ahead + behind - whole)
                slope = -single
                slope[np.arange(n), y] += 1
                pair = np.zeros((2, 2))
                for i in range(1, n):
                    pair -= np.exp(ahead[i - 1][:, None] + self.moves + (s[i] + behind[i])[None, :] - whole)
                    pair[y[i - 1], y[i]] += 1
                self.moves += step * pair
                for i, r in enumerate(rows):
                    self.weights[r] += step * slope[i]
        self.known = dict(zip(self.index, self.weights.tolist(), strict=True))

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the most likely labels of a page as a whole."""
        if not rows:
            return []
        get, moves = self.known.get, self.moves.tolist()
        best, back = None, []
        for r in rows:
            a = b = 0.0
            for f in r:
                if (w := get(f)) is not None:
                    a, b = a + w[0], b + w[1]
            if best is None:
                best = (a, b)
                continue
            to_a = (best[0] + moves[0][0], best[1] + moves[1][0])
            to_b = (best[0] + moves[0][1], best[1] + moves[1][1])
            back.append((int(to_a[1] > to_a[0]), int(to_b[1] > to_b[0])))
            best = (a + max(to_a), b + max(to_b))
        label = int(best[1] > best[0])
        out = [label]
        for pointer in reversed(back):
            label = pointer[label]
            out.append(label)
        return out[::-1]


def train(pages: DataFrame, sample: int = TRAIN_PAGES) -> Field:
    """A field learnt from at most ``sample`` pages whose own markup labels their blocks.

    Pages with no main element, or nothing else, label nothing and are passed over
    inside the scan, so that they take no place among the ``sample``. Hashes are spread evenly, so
    the share of pages with the smallest is parsed first, and a larger one only if it holds too few that label themselves.
    """

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array([0 < sum(map(marked, found)) < len(found) for found in (blocks(t.as_py()) for t in batch.column(1))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept)], ["h"])

    ids = pages.where("html is not null").select(F.xxhash64("page_id", "html").alias("h"), "html")
    # Hashes are ranked first; only the pages chosen leave their task.
    share = PARSED * sample / max(1, pages.count())
    while True:
        least = ids.where(F.col("h") < int(share * 2**64) - 2**63) if share < 1 else ids
        first = [r["h"] for r in least.mapInArrow(usable, "h long").orderBy("h").limit(sample).collect()]
        if len(first) >= sample or share >= 1:
            break
        share *= MORE
    chosen = ids.where(F.col("h").isin(first)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h")
    rng = random.Random(0)
    labelled = []
    for _, page in chosen.toPandas().itertuples(index=False):
        for rows, labels in variants(blocks(page), rng):
            labelled.append(([features(b, i, len(rows)) for i, b in enumerate(rows)], [int(y) for y in labels]))
    field = Field()
    field.train(labelled)
    return field


def main_text(page: str | None, field: Field) -> str:
    """Blocks that the field takes for main text, joined by line breaks; empty without any."""
    found = blocks(page)
    labels = field.decode([features(b, i, len(found)) for i, b in enumerate(found)])
    return "\n".join(b.text for b, y in zip(found, labels, strict=True) if y)


def extracted(pages: DataFrame, sample: int = TRAIN_PAGES) -> DataFrame:
    """(page_id, url, text) of every row of ``pages``; a null or empty page has an empty text.

    Rows stay one for one, repeated ones too; other columns are not looked at. If no
    page labels itself, the field knows nothing and every text is empty.
    """
    field = pages.sparkSession.sparkContext.broadcast(train(pages, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py(), field.value) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    rows = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
