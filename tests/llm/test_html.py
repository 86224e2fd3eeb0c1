"""Which pages the field of op2 is trained on, and what is parsed to find them."""

import random

import pytest
from pyspark.sql import functions as F

from namesift.llm import html

TOLD = "<nav><a href='/'>Home</a></nav><article><p>Text of page {}, which says itself what it is.</p></article>"
PLAIN = "<div><p>Text of page {} without a main element.</p></div>"


def trained(pages, sample):
    """The field of the pages of the smallest hashes that label themselves, repeated rows counted as often as they come."""
    told = [r for r in pages.where("html is not null").withColumn("h", F.xxhash64("page_id", "html")).orderBy("h").collect()]
    told = [r for r in told if 0 < sum(map(html.marked, html.blocks(r["html"]))) < len(html.blocks(r["html"]))][:sample]
    rng, labelled = random.Random(0), []
    for page in dict.fromkeys(r["html"] for r in told):
        for rows, labels in html.variants(html.blocks(page), rng):
            labelled.append(([html.features(b, i, len(rows)) for i, b in enumerate(rows)], [int(y) for y in labels]))
    field = html.Field()
    field.train(labelled)
    return field


def page_table(spark, every, n=4000):
    """One page of ``every`` labels itself; some ids and pages are null and some rows come twice."""
    rows = [(i if i % 50 else None, "u", (TOLD if i % every == 0 else PLAIN).format(i)) for i in range(n)]
    rows += [(n + i, None, None) for i in range(40)] + [(n + 40 + i, "u", "") for i in range(40)] + rows[::7] + rows[::7]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6, "page_id")


@pytest.mark.parametrize("every", [1, 30, 2500, 10_000])
def test_field_is_trained_on_the_smallest_hashes(spark, every):
    pages = page_table(spark, every)
    for sample in (1, 5, 120) if every == 30 else (5,):
        found, expected = html.train(pages, sample), trained(pages, sample)
        assert found.index == expected.index
        assert (found.weights == expected.weights).all() and (found.moves == expected.moves).all()


def test_training_parses_few_pages(spark, monkeypatch):
    parsed, blocks = spark.sparkContext.accumulator(0), html.blocks

    def counted(page):
        parsed.add(1)
        return blocks(page)

    pages = page_table(spark, 1)
    monkeypatch.setattr(html, "blocks", counted)
    html.train(pages, 5)
    assert 5 <= parsed.value < 400


def plain_blocks(page):
    """Text, elements and share of links of each block, by a slow walk over well-formed markup."""
    import re

    stack, out, text, linked = [], [], [], 0
    for tag, piece in re.findall(r"(<[^>]*>)|([^<]+)", page):
        if piece:
            text.append(piece)
            linked += len(piece) * any(t == "a" for t, _ in stack)
            continue
        name = re.match(r"</?(\w+)", tag)[1]
        if name in html.BLOCKS:
            if "".join(text).strip():
                whole = " ".join("".join(text).split())
                out.append((whole, tuple(t for t, _ in stack), frozenset(n for _, ns in stack for n in ns), linked / len(whole)))
            text, linked = [], 0
        if tag.startswith("</"):
            stack.pop()
        else:
            stack.append((name, {w for v in re.findall(r'(?:class|id)="([^"]*)"', tag) for w in v.lower().split()}))
    return out


def test_blocks_of_nested_elements_agree_with_a_slow_walk():
    rng = random.Random(3)

    def some(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["some text ", "more, of it. ", " ", "x"])
        name = rng.choice(["div", "section", "article", "nav", "b", "a", "i"])
        attributes = rng.choice(["", ' class="Main a"', ' id="side" class="b"', ' title="x > y"'.replace(">", "")])
        return f"<{name}{attributes}>{''.join(some(depth - 1) for _ in range(rng.randrange(4)))}</{name}>"

    for page in (f"<div>{some(7)}</div>" for _ in range(300)):
        assert [(b.text, b.tags, b.names, b.links) for b in html.blocks(page)] == plain_blocks(page)


def test_broken_tags_are_read_as_before():
    page = "<div a=\"x>y\" b='>'>One</div><ab\"c x=\"foo>two<p class=main id=\"n\">three<p x='open>four</p>five"
    found = [(b.text, b.tags, sorted(b.names)) for b in html.blocks(page)]
    assert found == [("One", ("div",), []), ("two", ("ab",), []), ("three", ("ab", "p"), ["main", "n"]), ("four", ("ab", "p"), []), ("five", ("ab",), [])]


def test_features_do_not_depend_on_the_order_of_a_set():
    words = [f"w{i}" for i in range(64)]
    names = [frozenset(words), frozenset(reversed(words)), frozenset([*words, *map(str, range(999))]) - set(map(str, range(999)))]
    for n in names:
        html.around.cache_clear()
        found = html.features(html.Block("Text, of, it.", ("div", "a"), n, 0.0), 0, 1)
        assert found == ["bias", "own:a", "words:2", "links:0", "place:0", "in:a", "in:div", *sorted(f"name:{w}" for w in words), "ends", "commas"]


def test_decoding_agrees_with_the_likeliest_labels_of_all():
    from itertools import product

    rng = random.Random(8)
    names = [f"f{i}" for i in range(12)]
    page = lambda: [rng.choices(names, k=rng.randrange(0, 5)) for _ in range(6)]
    field = html.Field()
    assert field.decode([]) == [] and field.decode([["f1"], []]) == [0, 0]
    field.train([(page(), rng.choices([0, 1], k=6)) for _ in range(40)], rounds=3)
    for rows in (page() + [["unseen", "f0", "f0"]] for _ in range(60)):
        single = field.scores([[field.index[f] for f in r if f in field.index] for r in rows])
        value = lambda y: sum(s[a] for s, a in zip(single, y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(product([0, 1], repeat=len(rows)), key=value)
        assert value(field.decode(rows)) == pytest.approx(value(best))
