"""Registered queries against their SQL, and the rest against brute force on whole small tables."""

import hashlib
import re
import zlib

import pytest
import xxhash

import __spark_entry__ as entry
from namesift.llm import queries as llm
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_all_are_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_agrees_with_sql(spark, name):
    found = difference(llm.QUERIES[name](spark, SF_DIR), connect(SF_DIR), llm.ORACLES[name])
    assert found is None, found


def test_simhash_components(spark, docs):
    prints = {}
    for i, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    part = {i: i for i in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((part[a], part[b]))
                part = {k: low if v == high else v for k, v in part.items()}
    rows = llm.QUERIES["op10_simhash_near_dedup"](spark, SF_DIR).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", part[i]) for i in docs}
    assert len(rows) == len(docs)


def test_repeated_passages(spark, docs):
    seen, expected = set(), {}
    for i, text in sorted(docs.items()):
        data = text.encode()
        gone = bytearray(len(data))
        own = [data[k : k + 50] for k in range(len(data) - 49)]
        for k, s in enumerate(own):
            if s in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        expected[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    rows = llm.QUERIES["op4_repeated_passages"](spark, SF_DIR).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == expected
    assert any(e[1] for e in expected.values())


def test_license_scan(spark, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    rows = {r["doc_id"]: r for r in llm.QUERIES["op5_license_scan"](spark, SF_DIR).collect()}
    assert len(rows) == len(docs)
    for i, text in docs.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        found = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(found))
        places = [k for k, _ in found]
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in found}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert any(r["base_labels"] for r in rows.values())


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = llm.QUERIES["op3_toxicity"](spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.97 * len(held)
    bad = [r for r in held if labels[r["doc_id"]]]
    assert sum(r["predicted"] for r in bad) >= 0.9 * len(bad)


def test_html_text_is_the_article(spark):
    rows = llm.QUERIES["op2_html_extraction"](spark, SF_DIR)
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    import html

    for r in rows.collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S).group(1)
        blocks = re.split(r"</?(?:p|h1|li|div)>", article)
        texts = [" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks]
        assert r["text"] == "\n".join(t for t in texts if t)
        assert r["n_chars"] == len(r["text"])


def test_decontamination_finds_whole_items(spark, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    rows = llm.QUERIES["op1_decontamination"](spark, SF_DIR).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    words = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))) + " "
    whole = {(i, k) for i, text in docs.items() for k, item in items.items() if words(item) in words(text)}
    assert whole and whole <= found
    assert all(r["coverage"] >= 0.5 for r in rows)


def test_pipeline_keeps_whole_rows(spark, docs):
    rows = entry.queries()["pipeline"](spark, SF_DIR)
    kept = {r["doc_id"] for r in rows.collect()}
    assert len(kept) == rows.count() and kept < set(docs)
    contaminated = {r["doc_id"] for r in llm.QUERIES["op1_decontamination"](spark, SF_DIR).collect()}
    toxic = {r["doc_id"] for r in llm.QUERIES["op3_toxicity"](spark, SF_DIR).collect() if r["predicted"]}
    assert not kept & contaminated and not kept & toxic
    texts = [docs[i] for i in kept]
    assert len(set(texts)) == len(texts)
