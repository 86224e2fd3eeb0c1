import pytest
from pyspark.sql import types as T

TEXTS = {
    1: "The quick brown fox jumps over the lazy dog while a small cat sleeps near the warm fire all day long.",
    2: "Another text about rivers and mountains. It has two sentences and says nothing of foxes at all.",
    3: "",
    4: None,
    5: "word",
    6: "Ünïcode wörds überall, 你好 世界 und mehr davon in diesem Satz.\nZweite Zeile mit Ende.",
}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, blank and long texts, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i * i % 9973}" for i in range(30_000)) + "."
    rows = [(i, t, "en", f"src{i % 3}") for i, t in TEXTS.items()]
    rows += [(7, long, "en", "src0"), (7, long, "en", "src0"), (1, TEXTS[1], "en", "src1")]
    rows += [(None, TEXTS[2], None, None), (None, None, None, None), (8, TEXTS[1], "de", None), (9, " \n\t ", "en", "src1")]
    names = ["row", "doc", "score", "key", "n", "block", "shard", "kept", "_row", "at", "order"]
    fields = [T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source")]]
    fields += [T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in names]]
    return spark.createDataFrame([(*r, len(r[1] or ""), *names) for r in rows], T.StructType(fields))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
