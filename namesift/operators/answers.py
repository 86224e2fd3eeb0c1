"""Where answers are kept between runs: a parquet folder, or a bucketed table for caches that grow large."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_SCHEMA = "key string, answer string, attempts int, prompt string, backend string, model string"


class AnswerCache(Protocol):
    """Kept answers by key: read them, and add some. ``read`` gives None while there are none."""

    def read(self, spark: SparkSession) -> DataFrame | None: ...

    def append(self, answers: DataFrame) -> None: ...


@dataclass(frozen=True)
class FolderCache:
    """A parquet folder by backend and model; only the folders a reader selects are read."""

    path: str

    def read(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        except AnalysisException:
            return None

    def append(self, answers: DataFrame) -> None:
        answers.write.mode("append").partitionBy("backend", "model").parquet(self.path)


@dataclass(frozen=True)
class BucketedCache:
    """Catalog tables whose rows are dealt into ``buckets`` by key, so joining by key moves the prompts and never the cache.

    The cache is the newest generation ``<name>__g<number>`` that is marked ready. Answers are appended to it as more
    files of each bucket. ``compact`` writes the next generation, with one answer per key and one file per bucket, and marks it
    ready as its last step; a run that is lost before leaves a generation nobody reads. Answers appended to the old generation
    meanwhile are not taken over, and asked again when needed. Old generations are kept until they are dropped by hand.
    """

    name: str
    buckets: int = 64

    def _generations(self, spark: SparkSession) -> list[int]:
        start = f"{self.name}__g"
        numbers = [t.name.removeprefix(start) for t in spark.catalog.listTables() if t.name.startswith(start)]
        return sorted(int(n) for n in numbers if n.isdigit())

    def _ready(self, spark: SparkSession, number: int) -> bool:
        rows = spark.sql(f"SHOW TBLPROPERTIES {self.name}__g{number}").collect()
        return any(r["key"] == "answers.ready" and r["value"] == "true" for r in rows)

    def table(self, spark: SparkSession) -> str | None:
        """The generation that is read, or None."""
        found = [n for n in self._generations(spark) if self._ready(spark, n)]
        return f"{self.name}__g{found[-1]}" if found else None

    def read(self, spark: SparkSession) -> DataFrame | None:
        table = self.table(spark)
        return None if table is None else spark.table(table)

    def _write(self, answers: DataFrame, table: str, mode: str) -> None:
        columns = [c.split(" ")[0] for c in CACHE_SCHEMA.split(", ")]
        dealt = answers.select(*columns).repartition(self.buckets, "key")
        dealt.write.format("parquet").mode(mode).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(table)

    def _publish(self, answers: DataFrame) -> str:
        spark = answers.sparkSession
        table = f"{self.name}__g{max(self._generations(spark), default=0) + 1}"
        self._write(answers, table, "errorifexists")
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('answers.ready' = 'true')")
        return table

    def append(self, answers: DataFrame) -> None:
        table = self.table(answers.sparkSession)
        if table is None:
            self._publish(answers)
        else:
            self._write(answers, table, "append")

    def compact(self, spark: SparkSession) -> str | None:
        """Write the next generation with one answer per key, of any backend and model, and return its table.

        The smallest answer of a key stays, as for readers; failed attempts are dropped. The rows already lie by
        bucket, so they are aggregated where they are.
        """
        kept = self.read(spark)
        if kept is None:
            return None
        rest = F.min(F.struct("answer", "attempts", "prompt")).alias("a")
        one = kept.filter("answer is not null").groupBy("key", "backend", "model").agg(rest)
        return self._publish(one.select("key", "a.*", "backend", "model"))


def new_name() -> str:
    return f"answers_{uuid.uuid4().hex}"
