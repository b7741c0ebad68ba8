"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A batch of changes (inserts, deletes, revised texts) turns into signed counts against what is
known of its documents, and only the additive totals of those are stored for the batch. A
batch is committed when the folder of its totals has its _SUCCESS file, and every read asks
for that: committing a batch again changes nothing, and what one that failed half-way left
behind counts nowhere and is written anew. Totals are sums over the committed batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.tokens import SegmentEncoder

KEYS = ["source", "lang", "version"]


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """All columns of ``docs`` but text, and ``tokens``; null and empty texts have none."""
    names = [c for c in docs.columns if c != "text"]
    schema = docs.select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("bigint").alias("tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SegmentEncoder.of_worker(tokenizer)
        for batch in batches:
            counts = [n for _, _, n in encoder.encode(batch.column("text"))]
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(counts)], [*names, "tokens"])

    return docs.mapInArrow(run, schema)


class TokenRollup:
    """Totals under the folder ``root``, which all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _exists(self, path: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def batches(self) -> list[int]:
        """Numbers of the committed batches, in order."""
        if not self._exists(f"{self.root}/deltas"):
            return []
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/deltas")
        names = [f.getPath().getName() for f in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)]
        numbers = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
        return sorted(n for n in numbers if self._exists(f"{self.root}/deltas/batch={n}/_SUCCESS"))

    def committed(self, batch: int) -> bool:
        return batch in self.batches()

    def _known(self, table: str) -> DataFrame:
        """Rows of the committed batches."""
        paths = [f"{self.root}/{table}/batch={n}" for n in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], {"deltas": "source string, lang string, version string, docs bigint, tokens bigint, batch int",
                                                   "changes": "doc_id bigint, version string, live boolean, source string, lang string, tokens bigint, batch int"}[table])
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*paths)

    def documents(self) -> DataFrame:
        """(doc_id, version, live, source, lang, tokens): the last committed word on every document."""
        state = F.struct("live", "source", "lang", "tokens")
        return self._known("changes").groupBy("doc_id", "version").agg(F.max_by(state, "batch").alias("s")).select("doc_id", "version", "s.*")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (doc_id, version, op, source, lang, tokens) as batch number ``batch``; False if it was there.

        ``op`` is insert, delete or revise; insert and revise both set the document's count,
        and deletes of unknown documents do nothing. Batch numbers rise; a new one at or below
        the last is an error. Of several changes of one document and version in a batch a delete
        wins, else the largest (source, lang, tokens) counts. An insert without doc_id is a
        document of its own that no later change can name; other changes without one do nothing.
        Null sources and languages are groups of their own.
        """
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        last = changes.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), "version").agg(
            F.min(F.col("op") != "delete").alias("live"),
            F.max(F.struct("source", "lang", F.col("tokens").cast("bigint").alias("tokens"))).alias("new"),
        ).select("doc_id", "version", "live", "new.*")
        last.write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch}")
        new = self.spark.read.parquet(f"{self.root}/changes/batch={batch}")
        old = self.documents().join(new.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
        signed = old.filter("live").select(*KEYS, F.lit(-1).alias("docs"), (-F.col("tokens")).alias("tokens")).unionByName(
            new.filter("live").select(*KEYS, F.lit(1).alias("docs"), "tokens"))
        nameless = changes.filter("doc_id IS NULL AND op = 'insert'").select(*KEYS, F.lit(1).alias("docs"), F.col("tokens").cast("bigint").alias("tokens"))
        signed = signed.unionByName(nameless)
        deltas = signed.groupBy(*KEYS).agg(F.sum("docs").cast("bigint").alias("docs"), F.sum("tokens").cast("bigint").alias("tokens"))
        # the totals' own _SUCCESS is the commit
        deltas.write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) of live documents; groups without any are left out."""
        sums = self._known("deltas").groupBy(*KEYS).agg(F.sum("docs").cast("bigint").alias("docs"), F.sum("tokens").cast("bigint").alias("tokens"))
        return sums.filter("docs <> 0")
