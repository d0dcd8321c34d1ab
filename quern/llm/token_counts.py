"""Delta-maintained token counts.

A ledger of signed deltas: an insert adds a document's tokens, a delete takes them away, a revision does
both.  Each batch is summed per (source, lang, tokenizer_version) and committed once under its batch id;
totals are sums of commits, so they never need the documents again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import shared_folder
from quern.llm.tokenizing import tokenizer

KEYS = ("source", "lang", "tokenizer_version")
TOTALS = T.StructType(
    [T.StructField(k, T.StringType()) for k in KEYS]
    + [T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())]
)


def count_tokens(docs: DataFrame, vocabulary: str, version: str, text_col: str = "text") -> DataFrame:
    """Token counts of whole texts: ``doc_id, source, lang, tokenizer_version, n_tokens``; a null text has 0."""
    schema = T.StructType([*docs.select("doc_id", "source", "lang").schema.fields, T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            sizes = [len(bpe.encode(x.as_py() or "")) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"]
            )

    counted = docs.select("doc_id", "source", "lang", F.col(text_col)).mapInArrow(count, schema)
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents counted anew (another text, source, language or tokenizer version): old counts go, new ones come."""
    return deletes(old).unionByName(inserts(new))


class TokenLedger:
    """Committed deltas under one folder that all executors share.

    ``commit`` is idempotent: a batch is first written beside the ledger and then renamed into place, which
    either happens whole or not at all; a batch id that is already there is left alone, whatever it now holds.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{shared_folder(spark)}/token-ledger").rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._path("/".join([self.path, *parts]))

    def has(self, batch_id: str) -> bool:
        return self._fs.exists(self._at("batches", batch_id))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch of signed deltas; False if this batch id was committed before."""
        if not batch_id or any(not (c.isalnum() or c in "-.") for c in batch_id):
            raise ValueError(f"a batch id has letters, digits, '-' and '.': {batch_id!r}")
        if self.has(batch_id):
            return False
        self._fs.mkdirs(self._at("batches"))
        staged = self._at("staging", batch_id)
        summed = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.where("n_docs <> 0 or n_tokens <> 0").coalesce(1).write.mode("overwrite").parquet(str(staged.toString()))
        if not self._fs.rename(staged, self._at("batches", batch_id)):
            raise RuntimeError(f"batch {batch_id} could not be put in place")
        return True

    def totals(self) -> DataFrame:
        """Additive totals of all commits; groups that came to nothing are left out."""
        if not self._fs.exists(self._at("batches")):
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(f"{self.path}/batches/*")
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")
