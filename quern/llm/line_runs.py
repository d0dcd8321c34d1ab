"""Line dedup with levelled sorted runs of line hashes.

A run is a table of line keys (128-bit hashes), bucketed and sorted by key, each with the number of documents that hold
it and the largest of their ids.  Each batch of documents is merge-anti-joined with the runs: keys that they hold in
enough documents already, with an id as large, add nothing; the others become the batch's own run.  When a level has
``fan_out`` runs they are merged, bucket by bucket and without a shuffle, into one run of the next level, so a key is
rewritten a logarithmic number of times.  A manifest names the runs, so later batches can go on from it.

As the last document keeps a line, batches are taken from the largest ids down: the first run that has a key has its
last document, and hot keys are settled by the first batches.  Only whether a key ends up in enough documents waits for
the last batch; then the narrow table of line hashes, not the texts, meets the shared keys.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import BLANKS, Work, checked_broadcast, lower_ascii, shuffle_partitions

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int, *more: str) -> DataFrame:
    """``doc, text_hash, pos, h1, h2``, and ``more``, of every line whose key has ``least_chars`` code points."""
    lines = docs.select(
        *more,
        F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"),
        F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"),
    )
    keyed = lines.where(F.length("line") >= least_chars).withColumn("key", line_key(F.col("line")))
    return keyed.where(F.length("key") >= least_chars).select(
        "doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), *more
    )


class LineRuns:
    """The runs of one collection, under a folder that all executors share.

    A folder that holds a manifest is opened where it was left.  ``enough``: keys held in so many documents count no
    further (None: all are counted).
    """

    def __init__(self, spark: SparkSession, path: str, fan_out: int = 2, enough: int | None = None, buckets: int | None = None):
        self.spark, self.path, self.enough = spark, path.rstrip("/"), enough
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._tag, self._tables = uuid.uuid4().hex[:12], {}
        self.state = {"made": 0, "fan_out": fan_out, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "levels": []}
        found = self._fs.globStatus(self._path(f"{self.path}/manifest-*")) or []
        if len(found):  # the last one that was written whole; run names never repeat
            last = max(str(x.getPath().toString()) for x in found)
            self.state = json.loads(spark.read.text(last, wholetext=True).first()[0])

    @property
    def levels(self) -> list[list[str]]:
        return self.state["levels"]

    def _commit(self) -> None:
        at = f"{self.path}/manifest-{self.state['made']:08d}"
        out = self._fs.create(self._path(f"{self.path}/_new"), True)
        out.writeBytes(json.dumps(self.state))
        out.close()
        if not self._fs.rename(self._path(f"{self.path}/_new"), self._path(at)):
            raise RuntimeError(f"the manifest could not be put in place: {at}")

    def _table(self, name: str) -> DataFrame:
        """A run as a bucketed table, so that merges and joins need no shuffle of it."""
        if name not in self._tables:
            table, keys = f"line_{name}_{self._tag}", ", ".join(KEY)
            self.spark.sql(
                f"CREATE TABLE {table} ({self._schema}) USING parquet"
                f" CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{name}'"
            )
            self._tables[name] = table
        return self.spark.table(self._tables[name])

    @property
    def _schema(self) -> str:
        return f"h1 bigint, h2 bigint, n_docs bigint, last_doc {self.state['id_type']}"

    def _write(self, run: DataFrame) -> str:
        self.state["made"] += 1
        self.state["id_type"] = run.schema["last_doc"].dataType.simpleString()
        name = f"run_{self.state['made']:08d}"
        table = f"line_{name}_{self._tag}"
        run.write.format("parquet").bucketBy(self.state["buckets"], *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(table)
        self._tables[name] = table
        return name

    def _put(self, run: DataFrame) -> None:
        levels, level, gone = self.levels, 0, []
        name = self._write(run)
        while True:
            while len(levels) <= level:
                levels.append([])
            levels[level].append(name)
            if len(levels[level]) < self.state["fan_out"]:
                break
            old, levels[level] = levels[level], []
            gone += old
            name, level = self._write(self._merged(old)), level + 1
        self._commit()
        for old in gone:
            if old in self._tables:
                self.spark.sql(f"DROP TABLE {self._tables.pop(old)}")
            self._fs.delete(self._path(f"{self.path}/{old}"), True)

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged by full outer joins, bucket by bucket; of two runs, nothing is shuffled."""
        merged = self._table(names[0])
        for name in names[1:]:
            one, two = merged.alias("one"), self._table(name).alias("two")
            n = lambda side: F.coalesce(F.col(f"{side}.n_docs"), F.lit(0))
            merged = one.join(two, KEY, "full_outer").select(
                *KEY, (n("one") + n("two")).alias("n_docs"), F.greatest("one.last_doc", "two.last_doc").alias("last_doc")
            )
        return merged

    def merged(self) -> DataFrame:
        """``h1, h2, n_docs, last_doc`` of all runs."""
        # read without their buckets: Spark 4.1 sums a union of bucketed tables by table
        runs = [self.spark.read.schema(self._schema).parquet(f"{self.path}/{name}") for level in self.levels for name in level]
        everything = runs[0]
        for run in runs[1:]:
            everything = everything.unionByName(run)
        return everything.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of ``h1, h2, last_doc``, and more, but those whose key the runs hold in enough documents, up to an id as large."""
        names = [name for level in self.levels for name in level]
        if not names or self.enough is None:
            return keys
        met = keys
        for k, name in enumerate(names):
            run = self._table(name).select(*KEY, F.col("n_docs").alias(f"_n{k}"), F.col("last_doc").alias(f"_last{k}"))
            met = met.join(run, KEY, "left")
        held = sum((F.coalesce(f"_n{k}", F.lit(0)) for k in range(len(names))), F.lit(0))
        last = F.array_max(F.array(*[f"_last{k}" for k in range(len(names))]))
        settled = F.coalesce((held >= self.enough) & (last >= F.col("last_doc")), F.lit(False))
        return met.where(~settled).select(*keys.columns)

    def add(self, lines: DataFrame) -> None:
        """Add the run of a batch; no document may be in two batches.  Rows without an id belong to no document."""
        per_doc = lines.where("doc is not null").select(*KEY, "doc").distinct()
        self._put(self.unseen(per_doc.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))))

    def close(self) -> None:
        """Forget the tables' names; files stay."""
        for table in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables = {}


def _batch_of(docs: DataFrame, batches: int) -> Column:
    """Number of a row's batch: ranges of ids, largest first, about equal; of other ids than numbers, by hash."""
    if not isinstance(docs.schema["doc"].dataType, T.NumericType):
        return F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")
    cuts = docs.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)] or [0.5], 10_000).alias("q")).first()["q"] or []
    return sum((F.when(F.col("doc") <= F.lit(q), 1).otherwise(0) for q in (cuts if batches > 1 else [])), F.lit(0)).cast("int")


def dedup_lines(
    docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 4, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with shared lines removed from ``text``, and ``_n_lines`` (before), ``_n_dropped``.

    A key of at least ``least_chars`` code points found in ``least_docs`` documents loses all its lines but
    those of the largest id that holds it.  A null or empty text is one empty line; rows without an id keep
    their lines; rows that share an id are one document, and repeated rows come back as often.  Other columns pass
    through, but for those named as the two that are added, which give way.  An empty table stays empty.
    """
    work = Work(docs.sparkSession, "lines")
    given = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    numbered = given.withColumn("batch", _batch_of(given, batches))
    lines = work.save(keyed_lines(numbered, "doc", "text", least_chars, "batch"), "keyed", by="batch")
    runs = LineRuns(docs.sparkSession, f"{work.path}/runs", enough=least_docs, buckets=shuffle_partitions(docs))
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    shared = work.save(runs.merged().where(F.col("n_docs") >= least_docs).select(*KEY, "last_doc"), "shared")
    runs.close()
    dropped = lines.join(checked_broadcast(shared), KEY).where("doc < last_doc")
    dropped = dropped.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("drop"))
    # the row travels as one column, so that its names clash with nothing
    row = F.struct(*[docs[c] for c in docs.columns])
    keyed = docs.select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"), row.alias("row"))
    joined = keyed.join(dropped, ["doc", "text_hash"], "left").withColumn("lines", split_lines(F.col("text")))
    kept = F.when(F.col("drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop"), lambda i: F.get("lines", i)), "\n")
    )
    n_dropped = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop"))
    names = [kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("_n_lines", "_n_dropped")]
    return joined.select(*names, F.size("lines").cast("long").alias("_n_lines"), n_dropped.cast("long").alias("_n_dropped"))
