"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Li and Li, "C-MinHash: Rigorously Reducing K Permutations to Two" (ICML 2022): a first permutation scatters
the shingles, a second one, circularly shifted k times, gives signature coordinate k.  Both are bijections of
the 32-bit numbers.  Documents with equal shingle sets are one node.

Nodes that share a band are a bucket, and buckets with the same smallest node (their head) are a group.  Full sets of a
group meet in tasks of bounded size, where an inverted index decides pairs exactly.  Only links that hold are joined
into components; candidates are never chained.  Within a task, documents that the largest component has taken up are
not compared with each other, so a group of near copies takes about as many comparisons as it has documents.  A group
over several blocks meets its head in each; then those of its members that are outside of its largest component meet
all others.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Work, checked_broadcast, shuffle_partitions
from quern.llm.components import components

#: A pair at the threshold shares no band with at most this probability.
MISS = 1e-5
#: A group's sets are dealt into blocks of about so many shingles and documents.
BLOCK_SHINGLES, BLOCK_DOCS = 1_500_000, 2_000


def bands_for(threshold: float, rows: int, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; one for all words if there are fewer; empty without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    mixed = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _mix32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit numbers, in place (xorshift-multiply rounds with odd factors)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(documents, n) minima of the shifted second permutation; all sets must be non-empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    first = _mix32((flat ^ (flat >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((len(sets), n), np.uint32)
    step = (1 << 32) // n
    for k in range(n):
        out[:, k] = np.minimum.reduceat(_mix32(first - np.uint32(k * step), 0x21F0AAAD, 0x735A2D97), starts)
    return out


def _features(docs: DataFrame, size: int, rows: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """``doc, n_shingles, set_key, bands``: a digest of the set and a hash per band (both null for an empty set)."""
    schema = T.StructType([
        T.StructField("doc", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(rows)], np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(x.as_py() or "", size) for x in part.column(1)]
                full = [s for s in sets if len(s)]
                found = iter(())
                if full:
                    sig = signatures(full, rows * bands).reshape(len(full), bands, rows).astype(np.uint64)
                    mixed = ((sig + np.uint64(1)) * factors).sum(axis=2, dtype=np.uint64)
                    mixed ^= mixed >> np.uint64(31)
                    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + np.arange(bands, dtype=np.uint64)
                    found = iter(mixed.view(np.int64).tolist())
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                        pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=schema.names,
                )

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col)).mapInArrow(work, schema)


class _Index:
    """An inverted index of sets, which counts what one set shares with each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        values, self.owner = flat[order], owner[order]
        self.starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        self.values, self.lengths = values[self.starts], np.diff(np.append(self.starts, len(values)))

    def similar(self, one: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets with 100 |A & B| >= percent |A | B|."""
        at = np.minimum(np.searchsorted(self.values, one), len(self.values) - 1)
        at = at[self.values[at] == one]
        if 100 * len(at) < percent * len(one):
            return at[:0]  # too few of its shingles occur here
        take = self.lengths[at]
        spots = np.repeat(self.starts[at] - np.cumsum(take) + take, take) + np.arange(take.sum())
        both = np.bincount(self.owner[spots], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (len(one) + self.sizes - both))


class _Forest:
    """Components of what is linked so far, their sizes and the links that joined them."""

    def __init__(self, n: int):
        self.at, self.size, self.largest, self.links = list(range(n)), [1] * n, None, []

    def find(self, x: int) -> int:
        while self.at[x] != x:
            self.at[x] = self.at[self.at[x]]
            x = self.at[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.at[b] = a
            self.size[a] += self.size[b]
            self.links.append((x, y))
            if self.largest is None or self.size[a] > self.size[self.find(self.largest)]:
                self.largest = a

    def in_largest(self, x: int) -> bool:
        return self.largest is not None and self.find(x) == self.find(self.largest)


def linked(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 |A & B| >= percent |A | B|.

    Every document outside of the largest component in the end was compared with all; documents inside are joined
    already.  So no link is overlooked that joins components.
    """
    index, forest = _Index(sets), _Forest(len(sets))
    todo, passed = deque(range(len(sets))), []
    while todo:
        i = todo.popleft()
        if forest.in_largest(i):
            passed.append(i)
        else:
            for j in index.similar(sets[i], percent).tolist():
                forest.join(i, j)
        if not todo:  # another component may have become the largest
            todo.extend(i for i in passed if not forest.in_largest(i))
            passed = []
    return [(int(ids[i]), int(ids[j])) for i, j in forest.links]


def linked_between(ids: np.ndarray, sets: list[np.ndarray], asked: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of the documents numbered ``asked`` with all."""
    index, forest = _Index(sets), _Forest(len(sets))
    for i in asked.tolist():
        for j in index.similar(sets[i], percent).tolist():
            forest.join(i, j)
    return [(int(ids[i]), int(ids[j])) for i, j in forest.links]


def _groups(nodes: DataFrame, work: Work) -> DataFrame:
    """``grp, node`` of nodes that share a band with another, by the smallest node of the band; the head is in its group."""
    bands = nodes.select("node", F.explode("bands").alias("band"))
    heads = bands.groupBy("band").agg(F.min("node").alias("grp"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "grp")
    return work.save(bands.join(heads, "band").select("grp", "node").distinct(), "groups")


def _blocks(shingles: Column, members: Column) -> Column:
    return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(members / BLOCK_DOCS), F.lit(1)).cast("int")


def _with_sets(docs: DataFrame, nodes: DataFrame, placed: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """Links ``u, v`` found where sets meet.

    ``placed`` has ``node``, and in ``at`` (part, asked) for each task that its set goes to.  Tasks without asked
    documents compare all with all; in others the asked ones are compared with all.
    """
    dealt = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("node", T.LongType()), T.StructField("asked", T.BooleanType()),
        T.StructField("shingles", T.BinaryType()),
    ])
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in kinds]
            for text, node, key, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = shingle_set(text or "", size).tobytes()
                if xxhash.xxh3_128_digest(raw) != key:
                    continue  # another text under the same id
                for place in at:
                    for column, x in zip(out, (place["part"], node, place["asked"], raw), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=dealt.names)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            sets = {node: raw for node, _, raw in rows}  # repeated documents
            if len(sets) < 2:
                return []
            ids, found = np.array(list(sets)), [np.frombuffer(x, np.uint64) for x in sets.values()]
            asked = {node for node, is_asked, _ in rows if is_asked}
            if asked:
                return linked_between(ids, found, np.flatnonzero([k in asked for k in sets]), percent)
            return linked(ids, found, percent)

        def links(out):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

        at, rows, out = None, [], []
        for batch in batches:
            for part, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part != at:
                    out += flush(rows)
                    at, rows = part, []
                rows.append(row)
            if len(out) > 10_000:
                yield links(out)
                out = []
        yield links(out + flush(rows))

    chosen = placed.join(nodes.select("node", "doc", "set_key"), "node")
    texts = docs.join(checked_broadcast(chosen), "doc").select("text", "node", "set_key", "at")
    return texts.mapInArrow(deal, dealt).repartition(parts, "part").sortWithinPartitions("part", "node").mapInArrow(verify, "u long, v long")


def _named(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """``node, component`` of all nodes."""
    return nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 6, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row ``id, n_shingles, component_id, kept``; ids are integers.

    Documents whose sets of ``size``-word shingles satisfy 100 |A & B| >= ``percent`` |A | B| are linked, and a
    component is named by its smallest id.  Null or without words, a text has no shingles and no link.  Rows with a null
    id are returned with null component and ``kept`` false; rows that share an id are in one component, whatever their
    texts, and each is returned.  Only the two columns are read; others may have any name.
    """
    spark = docs.sparkSession
    work, parts = Work(spark, "minhash"), max(1, shuffle_partitions(docs))
    bands = bands_for(percent / 100, rows)
    found = work.save(_features(docs, size, rows, bands, id_col, text_col), "features")
    named = found.where("doc is not null and set_key is not null")
    # equal sets are one node, under the smallest id that holds them
    nodes = named.groupBy("set_key").agg(F.min("doc").alias("doc"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    nodes = work.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    groups = _groups(nodes, work)
    sized = groups.join(nodes.select("node", "n"), "node")
    totals = work.save(sized.groupBy("grp").agg(_blocks(F.sum("n"), F.count(F.lit(1))).alias("blocks")), "totals")
    large = work.save(totals.where("blocks > 1"), "large")
    placed = groups.join(checked_broadcast(large), "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    part = lambda *x: F.shiftrightunsigned(F.xxhash64(*x), 1)
    seats = placed.select("node", F.col("grp"), F.explode(F.when(F.col("node") == F.col("grp"), every).otherwise(own)).alias("b"))
    seats = seats.groupBy("node").agg(F.collect_list(F.struct(part("grp", "b").alias("part"), F.lit(False).alias("asked"))).alias("at"))
    links = work.save(_with_sets(texts, nodes, work.save(seats, "seats"), size, percent, parts), "links")
    # sets under one id
    both = named.groupBy("doc").agg(F.min("set_key").alias("one"), F.max("set_key").alias("two")).where("one <> two").select("doc")
    several = work.save(named.join(checked_broadcast(work.save(both, "both")), "doc").select("doc", "set_key").join(nodes.select("set_key", "node"), "set_key"), "several")
    same = several.join(several.groupBy("doc").agg(F.min("node").alias("u")), "doc").select("u", F.col("node").alias("v"))
    links = links.unionByName(same)
    joined = components(links, work, "links_cc")

    if large.count():
        rest = _outside(groups.join(checked_broadcast(large), "grp"), _named(nodes.select("node", "n"), _whole(joined)), work)
        if rest is not None:
            more = work.save(_with_sets(texts, nodes, work.save(rest, "rest"), size, percent, parts), "more")
            joined = components(links.unionByName(more), work, "more_cc")

    least = _whole(joined).join(nodes.select("node", "doc", "set_key"), "node")
    least = least.join(least.groupBy("component").agg(F.min("doc").alias("least")), "component").select("set_key", "least")
    facts = nodes.select("set_key", "doc").join(least, "set_key", "left").select("set_key", F.coalesce("least", "doc").alias("component_id"))
    whole = found.join(work.save(facts, "facts"), "set_key", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return whole.select(
        F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept"),
    )


def _whole(joined: DataFrame) -> DataFrame:
    """``node, component`` with the smallest nodes, too, which ``components`` leaves out."""
    return joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct())


def _outside(members: DataFrame, named: DataFrame, work: Work) -> DataFrame | None:
    """Where the members of large groups meet those outside of their group's largest component; None if there are none."""
    of = work.save(members.join(named, "node"), "members")
    counts = of.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = counts.groupBy("grp").agg(F.max_by("component", F.struct("k", "component")).alias("most"))
    outside = of.join(checked_broadcast(largest), "grp").where("component <> most")
    queries = work.save(outside.groupBy("grp").agg(_blocks(F.sum("n"), F.count(F.lit(1))).alias("asks")), "queries")
    if not queries.count():
        return None
    seat = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("node")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = outside.join(checked_broadcast(queries), "grp").select("node", "grp", seat("asks", 1).alias("q"), every("blocks").alias("b"), F.lit(True).alias("asked"))
    asked = of.join(checked_broadcast(queries), "grp").select("node", "grp", every("asks").alias("q"), seat("blocks", 2).alias("b"), F.lit(False).alias("asked"))
    place = F.struct(F.shiftrightunsigned(F.xxhash64("grp", "q", "b"), 1).alias("part"), "asked")
    return asking.unionByName(asked).groupBy("node").agg(F.collect_list(place).alias("at"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; rows without an id are kept, and so are repeated rows."""
    work = Work(docs.sparkSession, "minhash")
    judged = near_duplicates(docs, id_col=id_col, **options).where(F.col(id_col).isNotNull() & ~F.col("kept"))
    gone = work.save(judged.select(F.col(id_col).alias("_gone")).distinct(), "gone")
    return docs.join(checked_broadcast(gone), docs[id_col] == gone["_gone"], "left_anti")
