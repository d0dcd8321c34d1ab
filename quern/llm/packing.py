"""Best-fit packing by minimum bin slack.

Pieces of equal length are interchangeable, so the search runs on the histogram of lengths, whose size
is bounded by the capacity and not by the data.  For each bin the longest length left is taken, then a
bitset subset-sum dynamic programme over the lengths still available finds the fullest combination that
fits beside it; that combination is removed as often as the histogram allows.  The plan (a few thousand
rows) is then applied to the pieces in parallel by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Work
from quern.llm.tokenizing import tokenizer

#: Pieces of one length are ranked in groups of about so many, so that no length is a single task.
RANK_GROUP = 50_000


def fullest(room: int, stock: dict[int, int]) -> dict[int, int]:
    """The multiset of ``stock`` lengths with the largest sum of at most ``room``; longer lengths first."""
    if room <= 0:
        return {}
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, n in stock.items() if n and x <= room), reverse=True):
        copies, part = min(stock[length], room // length), 1
        while copies:
            take = min(part, copies)
            more = (bits | (bits << (length * take))) & mask
            if more != bits:
                steps.append((length, take, bits))
                bits = more
            copies -= take
            part *= 2
        if bits >> room & 1:
            break
    at, chosen = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``[(bins, [(length, copies per bin), ...]), ...]`` that uses up the histogram."""
    stock = {int(x): int(n) for x, n in histogram.items() if n}
    plan = []
    while stock:
        longest = max(stock)
        if longest > capacity:
            raise ValueError(f"a piece of {longest} is longer than the capacity {capacity}")
        stock[longest] -= 1
        chosen = fullest(capacity - longest, stock)
        stock[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(stock[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            stock[x] -= bins * n
            if not stock[x]:
                del stock[x]
        plan.append((bins, sorted(chosen.items(), reverse=True)))
    return plan


def _intervals(plan) -> dict[int, tuple]:
    """Per length: rank starts, first bin, copies per bin and offset in the bin, as arrays."""
    found: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for bins, parts in plan:
        offset = 0
        for length, copies in parts:
            found.setdefault(length, []).append((used.get(length, 0), first, copies, offset))
            used[length] = used.get(length, 0) + bins * copies
            offset += length * copies
        first += bins
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for x, rows in found.items()}


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """Tokenize whole texts and cut those longer than ``capacity``: all pieces full but perhaps the first.

    A null text counts as empty (its only id is ``end_id``); a null id is kept as null.  Returns
    ``id, piece, start, length, ids_crc32`` and, with ``with_ids``, ``ids``.
    """
    id_type = docs.schema[id_col].dataType
    fields = [
        T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            keys, out = batch.column(0), [[] for _ in range(6)]
            for row, text in enumerate(batch.column(1)):
                ids = bpe.encode(text.as_py() or "")
                ids.append(end_id)
                n = len(ids)
                raw = memoryview(np.array(ids, dtype="<u4").tobytes())
                head = n % capacity or capacity
                start, piece = 0, 0
                while start < n:
                    stop = head if piece == 0 else start + capacity
                    values = (row, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop]))
                    for c, v in zip(out, values, strict=False):
                        c.append(v)
                    if with_ids:
                        out[5].append(ids[start:stop])
                    start, piece = stop, piece + 1
            columns = [
                keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()),
            ] + ([pa.array(out[5], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, T.StructType(fields))


def pack(cut: DataFrame, capacity: int, work: Work, order_by: tuple[str, ...]) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    ``order_by`` makes ranks repeatable; rows equal in all of it are interchangeable.  An empty table stays empty.
    """
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = _intervals(plan_bins(histogram, capacity))
    groups = {x: -(-n // RANK_GROUP) for x, n in histogram.items() if n > RANK_GROUP}
    salts = F.create_map(*[F.lit(v) for kv in groups.items() for v in kv])[F.col("length")] if groups else F.lit(1)
    salted = cut.withColumn(
        "_salt", F.pmod(F.xxhash64(*order_by), F.coalesce(salts, F.lit(1)).cast("long")).cast("int")
    )
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        salted.where(F.col("length").isin(*groups)).groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_head"))
    )
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order_by)) - 1
    ranked = salted.withColumn("_rank", rank)
    if groups:
        ranked = ranked.join(heads, ["length", "_salt"], "left")
    else:
        ranked = ranked.withColumn("_head", F.lit(0).cast("long"))
    names = cut.columns
    ranked = ranked.select(*names, (F.col("_rank") + F.coalesce("_head", F.lit(0))).cast("long").alias("_rank"))
    schema = T.StructType(
        [*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("length")
        for batch in batches:
            lengths, ranks = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            bins, offsets = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            values, starts = np.unique(lengths[order], return_index=True)
            for length, rows in zip(values, np.split(order, starts[1:]), strict=True):
                rank0, first, copies, offset = plan[int(length)]
                k = np.searchsorted(rank0, ranks[rows], "right") - 1
                done = ranks[rows] - rank0[k]
                bins[rows] = first[k] + done // copies[k]
                offsets[rows] = offset[k] + done % copies[k] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(bins), pa.array(offsets)], names=[*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """Tokenize, cut and pack whole documents: one row per piece with its place in a sequence."""
    work = Work(docs.sparkSession, "pack")
    cut = work.save(pieces(docs, vocabulary, capacity, id_col, text_col, end_id, with_ids), "pieces")
    return pack(cut, capacity, work, (id_col, "piece", "start", "ids_crc32"))
