"""Exact substring dedup: bytes of 50-byte strings that an earlier document also holds are removed.

The sorted order of suffixes is built column by column (Bauer, Cox and Rosone, "Lightweight algorithms for
constructing and inverting the BWT of string collections", TCS 2013; common prefixes as in Cox, Garofalo, Rosone
and Sciortino, JDA 2016): in each round every string of a collection gets one more symbol at its front, which is
inserted into the collection's Burrows-Wheeler transform, and common prefixes follow by range minima over those of
the round before.

On whole texts, rounds would be as many as the longest document has bytes, and every round would pass over
everything so far.  A filter that loses no match comes first: every 50-byte string has an anchor, the 20-byte string
in it with the least hash; equal strings have equal anchors at equal places.  Strings whose anchor no other document
has are unique.  The others are sent, as runs that share an anchor, to the hash range of the anchor.  The runs of a
range are a collection of strings of 50 to 80 bytes, written under each other with their anchors in the same columns.
Only suffixes that start in one column can then begin with equal 50-byte strings, so the transform is kept by column
(the positional form, Durbin, Bioinformatics 2014): a round reads the block of the column after it once and in
sequence, and writes its own.  Blocks are arrays in memory, bounded by a range, because workers share no scratch files.
Runs of very frequent anchors are cut into single 50-byte strings that go by their own hash, so that no anchor is one
task; they are built in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Work, release_memory, seat, shuffle_partitions

ANCHOR = 20
#: Bytes of text in a block (a longer document is a block of its own), and in one step within it.
BLOCK_BYTES, STEP_BYTES = 4_000_000, 120_000
#: Runs of anchors with more occurrences than this go as single strings, by their own hash.
HOT = 20_000
#: Hash ranges per task; blocks per task at least, so that a range is bounded however much there is.
RANGES, TASK_BLOCKS = 6, 64
_LAST = np.iinfo(np.int64).max

ROW = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("what", T.IntegerType()), T.StructField("part", T.IntegerType()),
    T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("c", T.BinaryType()), T.StructField("d", T.BinaryType()),
])
_KINDS = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
#: Values of ``what``: blocks of texts, whether their anchors are shared, whether earlier documents hold their strings.
TEXTS, FLAGS, EARLIER = range(3)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS, strict=True)], names=ROW.names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(k)[i].as_py() for k in range(len(_KINDS)))


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _runs(rows: Iterator[tuple], key: int) -> Iterator[list[tuple]]:
    """Neighbouring rows with the same value at ``key``."""
    run: list[tuple] = []
    for row in rows:
        if run and run[0][key] != row[key]:
            yield run
            run = []
            release_memory()
        run.append(row)
    if run:
        yield run


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents' ids (a: ids, b: which are null), sizes (c) and compressed bytes (d), by blocks."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def flush():
            nonlocal made, ids, texts, size
            made += 1
            row = (
                base + made, TEXTS, 0, np.array([_LAST if i is None else i for i in ids], "<i8").tobytes(),
                np.array([i is None for i in ids]).tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), _zip(b"".join(texts)),
            )
            ids, texts, size = [], [], 0
            return _batch([row])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(key.as_py())
                texts.append(data)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return docs.mapInArrow(gather, ROW)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all ``size``-byte strings, by doubling."""
    factor, step, h = 0x9E3779B97F4A7C15, 1, b.astype(np.uint64) + np.uint64(1)
    power, out, done = factor, None, 0
    bits = size
    while True:
        if bits & 1:
            if out is None:
                out, done = h, step
            else:
                n = len(h) - done
                out = out[:n] * np.uint64(power) + h[done : done + n]
                done += step
        bits >>= 1
        if not bits:
            break
        h = h[:-step] * np.uint64(power) + h[step:]
        power, step = power * power % (1 << 64), step * 2
    return _spread(out[: len(b) - size + 1])


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of equally long rows of bytes."""
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = h * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1)
    return _spread(h)


def _covered(first: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Which columns strings cover that start in column ``first``."""
    columns = np.arange(width)
    return (columns >= first[:, None]) & (columns < (first + sizes)[:, None])


class _Strings:
    """Strings under each other: bytes by column (0 where there are none), first column, places, smallest id, key."""

    def __init__(self, rows: np.ndarray, first: np.ndarray, count: np.ndarray, least: np.ndarray, key: np.ndarray | None = None):
        self.rows, self.first, self.count, self.least, self.key = rows, first, count, least, key

    def cut(self, part: slice, size: int) -> tuple[bytes, ...]:
        rows, first, count = self.rows[part], self.first[part], self.count[part]
        flat = rows[_covered(first, count + size - 1, rows.shape[1])]
        return np.column_stack((first, count)).astype(np.uint8).tobytes(), self.least[part].astype("<i8").tobytes(), _zip(flat.tobytes())

    @classmethod
    def joined(cls, cuts: list[tuple[bytes, ...]], size: int) -> _Strings:
        first, count = np.concatenate([np.frombuffer(c[0], np.uint8) for c in cuts]).reshape(-1, 2).T.astype(np.int64)
        width = 2 * size - ANCHOR
        rows = np.zeros((len(first), width), np.uint8)
        rows[_covered(first, count + size - 1, width)] = np.frombuffer(b"".join(_unzip(c[2]) for c in cuts), np.uint8)
        return cls(rows, first, count, np.concatenate([np.frombuffer(c[1], "<i8") for c in cuts]))


class _Block:
    def __init__(self, row: tuple):
        self.ids, self.null = np.frombuffer(row[3], "<i8"), np.frombuffer(row[4], bool)
        self.sizes, self.data = np.frombuffer(row[5], "<i8"), _unzip(row[6])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def occurrences(self, size: int) -> tuple[np.ndarray, ...]:
        """Runs of ``size``-byte strings with one anchor: first start, strings, document, the anchor's hash and start."""
        span = size - ANCHOR + 1
        found, first, n = [], 0, len(self.sizes)
        while first < n:
            last, total = first, 0
            while last < n and (last == first or total + self.sizes[last] <= STEP_BYTES):
                total += self.sizes[last]
                last += 1
            low, high = int(self.starts[first]), int(self.starts[last - 1] + self.sizes[last - 1])
            # a very long document goes in overlapping steps
            for at in range(low, max(high - size, low) + 1, STEP_BYTES):
                found.append(self._step(at, min(at + STEP_BYTES + size - 1, high), size, span))
            first = last
        return tuple(np.concatenate(c) for c in zip(*[f for f in found if f], strict=True)) if any(found) else (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, np.int64))

    def _step(self, low: int, high: int, size: int, span: int):
        if high - low < size:
            return None
        b = np.frombuffer(self.data, np.uint8, high - low, low)
        h = _gram_hashes(b, ANCHOR)
        low_bits = np.uint64(20)
        order = (h >> low_bits << low_bits) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            order = np.minimum(order[:-width], order[width:])
            width *= 2
        rest = span - width
        order = np.minimum(order[: len(order) - rest], order[rest:]) if rest else order
        anchor = (order & np.uint64((1 << 20) - 1)).astype(np.int64)
        place = np.arange(len(anchor)) + low
        doc = np.searchsorted(self.starts, place, "right") - 1
        # of documents with equal starts the empty ones come first, so this is the one that holds the byte
        good = place + size <= self.starts[doc] + self.sizes[doc]
        change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (good[1:] != good[:-1])) + 1
        begins = np.concatenate(([0], change))
        counts = np.diff(np.append(begins, len(anchor)))
        keep = good[begins]
        begins, counts = begins[keep], counts[keep]
        # least hashes crowd near 0; spread once more, they fill the ranges evenly
        return begins + low, counts, doc[begins], _spread(h[anchor[begins]]), anchor[begins] + low

    def fragments(self, size: int, flags: np.ndarray) -> tuple[_Strings, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings to compare, sorted by key; and what they were cut from: first start, document, string.

        ``flags`` are those of the sorted distinct anchors.
        """
        begin, count, doc, key, anchor = self.occurrences(size)
        flag = flags[np.unique(key, return_inverse=True)[1]] if len(key) else np.empty(0, np.uint8)
        some = flag > 0
        begin, count, doc, key, anchor, flag = (x[some] for x in (begin, count, doc, key, anchor, flag))
        span = size - ANCHOR + 1
        padded = np.concatenate((np.zeros(span, np.uint8), np.frombuffer(self.data, np.uint8), np.zeros(size + span, np.uint8)))
        hot = np.flatnonzero(flag > 1)
        if len(hot):
            n = count[hot]
            each = np.repeat(hot, n)
            start = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            own = _row_hashes(np.lib.stride_tricks.sliding_window_view(padded, size)[start + span])
            cold = flag == 1
            begin, count, doc = (np.concatenate((x[cold], y)) for x, y in ((begin, start), (count, np.ones_like(start)), (doc, doc[each])))
            key, anchor = np.concatenate((key[cold], own)), np.concatenate((anchor[cold], start))
        first = span - 1 - (anchor - begin)
        rows = np.lib.stride_tricks.sliding_window_view(padded, span - 1 + size)[anchor + 1]
        rows = rows * _covered(first, count + size - 1, rows.shape[1])
        order = np.lexsort((_row_hashes(rows) + (first * 256 + count).astype(np.uint64), key))
        before, after = order[:-1], order[1:]
        # equal hashes are held against the bytes themselves
        unlike = (key[before] != key[after]) | (first[before] != first[after]) | (count[before] != count[after]) | (rows[before] != rows[after]).any(axis=1)
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), unlike)))
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(np.concatenate((np.zeros(min(1, len(order)), np.int64), unlike)))
        least = np.minimum.reduceat(self.ids[doc[order]], head) if len(head) else np.empty(0, np.int64)
        chosen = order[head]
        return _Strings(rows[chosen], first[chosen], count[chosen], least, key[chosen]), begin, doc, which


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the 64-bit numbers begins among sorted keys."""
    part = (keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def _tasks(parts: int) -> int:
    return max(1, parts // RANGES)


def _shared_anchors(blocks: DataFrame, size: int, parts: int, seats: Column) -> DataFrame:
    """Per block and part: 0, 1 or 2 for each distinct anchor, if one document, several, or very many have it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (row,) in _runs(_rows(batches), 0):
            _, _, docs, anchors, _ = _Block(row).occurrences(size)
            order = np.argsort(anchors, kind="stable")
            anchors, docs = anchors[order], docs[order]
            first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1]))) if len(anchors) else np.empty(0, np.int64)
            last = np.append(first[1:], len(anchors)) - 1
            keys = anchors[first]
            times = np.where(docs[first] != docs[last], -1, 1) * (last - first + 1)
            cuts, out = _parts_of(keys, parts), []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                cut = slice(cuts[p], cuts[p + 1])
                out.append((row[0], FLAGS, p, keys[cut].tobytes(), times[cut].astype("<i4").tobytes(), None, None))
            yield _batch(out)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(_rows(batches), 2):
            keys = np.concatenate([np.frombuffer(r[3], np.uint64) for r in rows])
            times = np.concatenate([np.frombuffer(r[4], "<i4") for r in rows]).astype(np.int64)
            distinct, at, holders = np.unique(keys, return_inverse=True, return_counts=True)
            total = np.bincount(at, np.abs(times), len(distinct))
            several = (holders > 1) | (np.bincount(at, times < 0, len(distinct)) > 0)
            flags = (several.astype(np.uint8) + (several & (total > HOT)))[at]
            cut = 0
            for r in rows:
                n = len(r[3]) // 8
                yield _batch([(r[0], FLAGS, r[2], _zip(flags[cut : cut + n].tobytes()), None, None, None)])
                cut += n

    sent = blocks.mapInArrow(send, ROW)
    return sent.repartition(_tasks(parts), seats).sortWithinPartitions("part", "block").mapInArrow(judge, ROW)


def column_wise(rows: np.ndarray, cap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per column, from the last to the first: the suffixes that start there in their order, and common prefixes.

    ``rows`` are strings of equal width.  In each round every string's next symbol is inserted: suffixes of the
    column after it, in their order, are dealt to their symbols in one stable pass.  Two neighbours with one symbol
    have one more in common than the least of the prefixes between their old places, counted up to ``cap``; others
    have none.  Equal suffixes stay in the order of their strings.  An entry of the prefixes belongs to a suffix and
    the one before it.
    """
    n, width = rows.shape
    columns = np.ascontiguousarray(rows.T)
    order, prefix = np.arange(n), np.zeros(n, np.uint8)
    for at in range(width - 1, -1, -1):
        transform = columns[at][order]
        moved = np.argsort(transform, kind="stable")
        symbol = transform[moved]
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        low, high = moved[same - 1] + 1, moved[same]
        level = np.frexp(high - low + 1)[1] - 1
        least = np.empty(len(same), np.uint8)
        minima = prefix
        for k in range(int(level.max(initial=-1)) + 1):
            mine = np.flatnonzero(level == k)
            least[mine] = np.minimum(minima[low[mine]], minima[high[mine] + 1 - (1 << k)])
            minima = np.minimum(minima[: -(1 << k)], minima[1 << k :])
        order, prefix = order[moved], np.zeros(n, np.uint8)
        prefix[same] = np.minimum(least, cap - 1) + 1
        yield at, order, prefix


def _earlier(strings: _Strings, size: int) -> np.ndarray:
    """For each place of each string, whether an id before its own holds the ``size``-byte string there."""
    n, width = strings.rows.shape
    found = np.zeros((n, width - size + 1), bool)
    for at, order, prefix in column_wise(strings.rows, size):
        if at > width - size:
            continue
        # strings that do not cover the place hold nothing there
        here = (strings.first[order] <= at) & (at < (strings.first + strings.count)[order])
        order, group = order[here], np.cumsum(prefix < size)[here]
        if len(order):
            fresh = np.concatenate(([True], group[1:] != group[:-1]))
            ids = strings.least[order]
            found[order, at] = np.minimum.reduceat(ids, np.flatnonzero(fresh))[np.cumsum(fresh) - 1] < ids
    return found[_covered(strings.first, strings.count, width - size + 1)]


def _with_flags(rows: list[tuple]) -> tuple[_Block, np.ndarray]:
    flags = [np.frombuffer(_unzip(r[3]), np.uint8) for r in rows if r[1] == FLAGS]
    return _Block(rows[0]), np.concatenate(flags) if flags else np.empty(0, np.uint8)


def _held_earlier(met: DataFrame, size: int, parts: int, seats: Column) -> DataFrame:
    """Per block and part: for the places of the strings that the block sent, whether an id before theirs holds them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(_rows(batches), 0):
            block, flags = _with_flags(rows)
            strings = block.fragments(size, flags)[0]
            cuts, out = _parts_of(strings.key, parts), []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                out.append((rows[0][0], EARLIER, p, *strings.cut(slice(cuts[p], cuts[p + 1]), size), None))
            yield _batch(out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(_rows(batches), 2):
            strings = _Strings.joined([r[3:6] for r in rows], size)
            found, at, string = _earlier(strings, size), 0, 0
            places = np.cumsum(strings.count)
            for r in rows:
                string += len(r[3]) // 2
                stop = int(places[string - 1])
                yield _batch([(r[0], EARLIER, r[2], _zip(found[at:stop].tobytes()), None, None, None)])
                at = stop

    return met.mapInArrow(send, ROW).repartition(_tasks(parts), seats).sortWithinPartitions("part", "block").mapInArrow(compare, ROW)


def remove_repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``id, n_bytes, n_removed, spans, kept``: removed runs of bytes (start, end) and what is left.

    A byte goes if a ``size``-byte string that covers it also starts in a document with a smaller id; strings
    are judged on the input.  Matches never cross documents.  A null text is empty; rows that share an id do not
    remove from each other; a row without id counts as later than all others.
    """
    if size < ANCHOR + 1 or size > 255:
        raise ValueError(f"size must be from {ANCHOR + 1} to 255: {size}")
    work = Work(docs.sparkSession, "suffixes")
    blocks = work.save(_blocks(docs.select(F.col(id_col).cast("long"), F.col(text_col))), "blocks", "uncompressed")
    tasks = max(1, shuffle_partitions(docs), blocks.count() // TASK_BLOCKS)
    parts = RANGES * tasks  # several small ranges to a task: even loads, and only one range in memory
    seats = seat(F.floor(F.col("part") / RANGES), tasks)
    meet = lambda *tables: _union(blocks, *tables).repartition(tasks, "block").sortWithinPartitions("block", "what", "part")
    flags = work.save(_shared_anchors(blocks, size, parts, seats), "flags")
    earlier = work.save(_held_earlier(meet(flags), size, parts, seats), "earlier")
    schema = T.StructType([
        T.StructField(id_col, T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType()),
    ])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(_rows(batches), 0):
            block, shared = _with_flags(rows)
            strings, begin, doc, which = block.fragments(size, shared)
            early = [np.frombuffer(_unzip(r[3]), bool) for r in rows if r[1] == EARLIER]
            depth = np.zeros(len(block.data) + 1, np.int32)
            if early:
                n = strings.count[which]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                heads = np.cumsum(strings.count) - strings.count
                # an earlier one elsewhere, or in this block
                gone = np.concatenate(early)[np.repeat(heads[which], n) + step] | np.repeat(strings.least[which] < block.ids[doc], n)
                gone = (np.repeat(begin, n) + step)[gone]
                depth += np.bincount(gone, minlength=len(depth)).astype(np.int32) - np.bincount(gone + size, minlength=len(depth)).astype(np.int32)
            covered = np.cumsum(depth)[:-1] > 0
            out = [[], [], [], []]
            for start, n in zip(block.starts.tolist(), block.sizes.tolist(), strict=True):
                mask, data = covered[start : start + n], block.data[start : start + n]
                if not mask.any():
                    values = (n, 0, [], data)
                else:
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).reshape(-1, 2).tolist()
                    values = (n, int(mask.sum()), [{"start": a, "end": b} for a, b in edges], np.frombuffer(data, np.uint8)[~mask].tobytes())
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            ids = pa.array(block.ids, pa.int64(), mask=block.null)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.list_(span), pa.binary()), strict=True))], names=schema.names
            )

    return meet(flags, earlier).mapInArrow(remove, schema)


def _union(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out
