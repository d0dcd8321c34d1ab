"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Malkov and Yashunin (TPAMI 2020).  Vectors of a label are dealt into shards of bounded size; every vector of
the label queries every shard.  Queries are dealt into chunks, so a task holds one shard's graph and streams
one chunk through it.  In each task a hash-chosen sample of the whole chunk is also answered by brute force, drawn
until enough queries with links are seen, and the search beam is doubled until nearly all of these queries find all
their links.  Where too few have links, or no narrow beam will do, the task scans its shard instead.  Links are
confirmed in double precision on whole vectors, counted where they are found, and joined into components; pairs are
not emitted.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Work, checked_broadcast, shuffle_partitions
from quern.llm.components import components

#: Queries of a scan's block; sampled queries for each one of the audit at most.
SCANNED, DRAWS = 256, 16


class Graph:
    """A small-world graph over unit vectors; levels come from a hash of the number, so builds repeat."""

    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 48):
        self.x, self.links = vectors, links
        n = len(vectors)
        rng = np.random.default_rng(n)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 12)
        self.near = [np.full((n, links * (1 if k else 2)), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.degree = [np.zeros(n, np.int32) for _ in self.near]
        self.stamp, self.mark = np.zeros(n, np.int64), 0
        self.top = 0
        for i in range(1, n):
            self._insert(i, beam)

    def _layer(self, q: np.ndarray, entries: list[tuple[float, int]], width: int, k: int) -> list[tuple[float, int]]:
        """The ``width`` most similar nodes found on level ``k``, as a min-heap of (similarity, node)."""
        self.mark += 1
        mark, stamp, near, degree, x = self.mark, self.stamp, self.near[k], self.degree[k], self.x
        best = entries[:]
        heapq.heapify(best)
        todo = [(-s, i) for s, i in entries]
        heapq.heapify(todo)
        for _, i in entries:
            stamp[i] = mark
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            around = near[i, : degree[i]]
            around = around[stamp[around] != mark]
            if not len(around):
                continue
            stamp[around] = mark
            sims = x[around] @ q
            if len(best) >= width:
                good = sims > best[0][0]
                around, sims = around[good], sims[good]
            for s, j in zip(sims.tolist(), around.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, j))
                    heapq.heappush(todo, (-s, j))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, j))
                    heapq.heappush(todo, (-s, j))
        return best

    def _descend(self, q: np.ndarray, down_to: int) -> list[tuple[float, int]]:
        at = [(float(self.x[self.top] @ q), self.top)]
        for k in range(int(self.level[self.top]), down_to, -1):
            at = [max(self._layer(q, at, 1, k))]
        return at

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: skip a node nearer to a chosen one than to the centre; then fill up."""
        chosen, skipped = [], []
        for s, j in sorted(found, reverse=True):
            if len(chosen) >= most:
                break
            if chosen and float((self.x[chosen] @ self.x[j]).max()) > s:
                skipped.append(j)
            else:
                chosen.append(j)
        return (chosen + skipped)[:most]

    def _insert(self, i: int, beam: int) -> None:
        q = self.x[i]
        at = self._descend(q, int(self.level[i]))
        for k in range(min(int(self.level[i]), int(self.level[self.top])), -1, -1):
            at = self._layer(q, at, beam, k)
            most = self.near[k].shape[1]
            chosen = self._choose(at, self.links)
            self.near[k][i, : len(chosen)] = chosen
            self.degree[k][i] = len(chosen)
            for j in chosen:
                d = self.degree[k][j]
                if d < most:
                    self.near[k][j, d] = i
                    self.degree[k][j] = d + 1
                else:
                    all_of = np.append(self.near[k][j], i)
                    sims = self.x[all_of] @ self.x[j]
                    kept = self._choose(list(zip(sims.tolist(), all_of.tolist(), strict=True)), most)
                    self.near[k][j, : len(kept)] = kept
                    self.near[k][j, len(kept) :] = -1
                    self.degree[k][j] = len(kept)
        if self.level[i] > self.level[self.top]:
            self.top = i

    def within(self, q: np.ndarray, least: float, beam: int) -> np.ndarray:
        """Nodes with similarity of at least ``least``: a beam search, then a flood through the ball it reached."""
        if beam >= len(self.x):
            return np.flatnonzero(self.x @ q >= least)
        found = self._layer(q, self._descend(q, 0), beam, 0)
        inside = np.array([j for s, j in found if s >= least], np.int64)
        if not len(inside):
            return inside
        self.mark += 1
        self.stamp[inside] = self.mark
        parts, front = [inside], inside
        while len(front):
            around = np.unique(self.near[0][front])
            around = around[around >= 0]
            around = around[self.stamp[around] != self.mark]
            self.stamp[around] = self.mark
            front = around[self.x[around] @ q >= least]
            parts.append(front)
        return np.concatenate(parts)


def scan(x: np.ndarray, queries: np.ndarray, least: float, own: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Per query all rows of ``x`` with similarity of at least ``least``, but not row ``own`` (-1: none is its own)."""
    for a in range(0, len(queries), SCANNED):
        near = queries[a : a + SCANNED] @ x.T >= least
        if own is not None:
            mine = np.flatnonzero(own[a : a + SCANNED] >= 0)
            near[mine, own[a : a + SCANNED][mine]] = False
        yield from (np.flatnonzero(r) for r in near)


def audited_beam(
    graph: Graph, queries: np.ndarray, least: float, beam: int, target: float, own: np.ndarray | None = None, enough: int = 1
) -> int:
    """The narrowest doubled beam by which ``target`` of the queries that have links find all of them.

    The share is held over all queries and over those with a like number of links (of one power of two), so that large
    groups do not pass for small ones; a query's match with itself is no link.  With fewer than ``enough`` queries that
    have links, or beyond an eighth of the graph, where a scan costs less, it is the whole graph.
    """
    own = np.full(len(queries), -1) if own is None else own
    asked = [(q, o, len(t)) for q, o, t in zip(queries, own.tolist(), scan(graph.x, queries, least, own), strict=True) if len(t)]
    kinds = np.array([t.bit_length() for _, _, t in asked])
    while len(asked) >= enough and 8 * beam <= len(graph.x):
        whole = np.array([(graph.within(q, least, beam) != o).sum() == t for q, o, t in asked])
        if all(whole[of].mean() >= target for of in [kinds > 0, *(kinds == k for k in set(kinds.tolist()))] if of.any()):
            return beam
        beam *= 2
    return len(graph.x)


def _found(nodes: list, counts: list, u: list, v: list, audit: tuple | None = None) -> pa.RecordBatch:
    """Links counted at nodes, then spanning edges, then a task's audit."""
    a, b, c = len(nodes), len(u), int(audit is not None)
    columns = [nodes + [None] * (b + c), counts + [None] * (b + c), [None] * a + u + [None] * c, [None] * a + v + [None] * c]
    columns += [[None] * (a + b) + ([x] if c else []) for x in (audit or (0,) * 4)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["node", "links", "u", "v", "asked", "whole", "beam", "size"])


def _answers(least: float, beam: int, audits: int, target: float):
    """mapInArrow function over rows sorted by task, index rows (role 0) before queries (role 1), each in hash order."""

    def answer(tasks: Iterator[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
        for index, queries in tasks:
            ids = np.array([r[0] for r in index])
            times = np.array([r[1] for r in index])
            x = np.array([r[2] for r in index], np.float64)
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            number = {k: i for i, k in enumerate(ids.tolist())}
            at = list(range(len(ids)))

            def find(k, at=at):
                while at[k] != k:
                    at[k] = at[at[k]]
                    k = at[k]
                return k

            def vectors(batch, number=number):
                q_ids = [r[0] for r in batch]
                q = np.array([r[2] for r in batch], np.float64)
                return q_ids, q / np.sqrt((q * q).sum(axis=1))[:, None], np.array([number.get(k, -1) for k in q_ids])

            # queries come in hash order, so the first ones are a sample of the whole chunk
            batches, held, linked, drawn = map(vectors, queries), [], [], 0
            while len(linked) < audits and drawn < DRAWS * audits and (batch := next(batches, None)) is not None:
                held.append(batch)
                drawn += len(batch[0])
                linked += [(v, o) for v, o, t in zip(*batch[1:], scan(x, *batch[1:2], least, batch[2]), strict=True) if len(t)]
            linked, graph, width, whole = linked[:audits], None, len(x), len(linked[:audits])
            if len(linked) >= audits // 4:
                graph, asked, own_of = Graph(x), np.array([v for v, _ in linked]), np.array([o for _, o in linked])
                width = audited_beam(graph, asked, least, beam, target, own_of)
                if width < len(x):
                    whole = sum(
                        int((graph.within(q, least, width) != o).sum()) == len(t) for q, o, t in zip(asked, own_of.tolist(), scan(x, asked, least, own_of), strict=True)
                    )
            yield _found([], [], [], [], (len(linked), whole, width, len(x)))

            for q_ids, q, own in chain(held, batches):
                nodes, counts, u, v = [], [], [], []
                answers = scan(x, q, least, own) if width >= len(x) else (graph.within(vector, least, width) for vector in q)
                for one, found in zip(q_ids, answers, strict=True):
                    found = found[ids[found] != one]
                    if len(found):
                        nodes.append(one)
                        counts.append(int(times[found].sum()))
                        u.append(one)
                        v.append(int(ids[found[0]]))
                        a = find(int(found[0]))
                        for b in {find(k) for k in found[1:].tolist()} - {a}:
                            at[b] = a
                            u.append(int(ids[b]))
                            v.append(int(ids[a]))
                yield _found(nodes, counts, u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)

        def tasks():
            stream = rows()
            row = next(stream, None)
            while row is not None:
                task, index = row[0], []
                while row is not None and row[0] == task and row[1] == 0:
                    index.append(row[2:])
                    row = next(stream, None)

                def queries():
                    nonlocal row
                    part = []
                    while row is not None and row[0] == task:
                        part.append(row[2:])
                        row = next(stream, None)
                        if len(part) == 2048:
                            yield part
                            part = []
                    if part:
                        yield part

                yield index, queries()

        yield from answer(tasks())

    return run


def near_vectors(
    vectors: DataFrame, least: float = 0.93, shard_rows: int = 8192, chunk_rows: int = 65_536, beam: int = 48,
    audits: int = 256, target: float = 0.995, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    audits_to: str | None = None,
) -> DataFrame:
    """Per vector ``id, n_links, component_id, kept``; ids are integers.

    Vectors are linked if their labels are equal and not null and their cosine is at least ``least``.  A vector
    that is null, zero, or holds null or non-finite components links with nothing, nor do vectors of different
    length.  Equal vectors are one node that counts as often as it occurs.  Rows that share an id but not the vector
    are nodes of their own, each with its links; a component is named by the smallest id in it.  Rows with a null id
    have no links.  Other columns are not read and may have any name.

    ``audits_to``: a folder for the audits, a row per task: sampled queries that have links, those that found all of
    theirs by the beam chosen, the beam, and the shard's size (a beam as large is a scan, which finds all).
    """
    work = Work(vectors.sparkSession, "hnsw")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).alias("label"))
    finite = F.forall("x", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda a: a != 0)
    named = given.withColumn("h1", F.when(usable, F.xxhash64("label", "x"))).withColumn("h2", F.when(usable, F.xxhash64(F.lit(1), "label", "x")))
    nodes = named.where("h1 is not null").groupBy("h1", "h2").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("times"), F.first("x").alias("x"), F.first("label").alias("label")
    )
    nodes = nodes.withColumn("dim", F.size("x")).withColumn("node", F.monotonically_increasing_id())
    nodes = work.save(nodes, "nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).select(
        "label", "dim", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks")
    )
    dealt = nodes.join(checked_broadcast(sizes), ["label", "dim"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("h1", "h2"), F.col("shards")).cast("int")).withColumn(
        "chunk", F.pmod(F.xxhash64(F.lit(7), "h1", "h2"), F.col("chunks")).cast("int")
    )
    task = lambda shard, chunk: F.xxhash64("label", "dim", shard, chunk)
    rows = ["node", "times", "x"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = dealt.select("*", every("chunks").alias("c")).select(task("own", "c").alias("task"), F.lit(0).alias("role"), *rows, "h1", "h2")
    asked = dealt.select("*", every("shards").alias("s")).select(task("s", "chunk").alias("task"), F.lit(1).alias("role"), *rows, "h1", "h2")
    both = index.unionByName(asked).repartition(4 * shuffle_partitions(vectors), "task").sortWithinPartitions("task", "role", F.xxhash64(F.lit(11), "h1", "h2"), "h1", "h2")
    both = both.select("task", "role", *rows)
    found = work.save(both.mapInArrow(_answers(least, beam, audits, target), "node long, links long, u long, v long, asked long, whole long, beam long, size long"), "found")
    if audits_to:
        found.where("size is not null").select("asked", "whole", "beam", "size").write.mode("overwrite").parquet(audits_to)
    links = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("u is not null").select("u", "v"), work)
    joined = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct())
    member = nodes.select("h1", "h2", "node", "times", "id").join(links, "node", "left").join(joined, "node", "left")
    least = work.save(member.where("component is not null").groupBy("component").agg(F.min("id").alias("least")), "least")
    facts = work.save(
        member.join(checked_broadcast(least), "component", "left").select(
            "h1", "h2", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", member["id"]).alias("component")
        ),
        "facts",
    )
    whole = named.join(checked_broadcast(facts), ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return whole.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
