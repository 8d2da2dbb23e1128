"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately; a cell is a pair of centroids.  A query takes the
cells in the order of the summed distances of its halves to the pair's centroids, by a heap, until it
has met a share of all rows that was found to be enough on the sample that the codebooks were fitted
on; the rows of these cells are ranked by their exact distance.

Cells lie in blocks of about BLOCK rows; a cell with more has several blocks.  A query travels once to
each block that holds some of its cells.  Of rows with one and the same vector, only the k + 1 smallest
ids can be among anyone's k nearest, so that no more of them are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boostloom.llm import vectors as V
from boostloom.llm.shared import written

#: Rows of a block of the index, and queries that meet it at once.
BLOCK, QUERIES = 1024, 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids, from evenly spaced rows; centroids that lose all rows go."""
    centers = np.unique(x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        near = squares(x, centers).argmin(1)
        n = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers = sums[n > 0] / n[n > 0, None]
    return centers


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0)


@dataclass
class Codebooks:
    """Centroids of the halves, and the share of rows that a query has to meet."""

    left: np.ndarray
    right: np.ndarray
    share: float

    @property
    def dim(self) -> int:
        return self.left.shape[1] + self.right.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.left.shape[1]
        return squares(x[:, :h], self.left), squares(x[:, h:], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def traverse(self, a: np.ndarray, b: np.ndarray) -> Iterator[int]:
        """Cells by summed distance: pairs of the halves' sorted centroids, each after both its predecessors."""
        i_of, j_of = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        sa, sb, width = a[i_of].tolist(), b[j_of].tolist(), len(b)
        i_of, j_of = i_of.tolist(), j_of.tolist()
        heap, reached = [(sa[0] + sb[0], 0, 0)], [0] * len(sa)  # reached[i]: pairs of row i that left the heap
        while heap:
            _, i, j = heapq.heappop(heap)
            reached[i] = j + 1
            yield i_of[i] * width + j_of[j]
            if j + 1 < width and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
            if i + 1 < len(sa) and reached[i + 1] == j:
                heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))


def fit(sample: np.ndarray, centroids: int, k: int, recall: float, judges: int = 128) -> Codebooks:
    """Codebooks, and the share of rows after which all but 1 - recall of the true neighbours within the sample were met."""
    h = sample.shape[1] // 2
    books = Codebooks(kmeans(sample[:, :h], centroids), kmeans(sample[:, h:], centroids), 1.0)
    cell = books.cells(sample)
    sizes = np.bincount(cell, minlength=len(books.left) * len(books.right))
    if len(sample) > k + 1:
        met = []
        queries = np.linspace(0, len(sample) - 1, min(judges, len(sample))).astype(int)
        a, b = books.distances(sample[queries])
        for n, q in enumerate(queries):
            d = ((sample - sample[q]) ** 2).sum(1)
            d[q] = np.inf
            true = np.argpartition(d, k)[:k]
            order = np.fromiter(books.traverse(a[n], b[n]), np.int64)
            done = np.zeros(len(sizes))
            done[order] = np.cumsum(sizes[order])
            met.append(done[cell[true]] / len(sample))
        books.share = float(np.quantile(np.concatenate(met), recall))
    return books


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        for batch in batches:
            x = V.matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(books.cells(x) if len(x) else [], pa.int32())], names=["id", "vector", "cell"])

    return run


def blocks_of(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: small neighbours share one, a large cell has its own."""
    first, number = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    at, room = 0, block
    for c in np.flatnonzero(sizes):
        n = int(sizes[c])
        if n > room and room < block:
            at, room = at + 1, block
        first[c], number[c] = at, max(1, -(-n // block))
        if n >= room:
            at, room = at + int(number[c]), block
        else:
            room -= n
    return first, number


def _probes(shared):
    """Each query's cells by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, sizes, first, number = shared.value
        enough = books.share * sizes.sum()
        for batch in batches:
            x = V.matrix(batch.column(1))
            if not len(x):
                continue
            a, b = books.distances(x)
            row, block, cells = [], [], []
            for i in range(len(x)):
                met, mine = 0, {}
                for c in books.traverse(a[i], b[i]):
                    if sizes[c]:
                        for n in range(number[c]):
                            mine.setdefault(int(first[c]) + n, []).append(c)
                        met += sizes[c]
                    if met >= enough:
                        break
                for k, v in mine.items():
                    row.append(i)
                    block.append(k)
                    cells.append(v)
            ids = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(block, pa.int64()), pa.array(cells, pa.list_(pa.int32()))], names=["query_id", "query", "q_block", "cells"])

    return run


def _rank(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            x, ids, cell = np.stack(index["vector"].to_numpy()).astype(float), index["id"].to_numpy(), index["cell"].to_numpy()
            for q, v, cells in zip(queries["query_id"], queries["query"], queries["cells"], strict=True):
                mine = np.flatnonzero(np.isin(cell, cells) & (ids != q))
                d = np.sqrt(((x[mine] - np.asarray(v, float)) ** 2).sum(1))
                best = np.lexsort((ids[mine], d))[:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[mine][best], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = 32, max_sample: int = 6000, recall: float = 0.97) -> DataFrame:
    """The k nearest rows of `vectors` found for each row of `queries`: query_id, rank, vec_id, score.

    Score is the Euclidean distance in double precision; ties go to the smaller id, and a query's own id
    is no candidate.  The codebooks are fitted on at most `max_sample` vectors (of least xxhash64 of
    their id); every row is in the index.  `recall` is what the sample's queries reach within the
    sample.  A query gets all candidates if there are fewer than k.

    Rows with a null id and vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do vectors whose length isn't the sample's most frequent one.  Repeated rows count once;
    an id that comes with several vectors has its nearest one's distance.  Other columns are ignored;
    empty tables give no rows.
    """
    spark = vectors.sparkSession
    every = V.rows(vectors, id_col, vector_col)
    sample = every.orderBy(F.xxhash64("id"), "id").limit(max_sample).toPandas()["vector"]
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    dim = int(sample.map(len).mode().iloc[0])
    books = fit(np.stack([x for x in sample if len(x) == dim]), centroids, k, recall)
    shared = spark.sparkContext.broadcast(books)
    few = Window.partitionBy("vector").orderBy("id")
    kept = every.filter(F.size("vector") == dim).withColumn("copy", F.row_number().over(few)).filter(F.col("copy") <= k + 1)
    cells = written(kept.select("id", "vector").mapInArrow(_assign(shared), "id long, vector array<double>, cell int"))
    sizes = np.zeros(len(books.left) * len(books.right), np.int64)
    for row in cells.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        sizes[row["cell"]] = row["count"]
    first, number = blocks_of(sizes, BLOCK)
    plan = spark.sparkContext.broadcast((books, sizes, first, number))

    asked = V.rows(queries, id_col, vector_col).filter(F.size("vector") == dim)
    probes = asked.mapInArrow(_probes(plan), "query_id long, query array<double>, q_block long, cells array<int>")
    groups = max(1, -(-asked.count() // QUERIES))
    probes = probes.withColumn("q_group", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    names = spark.createDataFrame([(int(c), int(first[c]), int(number[c])) for c in np.flatnonzero(sizes)], "of int, first long, number long")
    placed = cells.join(F.broadcast(names), F.col("cell") == F.col("of"))  # at most centroids ** 2 rows
    placed = placed.withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("number")))
    placed = placed.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    index = placed.select("block", "group", "id", "vector", "cell")
    found = index.groupBy("block", "group").cogroup(probes.groupBy("q_block", "q_group")).applyInPandas(_rank(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
