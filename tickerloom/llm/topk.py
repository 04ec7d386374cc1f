"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import seal, sealed_column, written

#: Queries of one tile, which every task holds: 32 MB at 64 components.
QUERY_TILE = 65_536
#: Rows and columns of one matrix product.
QUERY_ROWS, CANDIDATE_ROWS = 2048, 2048
EXACT = 2.0 ** 53
NO_ID = np.iinfo(np.int64).max


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * values)


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating-point matrix product while that is exact, else by whole numbers kept within a long."""
    bound = max(1, queries.shape[1]) * float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0))
    if bound < EXACT:
        return queries @ candidates.T
    whole = np.array([[int(x) for x in row] for row in queries], object) @ np.array([[int(x) for x in row] for row in candidates], object).T
    return np.clip(whole, -(2 ** 63), 2 ** 63 - 1)


class Best:
    """The k best candidates of each query so far: larger score first, then smaller id; null ids last."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, k: int):
        self.rows, self.vectors, self.k = rows, vectors, k
        self.found: list[list[tuple]] = [[] for _ in rows]
        self.floor = np.full(len(rows), -np.inf)

    def take(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """One shard against all queries, tile by tile; of a tile only scores that reach a query's k-th best so far are looked at."""
        for a in range(0, len(self.rows), QUERY_ROWS):
            for b in range(0, len(rows), CANDIDATE_ROWS):
                scores = products(self.vectors[a:a + QUERY_ROWS], vectors[b:b + CANDIDATE_ROWS])
                own = self.rows[a:a + QUERY_ROWS, None] == rows[None, b:b + CANDIDATE_ROWS]
                shown = np.where(own, -np.inf, scores.astype(np.float64))
                floor = self.floor[a:a + QUERY_ROWS]
                if shown.shape[1] > self.k:  # no score below the tile's own k-th best can be among the k best
                    floor = np.maximum(floor, np.partition(shown, -self.k, axis=1)[:, -self.k])
                q, c = np.nonzero((shown >= floor[:, None]) & ~own)
                if not len(q):
                    continue
                order = np.lexsort((ids[b + c], -shown[q, c], q))
                q, c = q[order], c[order]
                first = np.searchsorted(q, q)
                kept = np.arange(len(q)) - first < self.k
                for i, j in zip(q[kept].tolist(), c[kept].tolist()):
                    self.found[a + i].append((-int(scores[i, j]), int(ids[b + j])))
                for i in np.unique(q).tolist():
                    best = sorted(self.found[a + i])[:self.k]
                    self.found[a + i] = best
                    if len(best) == self.k:
                        self.floor[a + i] = float(-best[-1][0])


def search(tile: list[tuple[int, int, bytes]], scale: float, k: int):
    """A function over Arrow batches (row, id, vector) of candidates that lists (query_row, query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_width: dict[int, list] = {}
        for row, ident, data in tile:
            vector = np.frombuffer(data, np.float64)
            by_width.setdefault(len(vector), []).append((row, ident, vector))
        best = {w: Best(np.array([x[0] for x in xs], np.int64), quantised(np.array([x[2] for x in xs]).reshape(len(xs), w), scale), k) for w, xs in by_width.items()}
        for batch in batches:
            rows = batch.column(0).to_numpy()
            ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            widths = lists.value_lengths().to_numpy()
            for w in set(widths.tolist()) & set(best):
                at = np.nonzero(widths == w)[0]
                values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), w)
                best[w].take(rows[at], ids[at], quantised(values, scale))
        out = [(row, ident, vec, -score) for w, xs in by_width.items() for (row, ident, _), found in zip(xs, best[w].found) for score, vec in found]
        columns = list(zip(*out)) if out else [(), (), (), ()]
        vec = pa.array([None if x == NO_ID else x for x in columns[2]], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), vec, pa.array(columns[3], pa.int64())],
                                         names=["query_row", "query_id", "vec_id", "score"])

    return run


def merged(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return lists.withColumn("rank", ranked).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding",
          query_tile: int = QUERY_TILE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` holds (an expression over the columns ``vec_id``), the ``k`` other rows
    of the largest integer inner product, components being floor(scale * x) of x as double; ties go to the smaller id.

    Every query meets every row: queries are taken in tiles of bounded size that all tasks hold, rows stay where they are. A task multiplies
    tile by shard in blocks and keeps each query's k best; the lists are merged by tens of tasks, then by query. Products are exact; a
    score beyond a long is kept at its end.

    Vectors that are null or hold null or non-finite components take no part; only vectors of the same length are compared. A row with a null id is no
    query and sorts last among ties. Repeated ids are rows of their own: each is a query, its copies are among its candidates.
    Other columns are ignored. An empty table gives no rows."""
    rows, names = seal(vectors)
    ident, vector = F.col(sealed_column(names, id_column)), F.col(sealed_column(names, vector_column)).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    table = written(rows.select(F.monotonically_increasing_id().alias("row"), ident.cast("bigint").alias("vec_id"), vector.alias("vector")).where(F.col("vector").isNotNull() & finite))
    queries = table.where(F.col("vec_id").isNotNull() & is_query).select("row", "vec_id", "vector")
    counts = {r[0]: r[1] for r in queries.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count(F.lit(1))).collect()}  # a row for each input partition
    found = None
    for tile in tiles(queries, counts, query_tile):
        held = [(r["row"], r["vec_id"], np.array(r["vector"], np.float64).tobytes()) for r in tile.collect()]  # at most ``query_tile`` queries
        one = table.mapInArrow(search(held, scale, k), "query_row long, query_id long, vec_id long, score long").withColumn("_of", F.spark_partition_id() % 16)
        one = written(merged(one, k, "query_row", "_of").drop("rank"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return merged(found, k, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def tiles(queries: DataFrame, counts: dict[int, int], size: int) -> Iterator[DataFrame]:
    """Queries in runs of whole input partitions of at most ``size``; a partition with more is cut by ranges of its row numbers."""
    run, held = [], 0
    part = F.shiftright("row", 33)
    for p, n in sorted(counts.items()):
        if n > size:
            pieces = -(-n // size)
            bounds = queries.where(part == p).agg(*[F.percentile("row", F.lit(i / pieces)).alias(f"b{i}") for i in range(pieces + 1)]).first()
            for i in range(pieces):
                inside = (F.col("row") >= bounds[i]) & ((F.col("row") < bounds[i + 1]) | F.lit(i == pieces - 1))
                yield queries.where((part == p) & inside)
            continue
        if held + n > size:
            yield queries.where(part.isin(run))
            run, held = [], 0
        run.append(p)
        held += n
    if run:
        yield queries.where(part.isin(run))
