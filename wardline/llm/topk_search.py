"""Exact top-k inner-product search by columnar branch-and-bound.

Candidates stand in vertical blocks: one row per dimension, one column per vector, with the mass (squared
length) that each vector has left from each dimension block on.  A block of queries accumulates its scores
dimension block by dimension block; after each, the most that a pair can still gain is the product of the
lengths left (Cauchy-Schwarz), and only pairs that can still reach their query's k-th best score go on.  Pairs
go on as a whole block while many survive, and as a compacted list once few do.

Every task scans its own candidates against a block of queries and keeps k per query; a second aggregation
takes the best of those.  Query blocks are of fixed size, one pass over the candidates each, so what is
broadcast doesn't grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written

#: Queries of a pass, and candidates of a block.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 4096
#: Queries handled at a time against a candidate block, and dimensions accumulated between two bounds.
QUERY_TILE, DIMENSIONS = 256, 16
#: A tile is compacted when so few of its pairs survive.
COMPACT = 0.08
#: A block is closed, too, at the vector that brings it to so many components.
BLOCK_VALUES = 1 << 22
#: Vectors with a component of this size, after scaling, are multiplied as Python integers and without bounds.
LARGE = 1 << 26
#: Query blocks answered in one plan; of more, earlier answers are written to the shared folder.
PLAN_BLOCKS = 8
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"
#: The scores that there are: what lies beyond 64 bits counts as the nearest of these.
LEAST, MOST = 2 - (1 << 63), (1 << 63) - 1
#: The score of a place that no candidate has taken yet; below every score.
NONE = LEAST - 1


def taking_part(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): every vector that takes part, as doubles.

    Vectors that are null, or hold a null or a non-finite component, take no part; nor do rows without an id.  An
    empty vector does: its product with another empty one is zero.
    """
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null").where(fine)


def _floor(x: float, scale: int) -> int:
    """floor(scale * x), where scale * x may be beyond the doubles."""
    return math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale


def _matrices(ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray, scale: int) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """{(dimensions, whether large): (ids, rows of integers)} of vectors laid end to end.

    Vectors of different lengths have no product and never meet.  Large ones are Python integers, others doubles.
    """
    out, starts = {}, np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        raw = flat[starts[own][:, None] + np.arange(d)]
        with np.errstate(over="ignore"):
            rows = np.floor(raw * scale)
        large = (np.abs(rows) >= LARGE).any(1)
        if not large.all():
            out[d, False] = ids[own[~large]], rows[~large]
        if large.any():
            out[d, True] = ids[own[large]], np.array([[_floor(x, scale) for x in r] for r in raw[large].tolist()], object)
    return out


def _cuts(dims: int, step: int) -> list[int]:
    return [*range(step, dims, step), dims]


def _left(columns: np.ndarray, step: int = DIMENSIONS) -> np.ndarray:
    """Length of each column from each cut on, a little too high rather than too low."""
    return np.sqrt(np.array([(columns[c:] ** 2).sum(0) for c in _cuts(len(columns), step)])).astype(np.float32) * np.float32(1 + 1e-5)


class Best:
    """The k best (score, candidate) of each query so far, best first; equal scores go to the smaller candidate."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), NONE, np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def floor(self, rows: slice) -> np.ndarray:
        """The score that a new candidate must reach."""
        return self.scores[rows, -1]

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge candidate (row, id, score) triples."""
        scores = scores.astype(np.int64)
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
        rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.concatenate([first, [len(rows)]])))
        keep = rank < self.k
        rows, ids, scores, rank = rows[keep], ids[keep], scores[keep], rank[keep]
        touched, place = np.unique(rows, return_inverse=True)
        s = np.full((len(touched), 2 * self.k), NONE, np.int64)
        i = np.full((len(touched), 2 * self.k), np.iinfo(np.int64).max, np.int64)
        s[:, : self.k], i[:, : self.k] = self.scores[touched], self.ids[touched]
        s[place, self.k + rank], i[place, self.k + rank] = scores, ids
        best = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[touched], self.ids[touched] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def scan_block(queries: np.ndarray, query_ids: np.ndarray, lengths: np.ndarray, columns: np.ndarray, ids: np.ndarray, best: Best, step: int = DIMENSIONS) -> None:
    """One vertical block of candidates (dimensions x n) against all queries (n x dimensions), none of them large."""
    dims = len(columns)
    most = dims * float(np.abs(columns).max(initial=0)) * float(np.abs(queries).max(initial=0))
    if most >= 1 << 62:
        return scan_plain(queries, query_ids, columns.T, ids, best)
    # The type that holds every partial score exactly; beyond doubles, integers, which are slower.
    exact = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    # Rounding: the bound is a few units too high rather than too low.
    slack = 1 if most < 1 << 53 else int(most) >> 50
    cuts, left = _cuts(dims, step), _left(columns, step)
    wide, tall = columns.astype(exact), queries.astype(exact)
    for at in range(0, len(queries), QUERY_TILE):
        rows = slice(at, min(at + QUERY_TILE, len(queries)))
        q = tall[rows]
        score = q[:, :step] @ wide[:step]
        floor = best.floor(rows)
        reachable = floor.astype(np.float64) - slack
        pairs = None
        for b, cut in enumerate(cuts):
            last = b + 1 == len(cuts)
            if pairs is None:
                alive = score >= floor[:, None] if last else score + lengths[rows, b, None] * left[b][None] >= reachable[:, None]
                if last or alive.mean() < COMPACT:
                    pairs = np.nonzero(alive)
                    score = score[pairs]
            else:
                keep = score >= floor[pairs[0]] if last else score + lengths[rows][pairs[0], b] * left[b][pairs[1]] >= reachable[pairs[0]]
                pairs, score = (pairs[0][keep], pairs[1][keep]), score[keep]
            if last:
                break
            nxt = cuts[b + 1]
            if pairs is None:
                score = score + q[:, cut:nxt] @ wide[cut:nxt]
            elif len(score):
                score = score + np.einsum("pd,dp->p", q[pairs[0], cut:nxt], wide[cut:nxt][:, pairs[1]])
        other = query_ids[rows][pairs[0]] != ids[pairs[1]]
        if other.any():
            best.add(pairs[0][other] + at, ids[pairs[1][other]], score[other])


def scan_plain(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Every candidate (rows) against every query by whole products of Python integers, for those of which one is large."""
    tall, wide = (x if x.dtype == object else x.astype(np.int64).astype(object) for x in (queries, rows))
    for at in range(0, len(tall), QUERY_TILE):
        score = np.clip(tall[at : at + QUERY_TILE] @ wide.T, LEAST, MOST).astype(np.int64)
        for k, own in enumerate(score):
            keep = np.flatnonzero((own >= best.scores[at + k, -1]) & (ids != query_ids[at + k]))
            if len(keep):
                best.add(np.full(len(keep), at + k), ids[keep], own[keep])


def _scan(batches: Iterator[pa.RecordBatch], queries: tuple, k: int, scale: int) -> Iterator[pa.RecordBatch]:
    state: dict[int, list] = {}
    for (d, large), (own, rows) in _matrices(*queries, scale).items():
        state.setdefault(d, []).append((own, rows, None if large else _left(rows.T).T, Best(len(own), k)))
    held: list[tuple] = []

    def flush():
        ids, sizes, flat = (np.concatenate(x) for x in zip(*held))
        held.clear()
        for (d, large), (own, rows) in _matrices(ids, sizes, flat, scale).items():
            for query_ids, q, lengths, best in state.get(d, ()):
                if large or lengths is None:
                    scan_plain(q, query_ids, rows, own, best)
                else:
                    scan_block(q, query_ids, lengths, np.ascontiguousarray(rows.T), own, best)

    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
            part = batch.slice(at, CANDIDATE_BLOCK)
            ids, vectors = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
            held.append((ids, vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)))
            if sum(len(h[0]) for h in held) >= CANDIDATE_BLOCK or sum(len(h[2]) for h in held) >= BLOCK_VALUES:
                flush()
    if held:
        flush()
    for own, _, _, best in (x for group in state.values() for x in group):
        found = best.scores > NONE
        rows, _ = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(best.ids[found]), pa.array(best.scores[found])], names=["query_id", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, is_query, *, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    Queries are the rows for which ``is_query`` (a function of the id column) holds; candidates all rows but those of
    the query's own id; all of them where there are fewer than k.  Vectors as ``taking_part`` says; vectors of another
    length than the query's are no candidates.  The scores of the rows that share a query id are ranked together, and
    a repeated candidate row counts as often as it stands.  A score beyond 64 bits counts as the nearest there is.
    An empty table gives an empty result.
    """
    spark = df.sparkSession
    vectors = taking_part(df, id_col, vector_col)
    path, waiting, shared, written_out = scratch(spark, "top-k"), [], [], False
    for block in _blocks(vectors.where(is_query(F.col("id")))):
        shared.append(spark.sparkContext.broadcast(block))
        waiting.append(vectors.mapInArrow(lambda batches, own=shared[-1]: _scan(batches, own.value, k, scale), "query_id bigint, vec_id bigint, score bigint"))
        if len(waiting) == PLAN_BLOCKS:
            # A plan with a branch for each of very many blocks would itself grow with the data.
            _ranked(reduce(DataFrame.unionByName, waiting), k).write.mode("append").parquet(path)
            for own in shared:
                own.destroy()
            waiting, shared, written_out = [], [], True
    if written_out:
        waiting.append(spark.read.schema(RESULT).parquet(path).drop("rank"))
    return _ranked(reduce(DataFrame.unionByName, waiting), k) if waiting else spark.createDataFrame([], RESULT)


def _blocks(chosen: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The queries in blocks of QUERY_BLOCK (ids, lengths, components end to end), brought to the driver one block at a time."""
    ids, vectors, values = [], [], 0

    def block():
        return np.array(ids, np.int64), np.array([len(v) for v in vectors], np.int64), np.concatenate([np.zeros(0), *vectors])

    for row in written(chosen, "queries").toLocalIterator():
        ids.append(row[0])
        vectors.append(np.array(row[1], np.float64))
        values += len(vectors[-1])
        if len(ids) == QUERY_BLOCK or values >= BLOCK_VALUES:
            yield block()
            ids, vectors, values = [], [], 0
    if ids:
        yield block()
