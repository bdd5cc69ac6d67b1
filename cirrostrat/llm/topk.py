"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Vectors become integers. A block's index holds the postings of each dimension, ordered by value and cut into segments of one
quantised impact. A query takes the segments of all dimensions by descending impact (what a segment's best posting adds above
the least of its dimension) and adds their postings to one accumulator for each row. What the segments to come can still add
bounds every score from above. The query stops only on the proof that all rows but a few possible members stay
below k lower bounds, or when its segments end; possible members are then rescored exactly. Blocks of vectors are dealt to tasks; each
indexes its block and lets the queries of a chunk pass by, and the best k of a query's blocks are ranked at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cirrostrat.llm.text import runs_of
from cirrostrat.runtime import materialize

#: The most rows of a block of vectors, the most components in one, and queries of a chunk. A block goes through the shuffle once for each
#: chunk, and chunks pass by in batches, so they are large: a minute or two of work for a task.
BLOCK, BLOCK_CELLS, CHUNK = 8192, 1 << 21, 65536
#: Segments of a dimension, parts of a query's postings after which it looks for a proof, and members it rescores for each result.
LEVELS, STEPS, MEMBERS = 8, 8, 16
_LONG = (1 << 63) - 1


class ImpactIndex:
    """Postings (row, value) of one block of integer vectors: by dimension and value, in segments of one quantised impact.

    Memory is that of the postings, whatever the number of segments.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        n, dims = vectors.shape
        order = np.argsort(self.vectors, axis=0, kind="stable")
        self.rows = order.T.ravel()
        self.values = np.take_along_axis(self.vectors, order, 0).T.ravel()
        low, high = self.vectors.min(0), self.vectors.max(0)
        level = np.floor((self.values - np.repeat(low, n)) / np.repeat(np.maximum(1, (high - low + 1) / LEVELS), n))
        dim = np.repeat(np.arange(dims), n)
        self.start = np.flatnonzero(np.r_[True, (level[1:] != level[:-1]) | (dim[1:] != dim[:-1])])
        self.end = np.r_[self.start[1:], n * dims]
        self.dim = dim[self.start]
        self.low, self.high = self.values[self.start], self.values[self.end - 1]
        self.first = np.flatnonzero(np.r_[True, self.dim[1:] != self.dim[:-1]])
        self.read = 0  # postings that the last query read

    def top_k(self, query: np.ndarray, but: int | None, k: int) -> list[tuple[int, int]]:
        """The (score, id) of the ``k`` best rows but that at ``but``; ties to the smaller id. All sums are of whole numbers below 2**53, so exact."""
        q, n = query.astype(np.float64), len(self.ids)
        most = np.maximum(q[self.dim] * self.low, q[self.dim] * self.high)
        floor = np.minimum.reduceat(np.minimum(q[self.dim] * self.low, q[self.dim] * self.high), self.first)
        gain = most - floor[self.dim]  # the impact of a segment
        best = np.maximum.reduceat(gain, self.first)
        turn = np.argsort(-gain, kind="stable")
        sizes = np.cumsum((self.end - self.start)[turn])
        total, unseen = np.zeros(n), np.full(n, best.sum())  # above the floors; the most that unseen dimensions add
        alive, done = np.arange(n), 0
        for step in range(1, STEPS + 1):
            upto = len(turn) if step == STEPS else int(np.searchsorted(sizes, n * len(q) * step / STEPS))
            segments = turn[done:upto]
            done = upto
            if len(segments):
                posted, dims = [slice(a, b) for a, b in zip(self.start[segments].tolist(), self.end[segments].tolist(), strict=True)], self.dim[segments]
                length = self.end[segments] - self.start[segments]
                rows, gained = np.concatenate([self.rows[p] for p in posted]), np.concatenate([self.values[p] for p in posted])
                gained *= np.repeat(q[dims], length)
                gained -= np.repeat(floor[dims], length)
                total += np.bincount(rows, gained, n)
                unseen -= np.bincount(rows, np.repeat(best[dims], length), n)
            rest = np.zeros(len(q))
            np.maximum.at(rest, self.dim[turn[done:]], gain[turn[done:]])
            if n > k + 1:
                lower = total.copy()
                if but is not None:
                    lower[but] = -1.0
                bar = np.partition(lower, n - k)[n - k]
                # the proof: every other row's upper bound stays below k lower bounds
                alive = np.flatnonzero(total + np.minimum(unseen, rest.sum()) + 0.5 >= bar)
            if len(alive) <= MEMBERS * k:
                break
        self.read = int(sizes[done - 1]) if done else 0
        alive = alive[alive != but] if but is not None else alive
        score = self.vectors[alive] @ q
        at = np.lexsort((self.ids[alive], -score))[:k]
        return [(int(score[i]), int(self.ids[alive[i]])) for i in at]


def _whole(x: float, scale: int) -> int:
    return math.floor(x * scale) if abs(x) < 2**52 else int(x) * scale


class _Candidates:
    """The candidates of a block that have one length: an impact index, and those apart whose products could pass 2**53."""

    def __init__(self, frame: pd.DataFrame, scale: int):
        x = np.stack(frame["v"].to_numpy()).astype(np.float64)
        ids, rows = frame["vec_id"].to_numpy(np.int64), frame["row"].to_numpy(np.int64)
        tame = _tame(x, scale)
        held = np.flatnonzero(tame)
        held = held[np.argsort(ids[held], kind="stable")]
        self.wild = [(int(ids[i]), int(rows[i]), [_whole(c, scale) for c in x[i].tolist()]) for i in np.flatnonzero(~tame)]
        self.index = ImpactIndex(ids[held], np.floor(x[held] * scale)) if len(held) else None
        self.at = {int(r): j for j, r in enumerate(rows[held])}

    def best(self, row: int, x: np.ndarray, k: int, scale: int) -> list[tuple[int, int]]:
        """The (score, id) of the ``k`` best candidates but the query's own row."""
        found: list[tuple[int, int]] = []
        whole = [_whole(c, scale) for c in x.tolist()] if self.wild or not _tame(x[None], scale)[0] else None
        if self.index is not None and (whole is None or _tame(x[None], scale)[0]):
            found = self.index.top_k(np.floor(x * scale), self.at.get(row), k)
        elif self.index is not None:
            own = self.at.get(row)
            found = [(sum(a * int(b) for a, b in zip(whole, v, strict=True)), int(name)) for j, (name, v) in enumerate(zip(self.index.ids, self.index.vectors, strict=True)) if j != own]
        found += [(sum(a * b for a, b in zip(whole, v, strict=True)), name) for name, at, v in self.wild if at != row]
        return sorted(((max(-_LONG - 1, min(_LONG, s)), name) for s, name in found), key=lambda f: (-f[0], f[1]))[:k]


def _tame(x: np.ndarray, scale: int) -> np.ndarray:
    """Vectors whose products stay below 2**53 whatever they meet; the others are scored in whole numbers of any size."""
    return np.abs(x).max(1) * scale + 1 < math.sqrt(2**52 / x.shape[1])


def _search(k: int, scale: int):
    """Rows come by block and chunk, candidates before queries: a block is indexed, then its queries pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, known = None, [], None
        for (block, chunk, asks), batch in runs_of(batches, "block", "chunk", "asks"):
            if (block, chunk) != group:
                group, waiting, known = (block, chunk), [], None
            if not asks:
                waiting.append(batch)
                continue
            if known is None:
                frame = pa.Table.from_batches(waiting).to_pandas() if waiting else pd.DataFrame({"v": []})
                known = {size: _Candidates(same, scale) for size, same in frame.groupby(frame["v"].map(len))}
                waiting = []
            out: list[tuple[int, int, int, int]] = []
            ids, rows = batch.column("vec_id").to_pylist(), batch.column("row").to_pylist()
            for name, row, v in zip(ids, rows, batch.column("v").to_numpy(zero_copy_only=False), strict=True):
                if (met := known.get(len(v))) is not None:
                    out += [(row, name, found, s) for s, found in met.best(row, np.asarray(v, np.float64), k, scale)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["row", "query_id", "vec_id", "score"])

    return run


def searchable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with components as doubles; vectors null, empty or holding null or non-finite components take no part, nor do null ids."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The ``k`` best rows for every vector whose id is divisible by ``every``: query_id, rank, vec_id, score.

    A component x counts as ``floor(scale * x)``. A row is no candidate of its own; rows that repeat an id are candidates of
    each other, and each is a query with an answer under that id. Vectors of different lengths do not meet. Ties go to the smaller
    vec_id. Fewer rows than ``k`` give all of them; an empty table none. Scores beyond a long become its limit, and rank so.
    Other columns are not read.
    """
    v = materialize(searchable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, longest = v.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n // max(1, min(BLOCK, BLOCK_CELLS // (longest or 1)))))
    chunks = max(1, -(-n // every // CHUNK))
    put = v.withColumn("block", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(blocks)).cast("int"))
    deal = put.select("vec_id", "row", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(False).alias("asks"))
    asked = v.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(chunks)).cast("int"))
    asks = asked.select("vec_id", "row", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "chunk", F.lit(True).alias("asks"))
    both = deal.union(asks.select(deal.columns)).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "asks")
    near = both.mapInArrow(_search(k, scale), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: DuckDB SQL of ``top_k`` with its defaults over embeddings.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
