"""Word hashing shared by the text operators (helpers that run inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task turns into Python objects at once, and rows of an Arrow batch that brings them.
SLICE_BYTES, BATCH_ROWS = 2_000_000, 1000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each piece hold about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float)))
        cuts = np.flatnonzero(np.diff(sizes // most)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if hi > lo:
                yield batch.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()  # workers are kept and share their executor's memory


def runs_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Cut Arrow batches of sorted rows where the values of these columns (numbers, booleans) change: the values, and the rows that have them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield tuple(k[lo].item() if hasattr(k[lo], "item") else k[lo] for k in keys), batch.slice(lo, hi - lo)


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``; from now on the session sends tables to Python by ``BATCH_ROWS`` rows at most, as long texts make the usual batches large."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return docs


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns of these names put under others, and how to get its own columns back, as they were, from what becomes of it."""
    own = {n: f"_own_{n}" for n in docs.columns if n in names}
    back = [F.col(own[n]).alias(n) if n in own else F.col(n) for n in docs.columns]
    return docs.withColumnsRenamed(own), lambda out: out.select(back)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a text, A-Z lower-cased.

    Words are runs without ASCII white space. Fewer words than ``size`` give one shingle, the
    whole sequence; no words (or null) give none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(acc)


def set_name(s: np.ndarray) -> tuple[int, int]:
    """The 128-bit name of a set of shingles (of its sorted hashes), as two signed halves."""
    whole = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(whole[0]), int(whole[1])
