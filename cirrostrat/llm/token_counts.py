"""Exact token counts for every context limit, from one histogram of encoded lengths."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cirrostrat.llm.text import in_small_batches, slices
from cirrostrat.runtime import materialize

#: Lengths of one block of the suffix sums.
SPAN = 128
#: How byte-level BPE vocabularies of this kind cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are encoded at once; cuts fall where the pattern cuts too, before a space that follows a letter and precedes one.
PIECE = 20_000


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_length(encoding: tiktoken.Encoding, text: str) -> int:
    total, at = 0, 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        total += len(encoding.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(encoding.encode_ordinary(text[at:]))


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, counts = _encoding(path), {}
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                n = encoded_length(encoding, text) if text else 0
                counts[n] = counts.get(n, 0) + 1
            if len(counts) > 100_000:
                yield _rows(counts)
                counts = {}
        yield _rows(counts)

    return run


def _rows(counts: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["n_tokens", "n_docs"])


def length_histogram(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(n_tokens, n_docs) of the whole texts; null and empty texts have length 0. ``vocabulary``: a ranks file that every worker has."""
    partial = in_small_batches(docs).select("text").mapInArrow(_lengths(vocabulary), "n_tokens long, n_docs long")
    return partial.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, as context limit: documents and tokens up to it, above it, and the truncated total.

    One row for each n_tokens: n_docs, docs_above and tokens_above (longer documents), docs_to and
    tokens_to (this long or shorter), truncated_tokens (the corpus cut at this limit) and quantile
    (the share of documents up to it). Any other limit has the counts of the next length below, and
    truncated total tokens_to + limit * docs_above. An empty table gives no rows. Suffix sums run in
    blocks of lengths, with one row for each block carried over.
    """
    h = materialize(histogram.withColumn("block", F.floor(F.col("n_tokens") / SPAN)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "lengths")
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    per = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    zero, every = F.lit(0).cast("long"), Window.partitionBy()
    per = per.select("block", F.coalesce(F.sum("d").over(above), zero).alias("d"), F.coalesce(F.sum("t").over(above), zero).alias("t"), F.sum("d").over(every).alias("all_d"), F.sum("t").over(every).alias("all_t"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    x = h.join(per, "block").select(
        "n_tokens", "n_docs", "all_d", "all_t",
        (F.col("d") + F.coalesce(F.sum("n_docs").over(within), zero)).alias("docs_above"),
        (F.col("t") + F.coalesce(F.sum("tokens").over(within), zero)).alias("tokens_above"),
    )
    return x.select(
        "n_tokens", "n_docs", "docs_above", "tokens_above", (F.col("all_d") - F.col("docs_above")).alias("docs_to"), (F.col("all_t") - F.col("tokens_above")).alias("tokens_to"),
        (F.col("all_t") - F.col("tokens_above") + F.col("n_tokens") * F.col("docs_above")).alias("truncated_tokens"), ((F.col("all_d") - F.col("docs_above")) / F.col("all_d")).alias("quantile"),
    )


def quantile(totals: DataFrame, q: float) -> DataFrame:
    """The least length that a share ``q`` of the documents stays within (one row, null if there are none)."""
    return totals.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
