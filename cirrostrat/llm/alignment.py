"""Alignment of two tokenizers' tokens: union-find over overlapping tokens, links within groups, and distributed counts of linked id pairs.

The tokens of a text under A and B are the two sides of a graph, an edge wherever their byte ranges overlap. Its components are
exactly the minimal groups: runs of A tokens and B tokens between two offsets where both sides end. A task finds them for a
block of texts at once, by hooking roots and halving paths over whole arrays. The members of a component that end together are linked.
Each block hands on its distinct linked pairs with their numbers; their totals over the corpus come back to the block, which meets its
texts' links again as positions in its own list of pairs. So no shuffle carries a row for each link, and a pair has one row a block at most.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from cirrostrat.llm.bpe import byte_symbols, known_only
from cirrostrat.llm.text import in_small_batches, slices
from cirrostrat.llm.token_counts import PATTERN, PIECE
from cirrostrat.runtime import materialize

#: Bytes of text after which a task closes a block (a longer text stands alone), and how far the numbers of two ids lie apart in one long.
BLOCK_BYTES, SIDE = 4_000_000, 32
_SEPARATORS = (",", "|", ";")
_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, block long, link array<int>, times array<int>, pair array<long>, pair_times array<long>"


class ByteLevel:
    """Side A: a byte-level BPE file whose merges stand in the order of their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
        joined = [model["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if joined != sorted(joined):
            raise ValueError(f"{path}: ids do not follow the merges")
        self.table = _by_id(ranks)
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens' strings are plain text. Code points that a library may not know are left to the file's own."""
        if not known_only(text):
            return self.library.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        at = 0
        while at < len(text):
            cut = at + PIECE
            while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
                cut += 1
            ids += self.fast.encode_ordinary(text[at:cut])
            at = cut
        return ids


class Pieces:
    """Side B: a sentence-piece model with byte fallback."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.table = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _by_id(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


@lru_cache(maxsize=2)
def _sides(a: str, b: str) -> tuple[ByteLevel, Pieces, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both sides, the byte lengths of their tokens, and their ids as strings before each separator."""
    left, right = ByteLevel(a), Pieces(b)
    written = [np.array([[f"{i}{s}" for i in range(len(side.table))] for s in _SEPARATORS], dtype=object) for side in (left, right)]
    return left, right, np.array([*map(len, left.table)]), np.array([*map(len, right.table)]), *written


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for edges (u, v) among ``n`` nodes: union-find over whole arrays."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))  # roots hook on lesser roots
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def overlaps(end_a: np.ndarray, len_a: np.ndarray, end_b: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the A and B tokens that share a byte; both sides in order, no token empty."""
    lo = np.searchsorted(end_b, end_a - len_a, side="right")
    size = np.searchsorted(end_b - len_b, end_a, side="left") - lo
    first = np.cumsum(size) - size
    return np.repeat(np.arange(len(end_a)), size), np.arange(size.sum()) + np.repeat(lo - first, size)


class _Block:
    """Texts of one block and their links, until it is closed."""

    def __init__(self):
        self.bytes, self.rows, self.codes = 0, [], []

    def close(self, number: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        sizes = [len(c) for c in self.codes]
        pairs, at, pair_times = np.unique(np.concatenate(self.codes), return_inverse=True, return_counts=True)
        cell, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(pairs)) + at, return_counts=True)
        row, link = np.divmod(cell, max(1, len(pairs)))
        ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(sizes)))]
        offsets, rest = pa.array(ends, pa.int32()), [None] * (len(sizes) - 1)
        columns = [*zip(*self.rows, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:5]), pa.array(columns[5], pa.string()), pa.array(np.full(len(sizes), number)),
                pa.ListArray.from_arrays(offsets, pa.array(link, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                pa.array([pairs, *rest], pa.list_(pa.int64())), pa.array([pair_times, *rest], pa.list_(pa.int64())),
            ],
            names=["doc_id", *(c.split()[0] for c in _ALIGNED.split(", "))],
        )


def align_texts(texts: list[str | None], a: str, b: str) -> list[tuple[int, int, int, int, str, np.ndarray]]:
    """For each text: tokens of A and of B, groups, links, the groups as written ids, and a number for each linked pair of ids."""
    left, right, size_a, size_b, text_a, text_b = _sides(a, b)
    ids_a, ids_b = [], []
    for text, pieces in zip(texts, right.encode([t or "" for t in texts]), strict=True):
        ours, want = (left.encode(" " + text), b" " + text.encode("utf-8", "surrogatepass")) if text else ([], b"")
        same = bool(text) and b"".join(map(left.table.__getitem__, ours)) == want == b"".join(map(right.table.__getitem__, pieces))
        ids_a.append(ours if same else [])
        ids_b.append(pieces if same else [])
    n_a, n_b = np.array([*map(len, ids_a)], np.int64), np.array([*map(len, ids_b)], np.int64)
    flat_a, flat_b = (np.concatenate([np.asarray(i, np.int64) for i in ids]) if ids else np.empty(0, np.int64) for ids in (ids_a, ids_b))
    len_a, len_b = size_a[flat_a], size_b[flat_b]
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)  # texts follow each other on both sides alike
    u, v = overlaps(end_a, len_a, end_b, len_b)
    root = components(u, len(flat_a) + v, len(flat_a) + len(flat_b))
    # members that end together: the links that a component expands to
    at = np.searchsorted(end_b, end_a)
    link_a = np.flatnonzero(end_b[np.minimum(at, len(end_b) - 1)] == end_a) if len(end_a) else np.empty(0, np.int64)
    link_b = at[link_a]
    link_a, link_b = (x[root[link_a] == root[len(flat_a) + link_b]] for x in (link_a, link_b))
    codes = (flat_a[link_a] << SIDE) | flat_b[link_b]
    # components follow each other on both sides; each has tokens of both, A's written first
    group_a, group_b = (np.cumsum(np.r_[False, r[1:] != r[:-1]]) if len(r) else r for r in (root[: len(flat_a)], root[len(flat_a) :]))
    until_a, until_b = (np.r_[0, np.cumsum(np.bincount(g))] for g in (group_a, group_b))
    place_a, place_b = np.arange(len(flat_a)) + until_b[group_a], np.arange(len(flat_b)) + until_a[group_b + 1]
    written = np.empty(len(flat_a) + len(flat_b), dtype=object)
    written[place_a] = text_a[np.r_[group_a[1:] != group_a[:-1], True].astype(int), flat_a] if len(flat_a) else text_a[0, :0]
    written[place_b] = text_b[np.r_[group_b[1:] != group_b[:-1], True] * 2, flat_b] if len(flat_b) else text_b[0, :0]
    bounds, links = np.r_[0, np.cumsum(n_a + n_b)], np.searchsorted(link_a, np.r_[0, np.cumsum(n_a)])
    groups = np.r_[group_a, len(until_a) - 1][np.r_[0, np.cumsum(n_a)]]  # texts begin with a group of their own
    return [
        (int(n_a[i]), int(n_b[i]), int(groups[i + 1] - groups[i]), int(links[i + 1] - links[i]), "".join(written[lo:hi].tolist())[:-1], codes[links[i] : links[i + 1]])
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False))
    ]


def _align(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, kind = _Block(), TaskContext.get().partitionId() << 32, None
        for batch in slices(batches):
            kind = batch.column(0).type
            texts = batch.column(1).to_pylist()
            for doc, text, (*row, codes) in zip(batch.column(0).to_pylist(), texts, align_texts(texts, a, b), strict=True):
                block.rows.append((doc, *row))
                block.codes.append(codes)
                block.bytes += len(text or "")
                if block.bytes >= BLOCK_BYTES:
                    yield from block.close(number, kind)
                    block, number = _Block(), number + 1
        yield from block.close(number, kind)

    return run


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Groups and links of every whole text: doc_id, n_a, n_b, n_groups, n_links, groups, and its links by block, for ``link_counts``.

    ``a``: a byte-level BPE file for space + text; ``b``: a sentence-piece model that adds the space; paths that every worker has. ``groups`` writes
    the ids of each group, ``a1,a2|b1;a3|b2,b3``. Two tokens are linked if their byte ranges end together, so each group has one link, between
    its last tokens. Texts that are null, empty, or not spelled out by both sides byte for byte have no tokens and ''. Repeated rows and null
    ids each have their row; other columns are not read. A block holds up to ``BLOCK_BYTES`` of texts, or one longer text.
    """
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(_align(a, b), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_ALIGNED}")


def _meet(names: list[str]):
    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        at = counts.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        count[at], best[at] = counts.column("count").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
        texts = texts.combine_chunks()
        sizes = np.diff(texts.column("link").combine_chunks().offsets.to_numpy()) if texts.num_rows else np.empty(0, np.int64)
        link, times = (texts.column(c).combine_chunks().flatten().to_numpy() for c in ("link", "times"))
        ends = np.r_[0, np.cumsum(sizes)]
        total, hits = (np.r_[0, np.cumsum(x)] for x in (count[link] * times, best[link] * times.astype(np.int64)))
        out = texts.select(names)
        return out.append_column("n_best", pa.array(np.diff(hits[ends]))).append_column("count_sum", pa.array(np.diff(total[ends])))

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold each pair of ids, and whether that is the highest count of its b. A b has a row for each a at most."""
    pairs = aligned.where("pair is not null").select(F.explode(F.arrays_zip("pair", "pair_times")).alias("p"))
    totals = pairs.groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.pair_times").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit((1 << SIDE) - 1))
    ranked = totals.withColumn("b", b).withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))
    return ranked.select(F.shiftright("pair", SIDE).alias("a"), "b", "count", "best")


def link_counts(aligned: DataFrame) -> DataFrame:
    """The columns of ``aligned`` but its block's own, with n_best and count_sum over each text's links.

    ``aligned`` should be stored, as it is read twice. Totals go back to each block by the pairs it holds, and meet its texts there.
    """
    names = [c for c in aligned.columns if c not in ("block", "link", "times", "pair", "pair_times")]
    held = aligned.where("pair is not null").select("block", F.posexplode("pair").alias("at", "pair"))
    counts = pair_counts(aligned).select((F.shiftleft("a", SIDE).bitwiseOR(F.col("b"))).alias("pair"), "count", "best")
    back = held.join(counts, "pair").select("block", "at", "count", "best")
    texts = aligned.select(*names, F.col("block").alias("of"), "link", "times")
    schema = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in names) + ", n_best long, count_sum long"
    return texts.groupBy("of").cogroup(back.groupBy("block")).applyInArrow(_meet(names), schema)


def alignment_digest(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum): ``align`` with the groups hashed ('' without tokens) and ``link_counts``."""
    aligned = align(docs, a, b)
    hashed = F.when(F.col("n_a") + F.col("n_b") > 0, F.sha2("groups", 256)).otherwise("")
    return link_counts(materialize(aligned.withColumn("groups", hashed).withColumnRenamed("groups", "groups_sha256"), "aligned"))
