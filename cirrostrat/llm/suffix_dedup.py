"""Removal of long repeated byte strings by suffix arrays and longest-previous-factor tests.

A string of ``least`` bytes has one anchor, the smallest hash among its short grams (the first of
equal ones), so equal strings have equal anchors wherever they stand. Each document is cut into
pieces by anchor: the starts of all strings that share an anchor, with the bytes that these strings
cover. Pieces that are equal repeat as a whole and are settled by an aggregate; unequal pieces of one
anchor meet in bounded cells. There a suffix array of the pieces, in corpus order, is built by
prefix doubling to depth ``least``, and the longest-previous-factor array follows from the previous and the next smaller
position in suffix order and the least common prefix on the way there. Its mirror (greater positions) gives the
longest later match. A string goes where either array reaches ``least``, or, if first copies stay, where the first does.

Strings that stand at different distances from their anchor are never equal. The pieces of an anchor that outgrows a cell are therefore
cut by that distance, and meet only under the bytes that all strings of a cut have in common; cuts that still outgrow a cell
are cut into single strings, whose equality is that of their hashes. So the work follows the bytes of a hot anchor, not their square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.llm.cells import assign_cells
from cirrostrat.llm.text import aside, in_small_batches, mix, slices
from cirrostrat.runtime import materialize

#: Bytes of pieces in one cell, and of a document that is hashed at once.
CELL_BYTES, CHUNK = 2_500_000, 1 << 20
#: Distances from the anchor that the cuts of a hot anchor's pieces take together, first and at last.
CUTS = (48, 1)
_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_ODD = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 16), np.uint64(base))])
    return _powers[base][:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` bytes."""
    n = len(data)
    inverse = pow(_ODD, -1, 1 << 64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_ODD, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _power(inverse, n - k + 1))


def anchored_pieces(data: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor) of each piece; starts of strings of ``least`` bytes, all taken once."""
    firsts, counts, anchors = [], [], []
    for at in range(0, max(0, len(data) - least + 1), CHUNK):
        part = data[at : at + CHUNK + least - 1]
        w = least - k + 1
        v = (gram_hashes(part, k) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(part) - k + 1, dtype=np.uint64)
        m = len(v)
        rows = -(-m // w)
        grid = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[:m] = v
        grid = grid.reshape(rows, w)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(right[: m - w + 1], left[w - 1 : m]) & np.uint64(0xFFFFFFFF)
        edge = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        firsts.append(edge + at)
        counts.append(np.diff(np.r_[edge, len(low)]))
        anchors.append(low[edge].astype(np.int64) + at)
    if not firsts:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(anchors)


def _signed(x: Sequence[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _cuts(raw: bytes, s: int, n: int, a: int, least: int, g: int) -> Iterator[tuple[int, int, int]]:
    """(start, number of starts, key) of a piece's strings by ``g`` distances to the anchor at ``a``; the key names what they all hold."""
    for j in range((a - s - n + 1) // g, (a - s) // g + 1):
        lo, hi = max(s, a - (j + 1) * g + 1), min(s + n - 1, a - j * g)
        yield lo, hi - lo + 1, xxhash.xxh3_64_intdigest(raw[a - j * g : a - (j + 1) * g + 1 + least], seed=j + 1)


def _anchor_rows(least: int, k: int, cuts: Sequence[int] = ()):
    """Rows of pieces; with ``cuts``, of the cut pieces of those whose key (anchor, then cut by cut) is among the row's ``hot`` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            hot = batch.column("hot").to_pylist() if cuts else [()] * batch.num_rows
            for doc, rid, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rid", "text")), hot, strict=True):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                if len(raw) < least:
                    continue
                own: dict[tuple[int, int], list[int]] = {}  # a periodic text has a piece many times
                keys = set(wanted)
                first, count, anchor = anchored_pieces(np.frombuffer(raw, np.uint8), least, k)
                for s, n, a in zip(first.tolist(), count.tolist(), anchor.tolist(), strict=True):
                    found = [(s, n, xxhash.xxh3_64_intdigest(raw[a : a + k]))]
                    for g in cuts:
                        found = [c for s1, n1, key in found if _to_signed(key) in keys for c in _cuts(raw, s1, n1, a, least, g)]
                    for s1, n1, key in found:
                        kind = (key, xxhash.xxh3_64_intdigest(raw[s1 : s1 + n1 + least - 1]))
                        if (seen := own.get(kind)) is None:
                            own[kind] = [n1, s1]
                        else:
                            seen.append(s1)
                rows += [(doc, rid, at[1], at[0], *kind, at[2:] or None) for kind, at in own.items()]
            if rows:
                doc, rid, start, n, key, mark, more = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in (doc, rid, start, n)), _signed(key), _signed(mark), pa.array(more, pa.list_(pa.int64()))],
                    names=["doc_id", "rid", "start", "n", "key", "mark", "more"],
                )

    return run


def _to_signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The given starts that share ``depth`` bytes with another one, in suffix order, and their classes (numbered upwards).

    Prefix doubling from eight bytes; suffixes that differ from all others already keep their rank
    and are sorted no further.
    """
    n = len(data)
    padded = np.r_[data, np.zeros(depth + 8, np.uint8)]
    h = min(8, depth)
    first = np.zeros(n, np.uint64)
    for i in range(h):
        first = (first << np.uint64(8)) | padded[i : n + i].astype(np.uint64)
    live = np.argsort(first, kind="stable").astype(np.int32)
    first = first[live]
    fresh = np.r_[True, first[1:] != first[:-1]]
    del first, padded
    rank = np.zeros(n + depth, np.int32)
    rank[live] = _begins(fresh) + 1
    live = live[_shared(fresh)]
    while 2 * h <= depth and len(live):
        live, fresh = _refine(rank, live, h, update=True)
        live = live[_shared(fresh)]
        h *= 2
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    live = live[wanted[live]]
    if h < depth and len(live):
        live, fresh = _refine(rank, live, depth - h, update=False)
    elif len(live):
        fresh = np.r_[True, rank[live][1:] != rank[live][:-1]]
    else:
        return live.astype(np.int64), live.astype(np.int64)
    keep = _shared(fresh)
    return live[keep].astype(np.int64), (np.cumsum(fresh) - 1)[keep]


def _shared(fresh: np.ndarray) -> np.ndarray:
    """Of runs that begin where ``fresh``, the members of those longer than one."""
    return ~(fresh & np.r_[fresh[1:], True])


def _refine(rank: np.ndarray, live: np.ndarray, shift: int, update: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sort ``live`` by rank and by the rank ``shift`` further on; if ``update``, split the ranks."""
    both = (rank[live].astype(np.int64) << 32) | rank[live + shift]
    order = np.argsort(both, kind="stable").astype(np.int32)
    live, both = live[order], both[order]
    del order
    fresh = np.r_[True, both[1:] != both[:-1]]
    if update:
        old = (both >> 32).astype(np.int32)
        del both
        outer = np.r_[True, old[1:] != old[:-1]]
        rank[live] = old + _begins(fresh) - _begins(outer)
    return live, fresh


def _begins(fresh: np.ndarray) -> np.ndarray:
    """Where the run of each element begins."""
    return np.flatnonzero(fresh).astype(np.int32)[np.cumsum(fresh, dtype=np.int32) - 1]


def _to_smaller(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix, the common prefix with the nearest one before it in suffix order that has a smaller position (0: none).

    All suffixes step back at once, over what they have passed already, until they meet a smaller position or share nothing.
    """
    at, common = np.arange(len(order)) - 1, lcp.copy()
    common[:1] = 0
    open_ = np.flatnonzero(common)
    while len(open_):
        open_ = open_[order[at[open_]] > order[open_]]
        p = at[open_]
        common[open_], at[open_] = np.minimum(common[open_], common[p]), at[p]
        open_ = open_[common[open_] > 0]
    return common


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array, in suffix order: the longest match of each suffix that starts earlier.

    It is with the previous or the next smaller position in suffix order. ``lcp``: common prefix of each suffix with the one before.
    """
    back = np.zeros_like(lcp)
    back[1:] = lcp[:0:-1]
    return np.maximum(_to_smaller(order, lcp), _to_smaller(order[::-1], back)[::-1])


def following_factors(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The mirror: the longest match of each suffix that starts later."""
    return previous_factors(-order, lcp)


def common_prefixes(classes: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix with the one before, up to ``depth``; shorter ones count as 0."""
    return np.where(np.diff(classes, prepend=-1) > 0, 0, depth)


def earlier_matches(order: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which suffixes have a previous factor of the full depth."""
    return previous_factors(order, common_prefixes(classes, 1)) > 0


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _match_cell(least: int, first: bool):
    def run(table: pa.Table) -> pa.Table:
        pieces: dict[tuple[int, int], tuple] = {}
        for doc, rid, start, n, key, mark, piece in zip(*(table.column(c).to_pylist() for c in ("doc_id", "rid", "start", "n", "key", "mark", "piece")), strict=True):
            pieces[(key, mark)] = (doc is None, doc or 0, rid, start, n, piece)
        ordered = sorted(pieces.values(), key=lambda p: p[:4])
        data = np.frombuffer(b"".join(p[5] for p in ordered), np.uint8)
        sizes = np.array([len(p[5]) for p in ordered])
        offsets = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        counts = np.array([p[4] for p in ordered], np.int64)
        starts = np.repeat(offsets, counts) + np.arange(counts.sum()) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
        order, classes = suffix_order(data, starts, least)
        lcp = common_prefixes(classes, least)
        goes = previous_factors(order, lcp) >= least
        if not first:
            goes |= following_factors(order, lcp) >= least
        flags = np.zeros(len(data), bool)
        flags[order[goes]] = True
        found: dict[tuple[int | None, int], list[dict[str, int]]] = {}
        for p, offset in zip(ordered, offsets.tolist(), strict=True):
            for a, b in _runs(flags[offset : offset + p[4]]):
                found.setdefault((None if p[0] else p[1], p[2]), []).append({"lo": p[3] + a, "hi": p[3] + b - 1 + least})
        return pa.table({"doc_id": pa.array([d for d, _ in found], pa.int64()), "rid": pa.array([r for _, r in found], pa.int64()), "spans": pa.array(list(found.values()), _SPANS)})

    return run


def _cut_pieces(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, rid, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rid", "text", "wanted")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(w["cell"], doc, rid, w["start"], w["n"], w["key"], w["mark"], raw[w["start"] : w["start"] + w["n"] + least - 1]) for w in wanted]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary())], names=["cell", "doc_id", "rid", "start", "n", "key", "mark", "piece"])

    return run


_PIECES = "doc_id long, rid long, start long, n long, key long, mark long, more array<long>"


def _copies():
    return F.lit(1) + F.greatest(F.size("more"), F.lit(0))


def _repeated(pieces: DataFrame) -> DataFrame:
    """The pieces whose key occurs more than once, and whether ``several`` different pieces have it."""
    met = pieces.groupBy("key").agg(F.sum(_copies()).alias("c"), F.min("mark").alias("m0"), F.max("mark").alias("m1")).where("c > 1")
    return materialize(pieces.join(met.select("key", (F.col("m0") != F.col("m1")).alias("several")), "key"), "repeated")


def _of_rows(rows: DataFrame, about: DataFrame) -> DataFrame:
    """Rows with what is said about them: by id and hash of id and text, of which rows without an id have the hash alone."""
    other = about.select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), *[c for c in about.columns if c not in ("doc_id", "rid")])
    return rows.join(other, (F.col("rid") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d", "_r")


def repeated_spans(docs: DataFrame, least: int = 400, keep_first: bool = True, gram: int = 32, cell: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with ``_spans``: an array of (lo, hi) byte ranges that repeat, unsorted and overlapping.

    A byte lies in a span if some string of ``least`` bytes that covers it also starts elsewhere: at
    any other place, or with ``keep_first`` at an earlier one (by doc_id, then position), so that the
    first copy stays. Matches never cross documents; they are judged on the input. Null, empty and
    shorter texts have no spans. Rows that repeat in doc_id and text count as places of their own, but
    hold the same first copy; of rows with a null doc_id none is earlier than one with an id. Other
    columns pass through, but for ``_rid`` and ``_spans``, which are replaced. ``cell``: bytes of pieces that one task compares (``CELL_BYTES``).
    """
    cell = cell or CELL_BYTES
    base = in_small_batches(docs).drop("_rid", "_spans").withColumn("_rid", F.xxhash64("doc_id", "text"))
    rows = base.select("doc_id", "text", F.col("_rid").alias("rid"))
    pieces = materialize(rows.mapInArrow(_anchor_rows(least, gram), _PIECES), "pieces")
    # most anchors occur once; only the others go on
    done, pieces, keys = None, _repeated(pieces), None
    for k in range(len(CUTS)):
        size = pieces.where("several").groupBy("key", "mark").agg(F.first("n").alias("n")).groupBy("key").agg(F.sum(F.col("n") + least - 1).alias("size"))
        hot = materialize(size.where(F.col("size") > cell).select("key"), "hot")
        if hot.isEmpty():
            break
        cool = pieces.join(hot, "key", "left_anti")
        done = cool if done is None else done.unionByName(cool)
        at = pieces.join(hot, "key").groupBy("doc_id", "rid").agg(F.collect_set("key").alias("hot"))
        if keys is not None:
            at = _of_rows(at, keys.withColumnRenamed("hot", "above")).withColumn("hot", F.concat("hot", "above")).drop("above")
        keys = materialize(at, "keys")
        cut = _of_rows(rows, keys).mapInArrow(_anchor_rows(least, gram, CUTS[: k + 1]), _PIECES)
        pieces = _repeated(materialize(cut, "pieces"))
    if done is not None:
        pieces = materialize(done.unionByName(pieces), "repeated")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid", "start", "n")
    kinds = pieces.groupBy("key", "mark").agg(F.sum(_copies()).alias("copies"), F.min(place).alias("at"), F.first("several").alias("several"))
    kinds = materialize(kinds.where("several or copies > 1").select("key", "mark", "copies", "several", "at.doc_id", "at.rid", "at.start", "at.n"), "kinds")
    apart = kinds.where("several").select("key", "mark", "doc_id", "rid", "start", "n", (F.col("n") + least - 1).alias("size"))
    cells = assign_cells(apart, "key", "mark", "size", cell)
    wanted = cells.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("cell", "start", "n", "key", "mark")).alias("wanted"))
    # both joins with the texts read the same columns, so Spark shuffles the texts once
    cut = _of_rows(rows, wanted).mapInArrow(_cut_pieces(least), "cell long, doc_id long, rid long, start long, n long, key long, mark long, piece binary")
    near = cut.groupBy("cell").applyInArrow(_match_cell(least, keep_first), "doc_id long, rid long, spans array<struct<lo: long, hi: long>>")
    equal = kinds.where("copies > 1").select("key", "mark", F.col("doc_id").alias("d0"), F.col("rid").alias("r0"), F.col("start").alias("s0"))
    starts = F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<long>")))
    if keep_first:
        starts = F.filter(starts, lambda s: ~(F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("rid") == F.col("r0")) & (s == F.col("s0"))))
    spans = F.transform(starts, lambda s: F.struct(s.alias("lo"), (s + F.col("n") + least - 1).alias("hi")))
    whole = pieces.join(equal, ["key", "mark"]).select("doc_id", "rid", spans.alias("spans")).where(F.size("spans") > 0)
    spans = near.union(whole).groupBy(F.col("doc_id").alias("_d"), F.col("rid").alias("_r")).agg(F.flatten(F.collect_set("spans")).alias("_spans"))
    return base.join(spans, (F.col("_rid") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_rid", "_d", "_r")


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of (lo, hi) ranges; runs that touch are one."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in runs:
        out.append(raw[at:lo])
        at = hi
    return b"".join([*out, raw[at:]])


def kept_text(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the runs; characters of which a run covers a part only stay."""
    raw = text.encode("utf-8", "surrogatepass")
    whole = []
    for lo, hi in runs:
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        whole.append((lo, hi))
    return kept_bytes(raw, whole).decode("utf-8", "surrogatepass")


def _digest(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, kept = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                raw, runs = text.encode("utf-8", "surrogatepass") if text else b"", merged(spans)
                rows.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(raw, runs)).hexdigest()))
                if texts:
                    kept.append(kept_text(text, runs) if runs else text)
            cols = list(zip(*rows, strict=True))
            columns, names = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.string())] if texts else [])], names=[*names, *(["text"] if texts else [])])

    return run


def removal_digest(spans: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what ``repeated_spans`` returns; with ``texts``, what is kept too.

    The kept text is that of the kept bytes, but for characters of which a span covers a part only: these stay whole. Null texts stay null.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if texts else "")
    return spans.select("doc_id", "text", "_spans").mapInArrow(_digest(texts), schema)


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [kept_text(t, merged(s)) if s else t for t, s in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
        names = [n for n in batch.schema.names if n != "_spans"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)


def without_repeats(docs: DataFrame, least: int = 200, keep_first: bool = True) -> DataFrame:
    """``docs`` with repeated passages removed from the texts; every row and column stays."""
    rows, own = aside(docs, "_rid", "_spans", "_d", "_r", "rid")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    found = repeated_spans(rows, least, keep_first).select(*rows.columns, "_spans")
    return own(found.mapInArrow(_cut_text, schema))
