"""Exact Jaccard self-join of documents on word shingles, by parity sketches.

Each shingle toggles one bit of a sketch, so the Hamming distance of two sketches never exceeds
the symmetric difference of the sets. Two sets of sizes a and b with similarity t differ in at
most (a + b)(1 - t)/(1 + t) shingles. A size band fixes the largest such number d; the sketch is
cut into d + 1 + e segments, so sets that link agree in at least 1 + e of them (pigeonhole) and
meet in a join on (band, segment, content). Agreement on shingles that many documents share says
little, so the commonest ones (any choice is exact) have one more segment of their own, which is no
key. Other segments that hold no shingle say nothing either: a document with at most e of them
leaves them out and still meets every partner in a full one; a document with more emits them all,
as does then every partner that agrees with it only there.

Documents that meet form families (a superset of the components). Families are verified in
bounded cells: dense sketches bound the symmetric difference by popcount, and what is left is
compared exactly, unless both are known to hang together already. Only the links of a spanning
forest leave a task, never the pairs of a group. Documents with equal sets share one node
throughout, so exact copies cost nothing beyond their own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cirrostrat.llm.cells import assign_cells
from cirrostrat.llm.text import aside, in_small_batches, mix, set_name, shingles, slices
from cirrostrat.operators.graph import connected_components
from cirrostrat.runtime import discard, materialize

#: Shingles of one verification cell, and the most shingles that count as common (8 bytes each in a worker).
CELL_SHINGLES, COMMON = 1_000_000, 1_000_000
#: Distinct texts in which a shingle is seen, where a batch has it twice, to be common.
COMMON_TEXTS = 8
#: Parts into which the names under a frequent key are dealt; the part of the documents (one in so many) in which keys are counted, and the rows
#: there that make one frequent; how many keys count as frequent at most. They spread the work, and change no link.
SALTS, SAMPLED, HOT_ROWS, HOT_KEYS = 64, 64, 64, 10_000


class Bands:
    """Size bands for a similarity of ``num / den`` or more: linked sets lie in one band or in neighbours."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]
        self._segments: dict[int, tuple[int, int]] = {}
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        while self.edges[-1] <= n:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)

    def band(self, n: int) -> int:
        self._grow(n)
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def differ(self, a: int, b: int) -> int:
        """The most elements in which linked sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def segments(self, band: int) -> tuple[int, int]:
        """(segments of a band's sketch but that of the common shingles, spare ones).

        So many are spare that few documents have more empty segments than that, given how many
        shingles fall into each by chance, but not more than half of the others.
        """
        if band not in self._segments:
            self._grow(self.edges[band] * self.den // self.num + 1)
            low, top = self.edges[band], self.edges[band + 1] - 1
            d, spare = self.differ(top, top), 1
            while spare < (d + 1) // 2:
                empty = (d + 1 + spare) * np.exp(-0.85 * low / (d + 1 + spare))
                if spare >= empty + 4 * np.sqrt(empty) + 1:
                    break
                spare += 1
            self._segments[band] = d + 1 + spare, spare
        return self._segments[band]

    def needs_join(self, n: int) -> bool:
        """Whether a set of another content can link at all."""
        return self.differ(n, n * self.den // self.num) > 0


def segment_keys(s: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """Keys of a set's sketch segments in a band: an XOR of its tokens' bits, hashed with band and segment (s: without the common shingles)."""
    total, spare = bands.segments(band)
    tag = mix(s + np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    seg = (tag >> np.uint64(32)) % np.uint64(total)
    order = np.argsort(seg, kind="stable")
    seg, bit = seg[order], mix(tag)[order]
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else np.empty(0, np.int64)
    content, seg = (np.bitwise_xor.reduceat(bit, first), seg[first]) if len(seg) else (bit, seg)
    if total - len(seg) > spare:
        missing = np.setdiff1d(np.arange(total, dtype=np.uint64), seg)
        seg, content = np.r_[seg, missing], np.r_[content, np.zeros(len(missing), np.uint64)]
    return mix(content ^ mix(seg + np.uint64(band << 32)))


def member_id(node: int, band: int) -> int:
    """The name of a node among those of a band: families do not reach from band to band."""
    return int(mix(np.array([(node ^ (band + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1], np.uint64)).view(np.int64)[0])


def _members(node: int, n: int, bands: Bands) -> list[int]:
    k = bands.band(n)
    return [member_id(node, k), member_id(node, k + 1)]


def _roots(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """The least node that each node of the pairs hangs together with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (x := find(x)) != (y := find(y)):
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def _key_rows(size: int, num: int, den: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, common = Bands(num, den), shared.value
        for batch in slices(batches):
            keys, nodes, seen = [], [], set()
            for text in batch.column("text").to_pylist():
                s = shingles(text, size)
                if not len(s) or not bands.needs_join(len(s)):
                    continue
                if (name := set_name(s)) in seen:
                    continue
                seen.add(name)
                k, rare = bands.band(len(s)), s
                if len(common):
                    rare = s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s]
                # as the larger or equal partner in its own band, as the smaller one in the next
                for band, member in zip((k, k + 1), _members(name[0], len(s), bands), strict=True):
                    keys.append(segment_keys(rare, band, bands))
                    nodes.append(np.full(len(keys[-1]), member, np.int64))
            if not keys:
                continue
            key, node = np.concatenate(keys).view(np.int64), np.concatenate(nodes)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            # combine: nodes that meet within this batch hang on the least of them, which alone goes on
            # under their keys; their own rows have keys of their own, which spreads a hot group
            fresh = np.r_[True, key[1:] != key[:-1]]
            least = node[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
            root = _roots(least[~fresh], node[~fresh])
            up = np.array([root.get(x, x) for x in node[fresh].tolist()], np.int64)
            below = np.array([(x, r) for x, r in root.items() if x != r], np.int64).reshape(-1, 2)
            rows = np.unique(np.stack([key[fresh], up, up], 1), axis=0) if root else np.stack([key, node, node], 1)
            rows = np.r_[rows, np.stack([mix(below[:, 0].view(np.uint64).copy()).view(np.int64), below[:, 1], below[:, 0]], 1)]
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["key", "lo", "hi"])

    return run


def _node_rows(size: int, num: int, den: int):
    """Rows of documents; the first of each batch also has the shingles that several of its texts share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in slices(batches):
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            ids = [set_name(s) if len(s) else None for s in sets]
            once = dict(zip(ids, sets, strict=True))
            once.pop(None, None)
            values, counts = np.unique(np.concatenate([*once.values(), np.empty(0, np.uint64)]), return_counts=True)
            often = counts > 1
            common = [dict(s=a, c=b) for a, b in zip(values[often].view(np.int64).tolist(), counts[often].tolist(), strict=True)]
            members = [_members(i[0], len(s), bands) if len(s) and bands.needs_join(len(s)) else [] for i, s in zip(ids, sets, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row_key"), *(pa.array([i and i[h] for i in ids], pa.int64()) for h in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array(members, pa.list_(pa.int64())),
                    pa.array([common] + [None] * (len(sets) - 1), pa.list_(pa.struct([("s", pa.int64()), ("c", pa.int64())]))),
                ],
                names=["doc_id", "row_key", "node", "half", "n_shingles", "members", "common"],
            )

    return run


def dense_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity sketches of one width, in 64-bit words; about eight bits for each element of the largest set."""
    words = int(min(256, max(4, -(-max(map(len, sets)) // 8))))
    out = np.zeros((len(sets), words), np.uint64)
    for row, s in zip(out, sets, strict=True):
        bit = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(64 * words)
        odd = np.flatnonzero(np.bincount(bit.astype(np.int64), minlength=64 * words) & 1)
        np.bitwise_or.at(row, odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    return out


def forest_links(nodes: list[int], sets: list[np.ndarray], blocks: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the similarity graph (between blocks only, if there are two)."""
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = np.argsort([len(s) for s in sets], kind="stable")
    nodes, sets = [nodes[i] for i in order], [sets[i] for i in order]
    block, sizes = np.array(blocks)[order], np.array([len(s) for s in sets])
    sketch = dense_sketches(sets) if len(sets) > 2 else None
    apart, links = len(set(blocks)) > 1, []
    for i in range(len(sets) - 1):
        stop = int(np.searchsorted(sizes, sizes[i] * den // num, side="right"))
        other = np.arange(i + 1, stop)
        if apart:
            other = other[block[other] != block[i]]
        if sketch is not None and len(other):
            near = np.bitwise_count(sketch[other] ^ sketch[i]).sum(1, dtype=np.int64)
            other = other[near <= (sizes[other] + sizes[i]) * (den - num) // (den + num)]
        for j in other:
            if find(i) != find(int(j)):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if den * both >= num * (sizes[i] + sizes[j] - both):
                    root[find(i)] = find(int(j))
                    links.append((nodes[i], nodes[j]))
    return links


def _verify(size: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        families: dict[int, dict[int, tuple[np.ndarray, int]]] = {}
        for family, at, node, half, block, text in zip(*(table.column(c).to_pylist() for c in ("family", "set", "node", "half", "block", "text")), strict=True):
            own = families.setdefault(family, {})
            if at not in own and set_name(s := shingles(text, size)) == (node, half):
                own[at] = (s, block)
        links = []
        for own in families.values():
            if len(own) > 1:
                links += forest_links(list(own), [s for s, _ in own.values()], [b for _, b in own.values()], num, den)
        return pa.table({"src": pa.array([a for a, _ in links], pa.int64()), "dst": pa.array([b for _, b in links], pa.int64())})

    return run


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when ``den * |A & B| >= num * |A | B|`` on their sets of ``size``-word
    shingles; component_id is the least doc_id that links reach. Texts that are null or without
    words have no shingles and stand alone; rows without an id link like others (the least of no
    ids is null). Shorter texts are one shingle and link with equal ones only. Rows
    that repeat an id are judged each by their own text. Other columns are not read; an empty
    table gives no rows. Sets are compared by 64-bit hashes of their shingles and
    named by 128 bits of those.
    """
    return _judged(docs, size, num, den).select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"))


def _judged(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key (of id and text), node, n_shingles and ``head``, the first row (z, doc_id, row_key) of its component."""
    docs = in_small_batches(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    schema = "doc_id long, row_key long, node long, half long, n_shingles long, members array<long>, common array<struct<s: long, c: long>>"
    nodes = materialize(docs.mapInArrow(_node_rows(size, num, den), schema), "nodes")
    shared = nodes.where("common is not null").select(F.explode("common").alias("e")).groupBy("e.s").agg(F.sum("e.c").alias("c"))
    often = shared.where(F.col("c") >= COMMON_TEXTS).orderBy(F.desc("c"), "s").limit(COMMON).select("s").toArrow().column("s").to_numpy()
    common = docs.sparkSession.sparkContext.broadcast(np.sort(often.astype(np.int64).view(np.uint64)))
    rows = docs.select("text").mapInArrow(_key_rows(size, num, den, common), "key long, lo long, hi long")
    # keys that many rows of a part of the documents hold meet in SALTS parts, each linked to a node of the key's own, so that no task holds a frequent key
    seen = docs.where(F.pmod("row_key", F.lit(SAMPLED)) == 0).select("text").mapInArrow(_key_rows(size, num, den, common), "key long, lo long, hi long")
    hot = seen.groupBy("key").count().where(F.col("count") >= HOT_ROWS).orderBy(F.desc("count"), "key").limit(HOT_KEYS).select("key", F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("lo", F.lit(SALTS))).otherwise(0))
    met = rows.select("lo", "hi", F.min("lo").over(Window.partitionBy("key", "salt")).alias("first"), F.when(F.col("hot"), F.xxhash64("key", F.lit("key"))).alias("top"))
    pairs = (("first", "lo"), ("lo", "hi"), ("first", "top"))
    edges = met.select(F.explode(F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in pairs])).alias("e")).select("e.*")
    families = connected_components(edges.where("src <> dst"))
    one = nodes.where("node is not null").groupBy("node", "half").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_key", "n_shingles")).alias("r"), F.first("members").alias("members"))
    # a set's number stands for its 128-bit name in links
    one = materialize(one.select(F.monotonically_increasing_id().alias("set"), "node", "half", "r.z", "r.doc_id", "r.row_key", "r.n_shingles", "members"), "sets")
    spread = one.select("set", "node", "half", "row_key", "n_shingles", F.explode("members").alias("id"))
    members = materialize(spread.join(families.select("id", F.col("component").alias("family")), "id").drop("id"), "members")
    cells = assign_cells(members, "family", "set", "n_shingles", CELL_SHINGLES)
    # by what the row holds, so that rows without an id are found; a merge join at every size: members grow with the documents
    texts = docs.join(cells.select("row_key", "set", "node", "half", "family", "cell", "block").hint("merge"), "row_key")
    links = texts.select("cell", "family", "set", "node", "half", "block", "text").groupBy("cell").applyInArrow(_verify(size, num, den), "src long, dst long")
    parts = connected_components(links).withColumnRenamed("id", "set")
    # the least row of a set, and of the sets that links join, rows without an id last; then to every row of the set
    own = one.select("set", "node", "half", F.struct("z", "doc_id", "row_key").alias("first"))
    least_of = parts.join(own, "set").groupBy("component").agg(F.min("first").alias("joined"))
    heads = own.join(parts.join(least_of, "component").select("set", "joined"), "set", "left")
    heads = materialize(heads.select("node", "half", F.coalesce("joined", "first").alias("head")), "heads")
    discard(one, members)
    return nodes.join(heads, ["node", "half"], "left").select("doc_id", "row_key", "node", "n_shingles", "head")


def keep_one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without near copies: of each component one row stays, that of the least doc_id (none last); all columns are kept.

    Rows are judged by id and text. Of rows that agree in both, the least by all columns stays.
    Texts without words are copies of nothing.
    """
    rows, own = aside(docs, "_id", "_key", "_gone", "_n", "_row_key", "_whole")
    found = _judged(rows, size, num, den).where("node is not null")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("row_key") == F.col("head.row_key"))
    marks = found.groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).agg(F.max(~is_head).alias("_gone"), F.count("*").alias("_n"))
    marks = materialize(marks.where("_gone or _n > 1"), "marks")
    keyed = rows.withColumn("_row_key", F.xxhash64("doc_id", "text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key"))
    kept = own(keyed.join(marks, same, "left_anti"))
    repeated = marks.where("not _gone")
    if repeated.isEmpty():
        return kept
    whole = F.struct(*rows.columns)
    ones = keyed.join(repeated, same, "left_semi").groupBy("doc_id", "_row_key").agg(F.min_by(whole, F.to_json(whole)).alias("_whole"))
    return kept.union(own(ones.select(*[F.col("_whole")[c].alias(c) for c in rows.columns])))


#: DuckDB SQL of ``jaccard_components`` over documents, with three words and 90 / 100.
COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(ws[i:i + 2]) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
