"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

The automaton holds every run of words of every item. A document's words stream through it; the
length of the longest run that ends at each word tells the spans to remove: runs of ``window``
words or more, and whole items that are shorter than a window (full coverage).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.llm.text import aside, in_small_batches, mix, runs_of, slices
from cirrostrat.runtime import discard, materialize

#: Words of one automaton (about 1 kB each in a worker), and of the items whose windows (16 bytes each) one scan of the documents looks for.
SHARD_WORDS, FILTER_WORDS = 200_000, 4_000_000
#: Texts that one automaton of a shard of a long benchmark is built for.
PART_TEXTS = 20_000

_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of items, each a list of word ids."""

    def __init__(self, items: dict[tuple[str | None, int], list[bytes]], window: int):
        self.window, self.vocab = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.holders: list[set[str]] = [set()]
        ends: list[tuple[tuple[str | None, int], list[int]]] = []
        self.shortest = window
        for name, words in items.items():
            if not words:
                continue
            self.shortest = min(self.shortest, len(words))
            last, path = 0, []
            for w in words:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                path.append(last)
            ends.append((name, [self.vocab[w] for w in words]))
        #: for a state: items of which a window (or the whole, if shorter) ends there
        self.hits: dict[int, tuple[int, set[str]]] = {}
        for name, ids in ends:
            size, state, held = min(window, len(ids)), 0, 0
            for w in ids:
                state, held = self.step(state, held, w)
                while self.length[self.link[state]] >= size if state else False:
                    state = self.link[state]
                    held = self.length[state]
                if held >= size:
                    self.hits.setdefault((state, size), set()).add(name)
        short = sorted({size for _, size in self.hits} - {window}, reverse=True)
        self.short = short

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def step(self, state: int, held: int, c: int) -> tuple[int, int]:
        """The state of the longest match after the word ``c``, and its length."""
        nxt = self.next[state].get(c)
        while nxt is None:
            state = self.link[state]
            if state < 0:
                return 0, 0
            held = self.length[state]
            nxt = self.next[state].get(c)
        return nxt, held + 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal spans [from, to) of words inside occurrences of windows, and the items that they come from."""
        spans: list[list[int]] = []
        found: set[str] = set()
        ids = np.fromiter(map(self.vocab.get, words, [-1] * len(words)), np.int64, len(words)) if self.vocab else np.empty(0)
        edges = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False].astype(np.int8)))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if hi - lo < self.shortest:  # words outside the vocabulary end every match
                continue
            state = held = 0
            for i, c in enumerate(ids[lo:hi].tolist(), lo):
                state, held = self.step(state, held, c)
                if held < self.shortest:
                    continue
                for size in (self.window, *self.short):
                    if held < size:
                        continue
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    if (got := self.hits.get((at, size))) is not None:
                        found |= got
                        if spans and spans[-1][1] >= i + 1 - size:
                            spans[-1][0], spans[-1][1] = min(spans[-1][0], i + 1 - size), i + 1
                            while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                                top = spans.pop()
                                spans[-1] = [min(spans[-1][0], top[0]), max(spans[-1][1], top[1])]
                        else:
                            spans.append([i + 1 - size, i + 1])
        return [(a, b) for a, b in spans], found


def _merged(found: list[int]) -> list[int]:
    """The union of spans, from and to in turn."""
    out: list[int] = []
    for lo, hi in sorted(zip(found[::2], found[1::2], strict=True)):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def _sorted_items(names: set[str | None]) -> list[str | None]:
    return sorted(names, key=lambda n: (n is None, n or ""))


def _cutter(shared, most: float | None = None):
    """Add words, spans and items: those of one automaton, or (without) those that come with the rows. With ``most``, cut them out and leave out documents of which more is hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            if shared is not None:
                found = []
                for text in texts:
                    words = words_of(text)
                    hit, named = shared.value.scan(words)
                    found.append((len(words), [x for span in hit for x in span], _sorted_items(named)))
            else:
                known = zip(texts, batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                found = [(len(words_of(text)), _merged(s or []), _sorted_items(set(i or ()))) for text, s, i in known]
            names = [c for c in batch.schema.names if c not in ("n_words", "spans", "items")]
            if most is None:
                added = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *added], names=[*names, "n_words", "spans", "items"])
                continue
            kept = pa.array([sum(s[1::2]) - sum(s[::2]) <= most * n for n, s, _ in found])
            cut = pa.array([cut_words(t, s) if s else t for t, (_, s, _) in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([cut if c == "text" else batch.column(c) for c in names], names=names).filter(kept)

    return run


def _window_names(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit name of every run of ``size`` words; unlike runs that share one cost work only, as automata decide."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < size:
        return np.empty(0, np.int64)
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return acc.view(np.int64)


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, shard in zip(batch.column("text").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                words = words_of(text)
                if size := min(window, len(words)):
                    name = np.unique(_window_names(words, size))
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.full(len(name), shard)), pa.array(np.full(len(name), size))], names=["name", "shard", "size"])

    return run


def _sent(shared):
    """The texts that hold windows, once for each shard that has them, with two hashes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard, sizes = shared.value
        for batch in slices(batches):
            at, to = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                words, goes = words_of(text), set()
                for size in sizes:
                    own = _window_names(words, size)
                    lo, hi = np.searchsorted(name, own, "left"), np.searchsorted(name, own, "right")
                    for a, b in np.unique(np.stack([lo, hi], 1)[lo < hi], axis=0).tolist():
                        goes.update(shard[a:b].tolist())
                at += [k] * len(goes)
                to += sorted(goes)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("_k1"), rows.column("_k2"), rows.column("text"), pa.array(to, pa.int64())], names=["_k1", "_k2", "text", "shard"])

    return run


def _shard_hits(window: int):
    """Rows come by shard and part, items before texts: an automaton is built, then texts stream through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, items, automaton = None, {}, None
        for (shard, part, is_text), batch in runs_of(batches, "shard", "part", "is_text"):
            if (shard, part) != group:
                group, items, automaton = (shard, part), {}, None
            if not is_text:
                for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    items[name, len(items)] = words_of(text)
                continue
            if automaton is None:
                automaton, items = _automaton(items, window), {}
            for some in slices(iter([batch])):
                found = [automaton.scan(words_of(text)) for text in some.column("text").to_pylist()]
                spans = pa.array([[x for span in s for x in span] for s, _ in found], pa.list_(pa.int64()))
                named = pa.array([_sorted_items(names) for _, names in found], pa.list_(pa.string()))
                out = pa.RecordBatch.from_arrays([some.column("_k1"), some.column("_k2"), spans, named], names=["_k1", "_k2", "spans", "items"])
                yield out.filter(pa.array([bool(s) for s, _ in found]))

    return run


def _hits_by_shard(docs: DataFrame, items: DataFrame, words: int, window: int) -> DataFrame:
    """(_k1, _k2, spans, items) of the texts that are hit, of items dealt to shards of about half ``SHARD_WORDS``.

    One scan of ``docs`` for each ``FILTER_WORDS`` words of items, with the sorted names of their windows as a broadcast, finds the texts that hold one and the
    shards that know it. Only those texts are shuffled, dealt in parts of ``PART_TEXTS``, each of which builds the automaton of its shard.
    """
    spark, shards = docs.sparkSession, -(-2 * words // SHARD_WORDS)
    dealt = materialize(items.distinct().withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards))), "items")
    windows = materialize(dealt.mapInArrow(_item_windows(window), "name long, shard long, size long").distinct(), "windows")
    together, sent = max(1, FILTER_WORDS * shards // words), []
    keyed = _keyed(docs.select("text"))
    for lo in range(0, shards, together):
        some = windows.where(F.col("shard").between(lo, lo + together - 1)).toArrow()
        order = np.argsort(some.column("name").to_numpy(), kind="stable")
        shared = spark.sparkContext.broadcast((some.column("name").to_numpy()[order], some.column("shard").to_numpy()[order], sorted(set(some.column("size").to_pylist()))))
        sent.append(materialize(keyed.mapInArrow(_sent(shared), "_k1 long, _k2 long, text string, shard long"), "sent"))
        shared.destroy()
    texts = reduce(DataFrame.union, sent)
    parts = texts.groupBy("shard").agg(F.ceil(F.count("*") / PART_TEXTS).alias("parts"))
    nothing = F.lit(None)
    known = dealt.join(F.broadcast(parts), "shard").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_text"), "item", "text",
        nothing.cast("long").alias("_k1"), nothing.cast("long").alias("_k2"),
    )
    asked = texts.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(parts), "shard").select(
        "shard", F.pmod(F.xxhash64("at"), "parts").alias("part"), F.lit(True).alias("is_text"), nothing.cast("string").alias("item"), "text", "_k1", "_k2"
    )
    both = known.union(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", "is_text")
    hits = both.mapInArrow(_shard_hits(window), "_k1 long, _k2 long, spans array<long>, items array<string>").distinct()
    out = materialize(hits.groupBy("_k1", "_k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")), "hits")
    discard(dealt, windows, *sent)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, most: float | None = None) -> DataFrame:
    """``docs`` (with a ``text``) plus n_words, spans (word offsets, from and to in turn) and items (ids as strings).

    ``items`` has item_id and text. Null or empty texts have no words and no spans; an item without
    words marks nothing; items that repeat, or share windows, are all named. Items without an id mark
    like any other and are named by one null, the last of ``items``. Other columns pass
    through, but for any of the three names, which are replaced. With ``most``, the spans are cut out of
    the texts instead, and documents of which a larger share of the words is hit are left out. Items of up to ``SHARD_WORDS`` words make one automaton,
    which every task has. Longer benchmarks are dealt to shards (an item with more words is one of its own): documents are scanned once more for the windows of the
    items, and tasks build the automata that the texts found need, so no memory grows with the benchmark.
    """
    spark = docs.sparkSession
    out = in_small_batches(docs).drop("n_words", "spans", "items", "_k1", "_k2")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    schema = f"{schema}, n_words long, spans array<long>, items array<string>" if most is None else schema
    items = items.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    words = items.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0))))).first()[0] or 0
    if words <= SHARD_WORDS:
        held = {(row.item, at): words_of(row.text) for at, row in enumerate(items.toLocalIterator())}  # an id may have several texts
        return out.mapInArrow(_cutter(spark.sparkContext.broadcast(_automaton(held, window)), most), schema)
    hits = _hits_by_shard(out, items, words, window)
    return _keyed(out).join(hits, ["_k1", "_k2"], "left").drop("_k1", "_k2").mapInArrow(_cutter(None, most), schema)


def _automaton(shard: dict[tuple[str | None, int], list[bytes]], window: int) -> SuffixAutomaton:
    automaton = SuffixAutomaton(shard, window)
    automaton.hits = {at: {n for n, _ in names} for at, names in automaton.hits.items()}
    return automaton


def _keyed(docs: DataFrame) -> DataFrame:
    """Two hashes of the text: what is hit depends on nothing else."""
    return docs.withColumns({"_k1": F.xxhash64("text"), "_k2": F.xxhash64(F.lit(1), "text")})


def hit_counts(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, of what ``contamination`` returns.

    As in the SQL, items without an id count as one in n_items and are left out of items_sha256.
    """
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut_words(text: str, spans: list[int]) -> str:
    """The text without the given spans of words; white space at a cut shrinks to what stood before it."""
    data = text.encode("utf-8", "surrogatepass")
    flags = np.frombuffer(data.translate(_KEEP), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for lo, hi in zip(spans[::2], spans[1::2], strict=True):
        out.append(data[at : starts[lo]])
        at = int(starts[hi]) if hi < len(starts) else int(ends[hi - 1])
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most: float = 0.5) -> DataFrame:
    """``docs`` without the contaminated spans; documents of which more than ``most`` of the words are hit go whole. All other columns stay as they are."""
    rows, own = aside(docs, "n_words", "spans", "items", "_k1", "_k2")
    return own(contamination(rows, items, window, most))


#: DuckDB SQL of ``hit_counts`` with windows of ten words over documents and benchmark.
CONTAMINATION_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS s
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, sizes WHERE len(ws) >= size)
), hits AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, s)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
