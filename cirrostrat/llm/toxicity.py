"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams and of itself, all hashed into one
table; a stretch of a few words is the mean of its distinct words, padded to its length; two linear outputs
and a softmax follow. Table and outputs are trained jointly in numpy on a bounded sample of labelled texts, so unseen misspellings
share the n-grams of the words that they come from. A text is scored by its worst stretches, and training takes
of each text those that the model finds worst among all that it has, so hard clean stretches come from whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cirrostrat.llm.text import aside, in_small_batches, mix, slices
from cirrostrat.runtime import discard, materialize

#: The most labelled texts of either class that training takes, and the most bytes of them together; both are parameters of ``toxicity_scores``.
SAMPLE, SAMPLE_BYTES = 4000, 12_000_000
#: Words of a stretch (the next begins after half of them), and the worst stretches whose mean scores a text.
BUCKETS, DIM, STRETCH, WORST = 1 << 20, 8, 6, 4
#: Every so many-th text of the sample sets the threshold and does not train.
HELD = 5
#: Stretches of a training step, rounds over the texts, and stretches of each text in the first third of them.
BATCH, ROUNDS, DRAWN = 128, 30, 4
#: n-grams of fewer texts of the sample say nothing (their vector is zero), so that no text is learnt by heart.
SUPPORT = 5
#: Fixed point of a word's log-odds in scores, so that sums do not depend on their order.
UNIT = float(1 << 32)
_EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…*#$%&|/\\-_=+~`^@"


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams (3 to 5 characters, with word ends) of each word and of the words themselves, and how many each has."""
    marked = [f"<{w.strip(_EDGE) or w}>" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(marked)), size)
    h, found, of = np.zeros(len(code), np.uint64), [], []
    for n in range(1, 6):
        h = h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n >= 3:
            inside = np.arange(len(h)) + n <= end[: len(h)]
            found.append(mix(h[inside]))
            of.append(owner[: len(h)][inside])
    found.append(np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in marked), np.uint64, len(marked)))
    of.append(np.arange(len(marked)))
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int32), np.bincount(of, minlength=len(marked))


def stretches(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of a text's words as rows of sorted codes, and which of these are a row's first of their kind; one shorter row for a short text."""
    n = len(codes)
    if n <= STRETCH:
        rows = np.sort(codes)[None, :]
    else:
        start = np.arange(0, n - STRETCH + 1, STRETCH // 2)
        start = start if start[-1] + STRETCH == n else np.r_[start, n - STRETCH]
        rows = np.sort(codes[start[:, None] + np.arange(STRETCH)], axis=1)
    first = np.ones(rows.shape, bool)
    first[:, 1:] = rows[:, 1:] != rows[:, :-1]
    return rows, first


class _Bags:
    """The stretches of texts as sparse bags over their distinct words."""

    def __init__(self, texts: list[str | None]):
        at: dict[str, int] = {}
        words, sizes, owner = [], [], []
        for k, text in enumerate(texts):
            codes = np.fromiter((at.setdefault(w, len(at)) for w in words_of(text)), np.int32)
            if len(codes):
                rows, first = stretches(codes)
                words.append(rows[first])
                sizes.append(first.sum(axis=1))
                owner.append(np.full(len(rows), k, np.int32))
        self.word, self.size, self.owner = (np.concatenate(p) if p else np.empty(0, np.int32) for p in (words, sizes, owner))
        self.start = np.r_[0, np.cumsum(self.size)]
        names, parts = list(at), [(np.empty(0, np.int32), np.empty(0, np.int64))]
        for lo in range(0, len(names), 20_000):
            parts.append(subwords(names[lo : lo + 20_000]))
        self.gram = np.concatenate([p[0] for p in parts])
        self.gram_from = np.r_[0, np.cumsum(np.concatenate([p[1] for p in parts]))]

    def support(self) -> np.ndarray:
        """The number of texts that each bucket occurs in."""
        out = np.zeros(BUCKETS, np.int64)
        cuts = np.flatnonzero(np.r_[True, self.owner[1:] != self.owner[:-1], True])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            words = np.unique(self.word[self.start[lo] : self.start[hi]])
            out[np.unique(_ranges(self.gram, self.gram_from, words)[0])] += 1
        return out

    def margins(self, log_odds: np.ndarray) -> np.ndarray:
        words = np.add.reduceat(log_odds[self.gram], self.gram_from[:-1]) / np.diff(self.gram_from)
        return np.add.reduceat(words[self.word], self.start[:-1]) / STRETCH

    def worst(self, value: np.ndarray, k: int) -> np.ndarray:
        """The ``k`` stretches of the highest value of each text."""
        order = np.lexsort((-value, self.owner))
        begins = np.r_[True, self.owner[order][1:] != self.owner[order][:-1]]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
        return order[place < k]


def _ranges(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What lies within the rows' bounds, one after the other, how many each has, and where each begins."""
    lo = bounds[rows]
    count = bounds[rows + 1] - lo
    start = np.r_[0, np.cumsum(count)[:-1]]
    return values[np.arange(count.sum()) - np.repeat(start, count) + np.repeat(lo, count)], count, start


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit on the stretches of labelled texts; returns the log-odds that each bucket adds to a word, and the bias.

    The first third of the rounds takes ``DRAWN`` stretches of each text, drawn anew each time, later ones
    of each text the one among all its own that the model finds worst so far.
    """
    bags, label = _Bags(texts), np.array(labels, np.int64)
    if len(set(label[bags.owner].tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), 4.0 if labels and labels[0] else -4.0
    table, out, bias = _fit(bags, label[bags.owner], seed)
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _fit(bags: _Bags, label: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table, outputs and biases fitted to the stretches that each round takes, by steps of their own size for each n-gram."""
    rng = np.random.default_rng(seed)
    known = bags.support() >= SUPPORT
    table = rng.random((BUCKETS, DIM), dtype=np.float32)
    table -= 0.5
    table /= DIM
    table[~known] = 0
    out = rng.uniform(-0.1, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_table, g_out = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32)
    for turn in range(ROUNDS):
        chosen = bags.worst(rng.random(len(label)), DRAWN) if 3 * turn < ROUNDS else bags.worst(bags.margins(table @ (out[:, 1] - out[:, 0])), 1)
        share = np.bincount(label[chosen], minlength=2) / len(chosen)
        order = rng.permutation(chosen)
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            words, size, start = _ranges(bags.word, bags.start, rows)
            words, at = np.unique(words, return_inverse=True)
            grams, count, first = _ranges(bags.gram, bags.gram_from, words)
            vec = np.add.reduceat(table[grams], first, axis=0) / count[:, None]
            hidden = np.add.reduceat(vec[at], start, axis=0) / STRETCH
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = (p - np.eye(2, dtype=np.float32)[label[rows]]) * (0.5 / share[label[rows]])[:, None].astype(np.float32)
            d_out, d_hidden = hidden.T @ err, err @ out.T
            d_word = np.zeros_like(vec)
            np.add.at(d_word, at, np.repeat(d_hidden, size, axis=0) / STRETCH)
            d_gram = np.repeat(d_word / count[:, None], count, axis=0)
            names, back = np.unique(grams, return_inverse=True)
            d_table = np.stack([np.bincount(back, d_gram[:, j], len(names)) for j in range(DIM)], 1).astype(np.float32)
            g_table[names] += (d_table**2).mean(1)
            table[names] -= known[names, None] * 0.5 * d_table / np.sqrt(g_table[names])[:, None]
            g_out += d_out**2
            out -= 0.2 * d_out / np.sqrt(g_out)
            bias -= 0.02 * err.sum(0)
    return table, out, bias


def _threshold(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Where to cut and how steeply: a logistic curve through the held margins, fitted by Newton steps to targets drawn in a little from 0 and 1."""
    n1, n0 = int(y.sum()), int((y == 0).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    middle, spread = float(np.median(x)), max(1e-6, float(np.std(x)))
    z = np.stack([(x - middle) / spread, np.ones(len(x))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (p - target) + 1e-6 * w)
        w = w - step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-9:
            break
    slope = max(float(w[0]), 1e-3)  # a model that has learnt nothing must not turn around
    return middle - spread * float(w[1]) / slope, slope / spread


class Scorer:
    """Scores texts with trained log-odds; words are looked up once and kept, up to a bound."""

    def __init__(self, log_odds: np.ndarray, bias: float, most: int = 200_000):
        self.log_odds, self.bias, self.most = log_odds, bias, most
        self.known: dict[str, int] = {}
        self.values = np.empty(0, np.int64)

    def margins(self, texts: list[str | None]) -> list[float]:
        split = [words_of(t) for t in texts]
        new = list(set().union(*split).difference(self.known))
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            self.values, new = np.empty(0, np.int64), list(set().union(*split))
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            gram, count = subwords(part)
            means = np.add.reduceat(self.log_odds[gram].astype(np.float64), np.r_[0, np.cumsum(count)[:-1]]) / count
            self.known.update(zip(part, range(len(self.values), len(self.values) + len(part)), strict=True))
            self.values = np.r_[self.values, np.rint(means * UNIT).astype(np.int64)]
        return [self._worst(w) + self.bias for w in split]

    def _worst(self, words: list[str]) -> float:
        if not words:
            return 0.0
        rows, first = stretches(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        sums = np.where(first, self.values[rows], 0).sum(axis=1)
        k = min(WORST, len(sums))
        return int(np.partition(sums, len(sums) - k)[-k:].sum()) / (k * STRETCH * UNIT)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else (e := math.exp(x)) / (1 + e)


def _score(model, margins: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in slices(batches):
            scores = scorer.margins(batch.column("text").to_pylist())
            if not margins:
                scores = [_sigmoid(m) for m in scores]
            names = [n for n in batch.schema.names if n != "score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64())], names=[*names, "score"])

    return run


def labelled_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y) of up to ``most`` ids of either class, drawn by their hashes; an id that is labelled both 0 and 1 counts as 1."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(most)
        ids = part if ids is None else ids.union(part)
    return ids


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, sample_bytes: int) -> DataFrame:
    """(doc_id, text, y, held) of the labelled texts to learn from, stored: up to ``sample`` of each class, by the hash of their ids.

    The ids are drawn first, so the broadcast is bounded. Texts of more than a sixteenth of ``sample_bytes`` set the threshold only; of the
    others those train that come first by hash while they fit in ``sample_bytes`` a class, whole texts all of them.
    """
    known = in_small_batches(docs).select("doc_id", "text").join(F.broadcast(labelled_ids(labels, label, sample)), "doc_id").distinct()
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id", "text").limit(sample) for y in (0, 1)]
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = parts[0].union(parts[1]).withColumns({"held": F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(HELD)) == 0, "_size": size})
    apart = F.col("held") | (F.col("_size") > sample_bytes // 16)
    upto = F.sum("_size").over(Window.partitionBy("y", "_apart").orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id", "text"))  # ``sample`` rows each
    rows = rows.withColumn("_apart", apart).withColumn("_upto", upto).where(F.col("_apart") | (F.col("_upto") <= sample_bytes))
    return materialize(rows.select("doc_id", "text", "y", F.col("_apart").alias("held")), "labelled")


def fitted(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """The trained model, with its bias where the fewest labelled texts that did not train are judged wrongly.

    The driver gets ``2 * sample_bytes`` of texts at most. The texts that set the bias are scored in tasks, as any other text; one number of each comes back.
    """
    rows = learning_rows(docs, labels, label, sample, sample_bytes)
    learns = rows.where("not held").select("text", "y", "doc_id").orderBy("doc_id", "text").toArrow()
    table, bias = train(learns.column("text").to_pylist(), learns.column("y").to_pylist())
    model = docs.sparkSession.sparkContext.broadcast((table, bias))
    seen = rows.where("held").select("doc_id", "text", "y").mapInArrow(_score(model, margins=True), "doc_id long, text string, y int, score double")
    seen = seen.select("score", "y").orderBy("score", "y").toArrow()
    model.destroy()
    discard(rows)
    x, y = seen.column("score").to_numpy(), seen.column("y").to_numpy()
    if not table.any() or len(set(y.tolist())) < 2:
        return table, bias
    cut, scale = _threshold(x, y)
    return table * np.float32(scale), (bias - cut) * scale


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``docs`` (with a ``text``) plus ``score``, the probability of label 1.

    ``labels``: doc_id and 0/1 labels of the rows to learn from, of which up to ``sample`` of either
    class, and ``sample_bytes`` of their texts, train; null labels are left out, and an id with both labels counts as 1. Null and empty texts score
    as a text of no words. Every text is scored by all its stretches. Rows that repeat each have their score; other
    columns pass through; a ``score`` that exists is replaced. Without labels of both classes every text has one score.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, label, sample, sample_bytes))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "score")
    return in_small_batches(docs).mapInArrow(_score(model), f"{schema}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5, **how) -> DataFrame:
    """``docs`` without the rows that score ``most`` or more; a ``score`` of its own stays as it is."""
    rows, own = aside(docs, "score")
    return own(toxicity_scores(rows, labels, **how).where(F.col("score") < most))
