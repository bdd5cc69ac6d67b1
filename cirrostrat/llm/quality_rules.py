"""Text quality by a sparse ensemble of rules.

Boosted shallow trees over text statistics give candidate rules: every path from a root is a
conjunction of limits on statistics. A logistic model with a lasso penalty keeps few of them, and
the result is compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrostrat.llm.text import in_small_batches, slices

#: The most labelled rows of either class that training takes.
SAMPLE = 10_000
STATISTICS = (
    "n_words", "word_length", "longest_word", "upper_share", "digit_share", "symbol_share", "exclaim_share", "pipe_share",
    "stop_share", "line_share", "non_ascii_share", "distinct_share", "top_word_share", "same_next_share", "marked_word_share",
)

_CLASS = np.zeros(256, np.int64)
for _chars, _k in ((range(0x41, 0x5B), 1), (range(0x61, 0x7B), 2), (range(0x30, 0x3A), 3), (b"!", 5), (b"|", 6), (b".,;:?", 7), (b"\n", 8), (b" \t\r\v\f", 9), (range(0x80, 0x100), 10)):
    _CLASS[list(_chars)] = _k
_CLASS[[c for c in b"#$%&*+/<=>@\\^_`{}~"]] = 4
_TAILS = tuple(bytes([c]) for c in b"!#$%&*+=@^~|")


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``; zeros for null and empty texts."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(data)
    c = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=11)
    counts = Counter(words)
    letters = max(1, c[1] + c[2] + c[10] // 2)
    same = sum(map(bytes.__eq__, words, words[1:])) if len(counts) < n else 0
    return [
        float(n), (size - c[8] - c[9]) / n, float(max(map(len, words))), c[1] / letters, c[3] / size, c[4] / size, c[5] / size, c[6] / size,
        c[7] / n, c[8] / n, c[10] / size, len(counts) / n, max(counts.values()) / n, same / n, sum(w.endswith(_TAILS) for w in words) / n,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, len(STATISTICS))
        names = [n for n in batch.schema.names if n != "stats"]
        stats = pa.StructArray.from_arrays([pa.array(x[:, i]) for i in range(x.shape[1])], names=list(STATISTICS))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), stats], names=[*names, "stats"])


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` plus a struct ``stats`` of the statistics of its texts (a ``stats`` that exists is replaced)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "stats")
    return in_small_batches(docs).mapInArrow(_statistics, f"{schema}, stats struct<{', '.join(f'{s}: double' for s in STATISTICS)}>")


#: A rule: limits (statistic, whether above, limit) that all hold.
Rule = tuple[tuple[int, bool, float], ...]


def grow_tree(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], depth: int, rows: np.ndarray, path: Rule, out: list[Rule], fit: np.ndarray, least: int) -> None:
    """Split by the largest drop in squared error; append every path and set each row's leaf mean in ``fit``."""
    t = target[rows]
    best = (1e-9, None)
    if depth and len(rows) >= 2 * least:
        base = t.sum() ** 2 / len(t)
        for j, limits in enumerate(cuts):
            if not len(limits):
                continue
            bins = np.searchsorted(limits, x[rows, j], side="left")
            n, s = np.cumsum(np.bincount(bins, minlength=len(limits) + 1))[:-1], np.cumsum(np.bincount(bins, t, len(limits) + 1))[:-1]
            ok = (n >= least) & (len(t) - n >= least)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (t.sum() - s) ** 2 / np.maximum(len(t) - n, 1) - base, 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (j, float(limits[k])))
    if best[1] is None:
        fit[rows] = t.mean() if len(t) else 0.0
        return
    j, limit = best[1]
    above = x[rows, j] > limit
    for side in (False, True):
        step = (*path, (j, side, limit))
        out.append(step)
        grow_tree(x, target, cuts, depth - 1, rows[above == side], step, out, fit, least)


def rule_matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    return np.stack([np.logical_and.reduce([(x[:, j] > limit) == above for j, above, limit in r]) for r in rules], 1) if rules else np.zeros((len(x), 0), bool)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, lasso: float = 2e-3, steps: int = 400) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with weights, bias) of a sparse logistic model of ``y`` on rules of boosted trees."""
    if len(set(y.tolist())) < 2:
        return [], 4.0 if len(y) and y[0] else -4.0
    cuts = [(u[1:] + u[:-1]) / 2 if len(u := np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)))) > 1 else np.empty(0) for j in range(x.shape[1])]
    share = np.clip(y.mean(), 0.01, 0.99)
    score, found = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        fit = np.zeros(len(y))
        grow_tree(x, y - p, cuts, depth, np.arange(len(y)), (), found, fit, max(5, len(y) // 500))
        score += 2.0 * fit
    rules = list(dict.fromkeys(tuple(sorted(r)) for r in found))
    m = rule_matrix(x, rules)
    _, first = np.unique(m, axis=1, return_index=True)  # rules that hold for the same rows say the same
    rules = [rules[i] for i in sorted(first) if 0 < m[:, i].mean() < 1]
    m = rule_matrix(x, rules).astype(np.float64)
    # accelerated proximal gradient; the step is the inverse of a bound on the curvature
    bound = np.linalg.norm(m.T @ m / len(y), 2) / 4 + 0.25
    w, b, v, vb, t = np.zeros(m.shape[1]), float(np.log(share / (1 - share))), np.zeros(m.shape[1]), float(np.log(share / (1 - share))), 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(m @ v + vb, -40, 40))) - y
        nw = v - m.T @ r / len(y) / bound
        nw = np.sign(nw) * np.maximum(np.abs(nw) - lasso / bound, 0)
        nb, nt = vb - r.mean() / bound, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb, w, b, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nw, nb, nt
    return [(r, float(c)) for r, c in zip(rules, w, strict=True) if abs(c) > 1e-6], float(b)


def compile_rules(rules: list[tuple[Rule, float]], bias: float, stats: str = "stats") -> Column:
    """The model as a Spark column over the statistics."""
    total = F.lit(bias)
    for rule, weight in rules:
        holds = F.lit(True)
        for j, above, limit in rule:
            s = F.col(f"{stats}.{STATISTICS[j]}")
            holds = holds & ((s > limit) if above else (s <= limit))
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``docs`` (with a ``text``) plus ``score``, the probability of label 1.

    ``labels``: doc_id and 0/1 labels of the rows to learn from, of which up to ``sample`` of either
    class train; null labels are left out, and an id with both labels counts as 0. Null and empty texts have zero statistics and the score
    that these get. Other columns pass through; ``stats`` is used inside, and a ``score`` that exists
    is replaced. Without labels of both classes every text has one score.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample)
        ids = part if ids is None else ids.union(part)
    # at most twice ``sample`` ids, so the broadcast is bounded
    seen = with_statistics(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")).select("doc_id", "y", "stats").orderBy("doc_id", "stats").collect()
    x, y = np.array([list(r.stats) for r in seen]).reshape(-1, len(STATISTICS)), np.array([r.y for r in seen], np.float64)
    rules, bias = fit_rules(x, y)
    return with_statistics(docs.drop("score")).withColumn("score", compile_rules(rules, bias)).drop("stats")
