"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies expected of each of its documents. The
whole part is taken as it is; the fractional parts are rounded in pairs. A pair moves words from
one document to the other, in a direction drawn so that expectations hold, until one of the two
is in or out; the other goes on to the next pair. The words taken of a source thus stay at its
target until the last document, and miss it by less than one document; as the larger ones are decided
first, by a small one. Blocks of documents are rounded in parallel; what remains of each block, one document at most, meets in the next level of
the tree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cirrostrat.llm.text import aside
from cirrostrat.runtime import materialize

#: Documents of one block of the reduction tree.
BLOCK = 4096
_M = (1 << 64) - 1
_ROW = "doc_id long, source string, size long, source_size long, target double, whole int, p double, tie long, row long, nr long"


def _uniform(*parts: int) -> float:
    x = 0x9E3779B97F4A7C15
    for v in parts:
        x = (x ^ (v & _M)) * 0xBF58476D1CE4E5B9 & _M
        x = (x ^ (x >> 29)) * 0x94D049BB133111EB & _M
        x ^= x >> 32
    return (x >> 11) / (1 << 53)


def pivotal(units: list[tuple[int, int, float]], seed: int, last: bool) -> list[float]:
    """Round the shares of (id, size, share) units; the total of size times share is kept.

    All results are 0 or 1, but for one share that may stay between them; if ``last``, it is drawn too.
    """
    out = [p for _, _, p in units]
    held = None
    for j, (b, sb, pb) in enumerate(units):
        if held is None:
            held = j
        else:
            a, sa, pa_ = units[held][0], units[held][1], out[held]
            to_a, to_b = min((1 - pa_) * sa, pb * sb), min(pa_ * sa, (1 - pb) * sb)
            if _uniform(*((seed, a, b, j) if a == b else (seed, a, b))) * (to_a + to_b) < to_b:  # repeats of an id draw anew
                full = (1 - pa_) * sa <= pb * sb
                out[held], out[j] = (1.0, pb - to_a / sb) if full else (pa_ + to_a / sa, 0.0)
            else:
                gone = pa_ * sa <= (1 - pb) * sb
                out[held], out[j] = (0.0, pb + to_b / sb) if gone else (pa_ - to_b / sa, 1.0)
            held = j if 1e-12 < out[j] < 1 - 1e-12 else held if 1e-12 < out[held] < 1 - 1e-12 else None
    if held is not None and last:
        out[held] = float(_uniform(seed, units[held][0], 77) < out[held])
    return [p if held is not None and k == held and not last else float(round(p)) for k, p in enumerate(out)]


def _round_block(seed: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        # largest first: a fight leaves the larger document undecided, so the last one left, which the total misses by, is small
        rows = sorted(table.to_pylist(), key=lambda r: (-r["size"], r["doc_id"] is None, r["doc_id"] or 0, r["tie"] or 0, r["row"] or 0))
        shares = pivotal([(r["doc_id"] or 0, r["size"], r["p"]) for r in rows], seed, last)
        return pa.Table.from_pylist([{k: r[k] for k in r if k not in ("block", "p")} | {"p": p} for r, p in zip(rows, shares, strict=True)], schema=pa.schema([table.schema.field(n) for n in (c.split()[0] for c in _ROW.split(", "))]))

    return run


def _numbered(sizes: DataFrame, block: int) -> DataFrame:
    """``sizes`` with ``nr``: where more than ``block`` rows are alike in id, source, size and text, their rank among these, from 0; else 0.

    Ranks are counted within each stored partition (``part``) and set off by the counts of the partitions before it,
    so no task holds a group. How many rows have a rank does not depend on the partitions.
    """
    alike = ["doc_id", "source", "size", "tie"]
    many = materialize(sizes.groupBy(alike).count().where(F.col("count") > block).select([F.col(c).alias(f"_{c}") for c in alike]), "alike")
    if many.isEmpty():
        return sizes.withColumn("nr", F.lit(0).cast("long"))

    def same(*extra: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*alike, *extra)])

    hot = sizes.join(many, same(), "left_semi")
    counts = hot.groupBy(*alike, "part").count()
    before = Window.partitionBy(alike).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in (*alike, "part")], F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    local = hot.withColumn("nr", F.row_number().over(Window.partitionBy(*alike, "part").orderBy("row")) - 1)
    ranked = local.join(starts, same("part")).select(*sizes.columns, (F.col("nr") + F.col("_start")).alias("nr"))
    return materialize(sizes.join(many, same(), "left_anti").withColumn("nr", F.lit(0).cast("long")).union(ranked), "numbered")


def _dealt(rows: DataFrame, blocks: int, seed: int, run: Column | int = 0) -> DataFrame:
    """Rows with their block, by id, size and text, and by the run of those alike in all."""
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "tie", run + F.lit(seed)), F.lit(blocks)))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, size): weighted shares, none above ``cap`` times its size.

    The weights repeat over the sources by code point, null last. Sources whose part of what is
    left, by weight, passes their cap are set to it in the order of cap over weight; the first that
    does not fixes the level of all others. The windows run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    per = per.withColumn("w", w).withColumn("top", F.col("source_size") * cap).withColumn("ratio", F.col("top") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", level).withColumn("nr", F.row_number().over(order))
    # the level of the first that fits, in this very order: a later one of equal ratio has the caps before it taken off
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nr", "level"))).over(every)
    return per.select("source", "source_size", F.least("top", F.coalesce(free["level"] * F.col("w"), F.col("top"))).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    Size: words between ASCII white space; null and empty texts have none and are taken in zero or
    ``floor`` copies, which is no word either way. A null source is a source of its own. Rows that
    repeat are drawn one by one. No document is taken more than ``ceil(cap)`` times, and with a
    whole ``cap`` never above ``cap`` times its size. An empty table gives no rows. Draws depend on
    seed, ids, sizes and texts only, so reruns agree whatever the partitions. Rows without an id are dealt
    to blocks by their texts, and rows alike in id and text, where they are many, by runs of ``block``.
    """
    return _planned(docs, None, weights, share, cap, seed, block).drop("row")


def _planned(docs: DataFrame, row: str | None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """``mix_sources`` with the key of each row (column ``row`` of ``docs``); equal ids and sizes are drawn in the order of their texts."""
    keys = [F.xxhash64("text").alias("tie"), (F.lit(None) if row is None else F.col(row)).cast("long").alias("row")]
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), *keys)
    sizes = _numbered(materialize(sizes.withColumn("part", F.spark_partition_id()), "sizes"), block)
    targets = source_targets(sizes, weights, share, cap).withColumnRenamed("source", "of")
    per = sizes.join(targets, sizes["source"].eqNullSafe(targets["of"])).drop("of")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.when(F.abs(want - F.round(want)) < 1e-12, F.round(want)).otherwise(want)
    per = per.withColumn("whole", F.floor(near).cast("int")).withColumn("p", F.when(F.col("size") > 0, near - F.floor(near)).otherwise(F.lit(0.0)))
    fields = [c.split()[0] for c in _ROW.split(", ")]
    open_, done = per.where("p > 0").select(fields), [per.where("p = 0").select(fields)]
    blocks, span = max(1, math.ceil(sizes.count() / block)), block
    while True:
        last = blocks == 1
        rounded = materialize(_dealt(open_, blocks, seed, F.floor(F.col("nr") / span)).groupBy("source", "block").applyInArrow(_round_block(seed, last), _ROW), "rounded")
        done.append(rounded.where("p = 0 or p = 1"))
        if last:
            break
        open_, blocks, span = rounded.where("p > 0 and p < 1"), math.ceil(blocks / block), span * block
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    copies = (F.col("whole") + F.col("p").cast("int")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"), "row")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken, with ``copy`` counted from 1.

    Every row has a stored key of its own, by which it finds its copies; so rows of one doc_id and of none are taken as planned. A ``copy`` that exists is replaced.
    """
    docs = docs.drop("copy")
    rows, _ = aside(docs, "_row", "_copies")
    kept = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    plan = _planned(kept, "_row", **how).where("copies > 0").select(F.col("row").alias("_row"), F.col("copies").alias("_copies"))
    out = kept.join(plan, "_row").select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
    return out.withColumnsRenamed({f"_own_{n}": n for n in ("_row", "_copies") if n in docs.columns})
