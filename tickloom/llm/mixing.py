"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a hash of their id. Each copy of a document (one per epoch) gets a virtual finish
time: the words its source has given up to and with this copy, divided by the source's target. Copies are taken in the order of
their finish times over all sources until the budget is spent, so that at any point every source has given its share.

Both running sums (inside a source, and over the global order) are taken over ranges of the order: sums per range, a running
sum over the ranges, then the rows inside one range. No window holds a whole source, and only the range of the global order
in which the budget ends is looked at row by row.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, the last; documents
with equal ids (and those without one) of a source move together; repeated rows count each; a target of 0 takes nothing;
an empty table gives an empty table; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tickloom.llm.common import WORD
from tickloom.session import materialize

#: Rows of the shuffled order, and of the global order, that one range holds about.
RANGE_ROWS = 2000
#: A table of sources is sent to all tasks up to this many rows and bytes of names, and joined by a shuffle beyond.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 4_000_000
RESULTS = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def _running(value: str, key: list[str], order: list[Column | str]) -> Column:
    return F.sum(value).over(W.Window.partitionBy(*key).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0))


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds rank and target to one row per source (source, source_size).

    Sources in code point order, null last, take the weights in turn and share ``share`` of all sizes. No target is above
    ``cap`` times its source's size; the excess goes to the others by weight. Sorted by the level at which they fill up,
    the first source that the remaining share per weight does not fill sets the level of all behind it.
    """
    by_name = W.Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    d = sources.withColumn("source_rank", F.row_number().over(by_name)).withColumn("_w", w.cast("double"))
    d = d.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    level = W.Window.orderBy(F.col("_cap") / F.col("_w"), "source_rank")
    everything = W.Window.partitionBy()
    d = d.withColumn("_level", F.row_number().over(level))
    before = F.coalesce(F.sum("_cap").over(level.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("_w").over(level.rowsBetween(0, W.Window.unboundedFollowing))
    d = d.withColumn("_water", (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / behind)
    first = F.min(F.when(F.col("_water") <= F.col("_cap") / F.col("_w"), F.struct("_level", "_water"))).over(everything)
    d = d.withColumn("_first", first)
    open_ = F.col("_level") >= F.col("_first._level")
    return d.withColumn("target", F.when(open_, F.col("_w") * F.col("_first._water")).otherwise(F.col("_cap"))).drop("_w", "_cap", "_level", "_water", "_first")


def plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, epochs: int = 2,
         doc_id: str = "doc_id", source: str = "source", size: Column | None = None, text: str = "text", seed: str = "mix") -> DataFrame:
    """One row per source: source_size, target, and the last copy it gives (epoch and shuffle key; null: none)."""
    size = word_count(text) if size is None else size
    units = docs.select(F.col(source).alias("source"), shuffle_key(doc_id, seed).alias("key"), size.alias("size"))
    units = materialize(units.groupBy("source", "key").agg(F.sum("size").alias("size")), "mix_units")
    sources = materialize(targets(units.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mix_sources")
    n, budget = units.count(), sources.agg(F.sum("source_size").cast("double") * F.lit(float(share))).first()[0] or 0.0

    ranges = max(1, n // RANGE_ROWS)
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32))
    ranked = sources.select(F.col("source").alias("_source"), "source_rank", "source_size", "target")
    u = units.join(small(ranked, sources), F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source").withColumn("part", part)
    whole = u.groupBy("source_rank", "part").agg(F.sum("size").alias("in_part"))
    whole = whole.withColumn("before", _running("in_part", ["source_rank"], ["part"]) - F.col("in_part")).drop("in_part")
    u = u.join(whole, ["source_rank", "part"]).withColumn("given", F.col("before") + _running("size", ["source_rank", "part"], ["key"]))
    copies = u.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).where("size > 0 and target > 0")
    finish = (F.col("given") + (F.col("epoch") - 1) * F.col("source_size")) / F.col("target")
    steps = max(64, min(1 << 20, n // RANGE_ROWS))
    copies = copies.select("source_rank", "epoch", "key", "size", finish.alias("finish"))
    copies = materialize(copies.withColumn("step", F.floor(F.least("finish", F.lit(float(epochs))) * steps)), "mix_copies")

    upto = copies.groupBy("step").agg(F.sum("size").alias("in_step")).withColumn("upto", _running("in_step", [], ["step"]))
    last = upto.where(F.col("upto") > F.lit(budget)).orderBy("step").select("step", (F.col("upto") - F.col("in_step")).alias("before")).first()
    copy = F.struct("epoch", "key")
    if last is None:
        taken = copies.select("source_rank", copy.alias("copy"))
    else:
        edge = copies.where(F.col("step") == last.step).withColumn("sum", _running("size", [], ["finish", "source_rank", "epoch", "key"]))
        edge = edge.where(F.col("sum") + F.lit(last.before) <= F.lit(budget))
        taken = copies.where(F.col("step") < last.step).select("source_rank", copy.alias("copy")).union(edge.select("source_rank", copy.alias("copy")))
    return materialize(sources.join(taken.groupBy("source_rank").agg(F.max("copy").alias("last_copy")), "source_rank", "left"), "mix_plan")


def small(df: DataFrame, sources: DataFrame) -> DataFrame:
    """``df`` marked for broadcasting where the table of sources is within the bounds."""
    n, chars = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and chars <= BROADCAST_BYTES else df


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, epochs: int = 2,
        doc_id: str = "doc_id", source: str = "source", size: Column | None = None, text: str = "text", seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target, copies (0 to ``epochs``) and taken (size times copies)."""
    size = word_count(text) if size is None else size
    p = plan(docs, weights, share, cap, epochs, doc_id, source, size, text, seed)
    p = small(p, p).select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_total"), F.col("target").alias("_mix_target"), "last_copy")
    # the document is one column meanwhile, so that none of its own clashes with what is joined
    d = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("_mix_doc"), F.col(source).alias("_mix_of"), size.alias("_mix_size"), shuffle_key(doc_id, seed).alias("_mix_key"))
    d = d.join(p, d["_mix_of"].eqNullSafe(p["_mix_source"]), "left")
    given = [F.coalesce(F.struct(F.lit(e).alias("epoch"), F.col("_mix_key").alias("key")) <= F.col("last_copy"), F.lit(False)).cast("int") for e in range(1, epochs + 1)]
    copies = F.when(F.col("_mix_size") > 0, sum(given[1:], given[0])).otherwise(0)
    out = [F.col("_mix_doc")[c].alias(c) for c in docs.columns if c not in RESULTS]
    return d.withColumn("_mix_copies", copies).select(
        *out, F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"),
        F.col("_mix_copies").alias("copies"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM s),
w AS (SELECT *, ([5, 2, 1])[((source_rank - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, row_number() OVER (ORDER BY cap / w, source_rank) AS level,
             (sum(source_size) OVER () * 1.5::DOUBLE
              - coalesce(sum(cap) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM w),
f AS (SELECT min(level) AS first_level, min_by(water, level) AS first_water FROM l WHERE water <= cap / w),
t AS (SELECT source, source_rank, source_size, CASE WHEN level >= first_level THEN w * first_water ELSE cap END AS target
      FROM l LEFT JOIN f ON true),
u AS (SELECT source_rank, key, any_value(t.source_size) AS source_size, any_value(target) AS target, sum(size)::BIGINT AS size
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY source_rank, key),
g AS (SELECT *, sum(size) OVER (PARTITION BY source_rank ORDER BY key) AS given FROM u),
c AS (SELECT source_rank, epoch, key, size, (given + (epoch - 1) * source_size)::DOUBLE / target AS finish
      FROM g, (VALUES (1), (2)) e(epoch) WHERE size > 0 AND target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, source_rank, epoch, key) AS upto FROM c),
k AS (SELECT source_rank, max(epoch || ':' || key) AS last_copy FROM o
      WHERE upto <= (SELECT sum(source_size) * 1.5::DOUBLE FROM s) GROUP BY source_rank)
SELECT doc_id, d.size, t.source_size, t.target,
       (CASE WHEN '1:' || d.key <= last_copy THEN d.size ELSE 0 END + CASE WHEN '2:' || d.key <= last_copy THEN d.size ELSE 0 END)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k USING (source_rank)
"""
