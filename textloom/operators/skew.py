"""Balanced per-key processing: fragment-replicate by estimated load.

A handful of keys may hold most rows.  The load of every key group is measured
(one pre-aggregated pass), keys are bin-packed to tasks, a key larger than its
fair share is cut into proportionate shards, and the matching side of a join is
replicated to exactly the shards of its key.  Nothing is sampled or dropped.

What the driver holds is bounded by the number of tasks, never by the number of
keys: loads of ``BINS_PER_TASK * tasks`` hash bins plus the few keys whose load
exceeds a fixed share of a task (at most ``tasks * HEAVY_PART`` of them).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.runtime import materialize

BINS_PER_TASK = 16
HEAVY_PART = 8  # a key is heavy from 1/HEAVY_PART of a task's fair load on


@dataclass(frozen=True)
class LoadPlan:
    """Where rows go: ``bins`` maps a hash bin to a task, ``heavy`` a key to its tasks."""

    tasks: int
    bins: tuple[int, ...]
    heavy: dict  # key (string) -> tuple of task ids, one per shard
    total: int = 0  # rows of all keys

    @property
    def n_bins(self) -> int:
        return len(self.bins)


def _bin(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def pack(bin_loads: dict[int, int], heavy_loads: dict[str, int], tasks: int) -> LoadPlan:
    """Longest-processing-time packing of bins and key shards to ``tasks`` tasks.

    Every heavy key gets ``ceil(load / fair)`` shards of equal size.  With no rows
    all bins map to task 0 upwards in turn.
    """
    n_bins = tasks * BINS_PER_TASK
    total = sum(bin_loads.values()) + sum(heavy_loads.values())
    fair = max(1, -(-total // tasks))
    items: list[tuple[float, str, object, int]] = []
    for key, load in heavy_loads.items():
        shards = min(tasks, max(1, -(-load // fair)))
        items += [(load / shards, "key", key, i) for i in range(shards)]
    items += [(float(bin_loads.get(b, 0)), "bin", b, 0) for b in range(n_bins)]
    items.sort(key=lambda x: (-x[0], x[1], str(x[2]), x[3]))
    heap = [(0.0, t) for t in range(tasks)]
    bins, heavy = [0] * n_bins, {}
    for load, kind, what, _ in items:
        used, t = heapq.heappop(heap)
        if kind == "bin":
            bins[what] = t
        else:
            heavy.setdefault(what, []).append(t)
        heapq.heappush(heap, (used + load, t))
    return LoadPlan(tasks, tuple(bins), {k: tuple(v) for k, v in heavy.items()}, total)


def plan_load(loads: DataFrame, key: str, weight: str, tasks: int) -> LoadPlan:
    """Plan from per-key loads (``key`` unique, ``weight`` rows).  Null keys are ignored.

    The loads are stored once, as three passes read them.
    """
    loads = materialize(loads.select(key, weight), "loads")
    total = loads.agg(F.sum(weight)).first()[0] or 0
    # at most tasks * HEAVY_PART keys can reach this share, so the collect is bounded
    heavy_from = max(2, total // (tasks * HEAVY_PART) + 1)
    n_bins = tasks * BINS_PER_TASK
    keyed = loads.where(F.col(key).isNotNull())
    heavy = {r[0]: int(r[1]) for r in keyed.where(F.col(weight) >= heavy_from).select(F.col(key).cast("string"), weight).collect()}
    light = keyed.where(F.col(weight) < heavy_from).groupBy(_bin(F.col(key).cast("string"), n_bins).alias("b")).agg(F.sum(weight).alias("w"))
    return pack({r["b"]: int(r["w"]) for r in light.collect()}, heavy, tasks)


def _placed(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """``df`` with the task of its key's bin in ``__bin_task`` and the tasks of a heavy key in ``__shards``, else null.

    Both are looked up in broadcast tables: one row per bin, ``tasks * BINS_PER_TASK`` of
    them, and one per heavy key, ``tasks * HEAVY_PART`` at most; neither grows with the data.
    """
    spark = df.sparkSession
    name = F.col(key).cast("string")
    bins = spark.createDataFrame(list(enumerate(plan.bins)), "__bin int, __bin_task int")
    out = df.join(F.broadcast(bins), _bin(name, plan.n_bins) == F.col("__bin"), "left").drop("__bin")
    heavy = spark.createDataFrame([(k, list(v)) for k, v in sorted(plan.heavy.items())], "__key string, __shards array<int>")
    return out.join(F.broadcast(heavy), name == F.col("__key"), "left").drop("__key")


def fragment(df: DataFrame, key: str, plan: LoadPlan, spread_by: list[str]) -> DataFrame:
    """The large side: each row goes to one shard of its key, chosen by a hash of ``spread_by``."""
    s = F.col("__shards")
    pick = F.element_at(s, (F.pmod(F.xxhash64(*spread_by), F.size(s)) + 1).cast("int"))
    out = _placed(df, key, plan).withColumn("__task", F.when(s.isNotNull(), pick).otherwise(F.coalesce("__bin_task", F.lit(0))))
    return out.drop("__shards", "__bin_task").repartitionById(plan.tasks, F.col("__task"))


def replicate(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """The matching side: rows of a split key are copied to that key's tasks, all others go to one."""
    s = F.col("__shards")
    targets = F.when(s.isNotNull(), F.array_distinct(s)).otherwise(F.array(F.coalesce("__bin_task", F.lit(0))))
    return _placed(df, key, plan).withColumn("__task", F.explode(targets)).drop("__shards", "__bin_task").repartitionById(plan.tasks, F.col("__task"))


def balanced_counts(pairs: DataFrame, key: str, spread_by: list[str], plan: LoadPlan) -> DataFrame:
    """Rows per key, computed shard by shard and then summed: ``(key, n_rows)``."""
    part = fragment(pairs.select(key, *spread_by), key, plan, spread_by).groupBy("__task", key).agg(F.count(F.lit(1)).alias("n"))
    return part.groupBy(key).agg(F.sum("n").alias("n_rows"))


def fragment_replicate_join(large: DataFrame, small: DataFrame, key: str, plan: LoadPlan, spread_by: list[str], how: str = "inner", reduce: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Equi-join on ``key`` where ``large`` may be dominated by a few keys.

    ``how`` is ``inner`` or ``left`` (every row of ``large`` kept; it lies in exactly
    one shard, so no row is produced twice).  Columns of ``small`` that clash with
    ``large`` get the suffix ``_m``.  Null keys never match.  Both sides stay where the
    plan put them instead of being hashed again: while the join is planned, the session
    accepts a placement by a part of the join keys.  As that holds for plans made while it
    lasts, the result is stored there, or what ``reduce`` makes of it.
    """
    spark = large.sparkSession
    clash = set(large.columns) & set(small.columns) - {key}
    side = replicate(small.select(*[F.col(c).alias(c + "_m" if c in clash else c) for c in small.columns]), key, plan)
    joined = fragment(large, key, plan, spread_by).join(side, ["__task", key], how).drop("__task")
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return reduce(joined) if reduce else materialize(joined, "joined")
    finally:
        spark.conf.set(setting, old)
