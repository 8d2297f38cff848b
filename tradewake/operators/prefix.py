"""Running computations per key that stay balanced when one key owns much of the data.

A window partitioned by key gives all rows of a key to one task. That is the best
plan while every key fits a task, and it is what these functions build in that
case. When some keys are larger, their rows are cut along the ordering columns
into chunks; windows run inside (key, chunk), and what earlier chunks contribute
is carried in from one small table of chunk totals:

    local window over (key, chunk)  +  totals of all earlier chunks of the key

Cut points come from counts, minima and maxima, computed with map-side partial
aggregation. They only steer the balance: results are the same for any cut.

The tables of large keys are broadcast. They have a fixed bound: at most
``SplitPolicy.max_groups`` rows per level, whatever the size of the data. Keys
beyond that bound are the smaller ones, each below ``1 / max_groups`` of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewake.session import cut_lineage

CHUNK = "_chunk"
_HOT = "_hot"
_LAST_HOT = "_last_hot"


@dataclass(frozen=True)
class SplitPolicy:
    """When and how finely the rows of one key are split."""

    target_rows: int = 4_000_000
    max_groups: int = 10_000
    fan_out: int = 1024
    max_levels: int = 6


DEFAULT_POLICY = SplitPolicy()


@dataclass(frozen=True)
class Running:
    """One running output column."""

    name: str
    kind: str
    value: str | None = None


def ordinal(name: str) -> Running:
    """1-based position of the row within its key."""
    return Running(name, "ordinal")


def prior_sum(name: str, value: str) -> Running:
    """Sum over earlier rows, null when there is none."""
    return Running(name, "prior_sum", value)


def prior_count(name: str, value: str) -> Running:
    """Number of earlier rows with a value."""
    return Running(name, "prior_count", value)


def prior_value(name: str, value: str) -> Running:
    """Value of the row just before."""
    return Running(name, "prior_value", value)


def peer_max(name: str, value: str) -> Running:
    """Maximum up to this row and all rows that share its first ordering value."""
    return Running(name, "peer_max", value)


def peer_min(name: str, value: str) -> Running:
    """Minimum up to this row and all rows that share its first ordering value."""
    return Running(name, "peer_min", value)


# --------------------------------------------------------------------------- cutting


def _numeric(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if isinstance(df.schema[n].dataType, T.NumericType)]


def _large_groups(df: DataFrame, by: Sequence[str], axes: Sequence[str], policy: SplitPolicy):
    """Largest groups above the target: one aggregate, then a bounded top-n."""
    def finite(axis: str) -> Column:
        value = F.col(axis).cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)

    ranges = [f(finite(a)).alias(f"_{f.__name__}_{i}") for i, a in enumerate(axes) for f in (F.min, F.max)]
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"), *ranges)
        .where(F.col("_n") > policy.target_rows)
        .orderBy(F.desc("_n"))
        .limit(policy.max_groups)
    )


@dataclass(frozen=True)
class Cut:
    """One level of cutting; ``ties`` tells whether rows of one instant were separated."""

    table: DataFrame
    ties: bool


def _cut_level(df: DataFrame, by: Sequence[str], axes: Sequence[str], policy: SplitPolicy) -> Cut | None:
    """Which groups to cut, along which axis, where from and how wide."""
    large = _large_groups(df, by, axes, policy)
    cuts = []
    for row in large.collect():
        for i in range(len(axes)):
            low, high = row[f"_min_{i}"], row[f"_max_{i}"]
            if low is None or not math.isfinite(high - low) or high <= low:
                continue
            parts = min(policy.fan_out, 2 * math.ceil(row["_n"] / policy.target_rows))
            width = (high - low) / parts
            if width > 0:
                cuts.append((*[row[b] for b in by], i, low, width, parts))
                break
    if not cuts:
        return None
    fields = [T.StructField(b, large.schema[b].dataType) for b in by]
    schema = T.StructType(
        fields
        + [
            T.StructField("_axis", T.IntegerType()),
            T.StructField("_low", T.DoubleType()),
            T.StructField("_width", T.DoubleType()),
            T.StructField("_parts", T.IntegerType()),
        ]
    )
    return Cut(df.sparkSession.createDataFrame(cuts, schema), any(c[len(by)] > 0 for c in cuts))


def _apply_cuts(df: DataFrame, keys: Sequence[str], axes: Sequence[str], cuts: Sequence[Cut], fan_out: int) -> DataFrame:
    """Add the chunk number; a bounded broadcast join per level, no shuffle."""
    out = df.withColumn(CHUNK, F.lit(0).cast("long")).withColumn(_HOT, F.lit(False)).withColumn(_LAST_HOT, F.lit(False))
    for level, cut in enumerate(cuts):
        by = list(keys) if level == 0 else [*keys, CHUNK]
        renamed = cut.table.withColumnsRenamed({b: f"_cut_{i}" for i, b in enumerate(by)})
        match = reduce(
            Column.__and__, [F.col(b).eqNullSafe(F.col(f"_cut_{i}")) for i, b in enumerate(by)]
        )
        position = reduce(
            lambda rest, i: F.when(F.col("_axis") == i, F.col(axes[i]).cast("double")).otherwise(rest),
            range(1, len(axes)),
            F.col(axes[0]).cast("double"),
        )
        # Nulls sort first, as in a window; infinities and NaN fall outside the range of finite values.
        inside = F.least(F.greatest(F.floor((position - F.col("_low")) / F.col("_width")), F.lit(0)), F.col("_parts") - 1)
        part = (
            F.when(F.col("_axis").isNull(), 0)
            .when(position.isNull() | (position == float("-inf")), 0)
            .when(F.isnan(position) | (position == float("inf")), F.col("_parts") - 1)
            .otherwise(inside)
        )
        out = (
            out.join(F.broadcast(renamed), match, "left")
            .withColumn(CHUNK, F.col(CHUNK) * fan_out + F.coalesce(part, F.lit(0)))
            .withColumn(_LAST_HOT, F.col("_axis").isNotNull())
            .withColumn(_HOT, F.col(_HOT) | F.col(_LAST_HOT))
            .drop(*[f"_cut_{i}" for i in range(len(by))], "_axis", "_low", "_width", "_parts")
        )
    return out


def has_large_keys(df: DataFrame, keys: Sequence[str], policy: SplitPolicy = DEFAULT_POLICY) -> bool:
    """True when some key holds more rows than one task should take."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not counts.where(F.col("_n") > policy.target_rows).isEmpty()


def plan_cuts(sizing: DataFrame, keys: Sequence[str], order: Sequence[str], policy: SplitPolicy = DEFAULT_POLICY) -> list[Cut]:
    """Cut tables, one per level, until no chunk is larger than the target.

    A group whose first ordering value is the same in all rows is cut along the
    next one, so even a single instant can be spread over tasks.
    """
    axes = _numeric(sizing, order)
    if not axes:
        return []
    narrow = sizing.select(*dict.fromkeys([*keys, *axes]))
    cuts: list[Cut] = []
    while len(cuts) < policy.max_levels:
        if cuts:
            frame = _apply_cuts(narrow, keys, axes, cuts, policy.fan_out).where(F.col(_LAST_HOT))
            by = [*keys, CHUNK]
        else:
            frame, by = narrow, list(keys)
        cut = _cut_level(frame, by, axes, policy)
        if cut is None:
            break
        cuts.append(cut)
    return cuts


# --------------------------------------------------------------------------- running columns


def _local(spec: Running, by: Sequence[str], order: Sequence[str]) -> Column:
    rows = Window.partitionBy(*by).orderBy(*order)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    peers = Window.partitionBy(*by).orderBy(order[0])
    if spec.kind == "ordinal":
        return F.row_number().over(rows).cast("long")
    if spec.kind == "prior_sum":
        return F.sum(spec.value).over(before)
    if spec.kind == "prior_count":
        return F.count(spec.value).over(before)
    if spec.kind == "prior_value":
        return F.lag(spec.value).over(rows)
    if spec.kind == "peer_max":
        return F.max(spec.value).over(peers)
    if spec.kind == "peer_min":
        return F.min(spec.value).over(peers)
    raise ValueError(f"unknown running column kind: {spec.kind}")


def _chunk_total(spec: Running, order: Sequence[str], ties: bool) -> list[Column]:
    name = f"_t_{spec.name}"
    if spec.kind == "ordinal":
        return [F.count(F.lit(1)).alias(name)]
    if spec.kind == "prior_sum":
        return [F.sum(spec.value).alias(name)]
    if spec.kind == "prior_count":
        return [F.count(spec.value).alias(name)]
    if spec.kind == "prior_value" and spec.value == order[0]:
        return [F.max(spec.value).alias(name)]
    if spec.kind == "prior_value":
        last = F.struct(*[F.col(o) for o in order], F.col(spec.value).alias("_v"))
        return [F.max(last)["_v"].alias(name)]
    value = F.col(spec.value)
    if not ties:
        return [(F.max if spec.kind == "peer_max" else F.min)(value).alias(name)]
    if spec.kind == "peer_max":
        head = F.max(F.struct((-F.col(order[0])).alias("_o"), value.alias("_v")))["_v"]
        return [F.max(value).alias(name), head.alias(f"_h_{spec.name}")]
    head = F.min(F.struct(F.col(order[0]).alias("_o"), value.isNull().alias("_n"), value.alias("_v")))["_v"]
    return [F.min(value).alias(name), head.alias(f"_h_{spec.name}")]


def _carried(spec: Running, earlier) -> Column:
    total = F.col(f"_t_{spec.name}")
    if spec.kind == "peer_max":
        return F.max(total).over(earlier)
    if spec.kind == "peer_min":
        return F.min(total).over(earlier)
    if spec.kind == "prior_value":
        return F.last(total).over(earlier)
    return F.sum(total).over(earlier)


def _combined(spec: Running, ties: bool) -> Column:
    local, carry = F.col(spec.name), F.col(f"_c_{spec.name}")
    if spec.kind in ("ordinal", "prior_count"):
        return local + F.coalesce(carry, F.lit(0))
    if spec.kind == "prior_sum":
        return F.coalesce(local + carry, local, carry)
    if spec.kind == "prior_value":
        return F.when(F.col("_first_in_chunk"), carry).otherwise(local)
    parts = [local, carry]
    if ties:
        parts.append(F.when(F.col("_order_0") == F.col("_high"), F.col(f"_e_{spec.name}")))
    return (F.greatest if spec.kind == "peer_max" else F.least)(*parts)


def _never_null(df: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """Columns that identify the same groups as the keys without nulls.

    Joining on them is a plain equality, so the join reuses the partitioning of
    the windows; a null-safe comparison of the keys would shuffle again.
    """
    out: dict[str, Column] = {}
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType
        if isinstance(kind, (T.StringType, T.NumericType, T.BooleanType)):
            blank = F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)
            out[f"_key_{i}"] = F.coalesce(F.col(k), blank)
            out[f"_null_{i}"] = F.col(k).isNull()
        else:
            out[f"_key_{i}"] = F.struct(k)
    return out


def running_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Running],
    policy: SplitPolicy = DEFAULT_POLICY,
    sizing: DataFrame | None = None,
) -> DataFrame:
    """Add running columns per key, in the order of ``order`` (ascending).

    ``order`` should end in a unique column. ``sizing`` may name a cheaper frame
    with the same keys and ordering columns, used only to find large keys.
    """
    keys, order = list(keys), list(order)
    cuts = plan_cuts(df if sizing is None else sizing, keys, order, policy)
    if not cuts:
        return df.withColumns({s.name: _local(s, keys, order) for s in specs})

    split = _apply_cuts(df, keys, _numeric(df, order), cuts, policy.fan_out).drop(_LAST_HOT)
    safe = _never_null(df, keys)
    split, groups = split.withColumns(safe), list(safe)
    by = [*groups, CHUNK]
    local = split.withColumns({s.name: _local(s, by, order) for s in specs})
    local = local.withColumn("_first_in_chunk", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)

    peers = [s for s in specs if s.kind in ("peer_max", "peer_min")]
    ties = bool(peers) and any(c.ties for c in cuts)
    totals = cut_lineage(
        split.where(F.col(_HOT))
        .groupBy(*by)
        .agg(
            F.min(order[0]).alias("_lowest"),
            F.max(order[0]).alias("_high"),
            *[c for s in specs for c in _chunk_total(s, order, ties)],
        )
    )
    earlier = Window.partitionBy(*groups).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, "_high", *[_carried(s, earlier).alias(f"_c_{s.name}") for s in specs])
    if ties:
        # Rows that share the last instant of a chunk may continue in later chunks.
        heads = totals.groupBy(*groups, F.col("_lowest").alias("_high")).agg(
            *[(F.max if s.kind == "peer_max" else F.min)(f"_h_{s.name}").alias(f"_e_{s.name}") for s in peers]
        )
        carry = carry.join(heads, [*groups, "_high"], "left")

    joined = local.join(carry, by, "left").withColumn("_order_0", F.col(order[0]))
    return joined.withColumns({s.name: _combined(s, ties) for s in specs}).select(*df.columns, *[s.name for s in specs])


def nth_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, policy: SplitPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Number the rows of each key by ``order``."""
    return running_columns(df, keys, order, [ordinal(name)], policy)
