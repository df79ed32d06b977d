"""Experiment design, assignment of units to groups, sample sizes."""

from __future__ import annotations

from dataclasses import dataclass, replace
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from touchflow.functions.scalars import hash_bucket, safe_rate


@dataclass(frozen=True)
class Group:
    name: str
    treatment: str
    description: str
    percent: int


# Groups, metrics and duration of the standard experiment.
GROUPS = (
    Group("control", "random_assignment", "Random assignment baseline", 20),
    Group("simple_rules", "business_rules", "Simple recommendation rules", 20),
    Group("ml_ensemble", "ensemble_model", "ML ensemble recommendations", 60),
)
METRICS_BY_VERTICAL = {
    "retail": ("conversion_rate",
               ("revenue_per_customer", "engagement_rate", "retention_rate")),
    "non_retail": ("engagement_rate",
                   ("conversion_rate", "time_to_conversion", "customer_satisfaction")),
}
DURATION_DAYS = 28


@dataclass(frozen=True)
class Design:
    """``segments`` are a list, a table whose first column has them, or None for all there are."""

    segments: tuple[str, ...] | DataFrame | None
    vertical: str = "retail"
    groups: tuple[Group, ...] = GROUPS
    primary_metric: str = "conversion_rate"
    secondary_metrics: tuple[str, ...] = ()
    start_date: str | None = None
    duration_days: int = DURATION_DAYS


def design_experiment(segments, vertical: str = "retail", start_date: str | None = None,
                      **changes) -> Design:
    primary, secondary = METRICS_BY_VERTICAL.get(vertical, METRICS_BY_VERTICAL["retail"])
    if segments is not None and not isinstance(segments, DataFrame):
        segments = tuple(segments)
    design = Design(segments, vertical, primary_metric=primary,
                    secondary_metrics=secondary, start_date=start_date)
    design = replace(design, **changes)
    if sum(group.percent for group in design.groups) > 100:
        raise ValueError("allocations exceed 100 percent")
    return design


def plan_table(spark: SparkSession, design: Design) -> DataFrame:
    """One row per group of the design."""
    return spark.createDataFrame(
        [(g.name, g.treatment, g.description, g.percent, design.primary_metric,
          design.duration_days) for g in design.groups],
        "test_group string, treatment string, description string, allocation_percent int, "
        "primary_metric string, duration_days int",
    )


def _group_array(design: Design, total: Column) -> Column:
    """Array of (position, group, size, cut) for a segment of ``total`` units.

    A group takes ``floor(total * percent / 100)`` units; ``cut`` is the rank of its last unit.
    """
    entries, cut = [], F.lit(0).cast("long")
    for position, group in enumerate(design.groups):
        size = F.floor(total * group.percent / 100).cast("long")
        cut = cut + size
        entries.append(F.struct(
            F.lit(position).alias("position"), F.lit(group.name).alias("test_group"),
            F.lit(group.treatment).alias("treatment"),
            F.lit(group.description).alias("description"),
            F.lit(group.percent).alias("allocation_percent"),
            size.alias("group_size"), cut.alias("cut"),
        ))
    return F.array(*entries)


def _in_segments(units: DataFrame, design: Design, segment_col: str) -> DataFrame:
    """Units of the design's segments; null is no segment."""
    segments = design.segments
    if segments is None:
        return units.filter(F.col(segment_col).isNotNull())
    if isinstance(segments, DataFrame):
        wanted = segments.select(F.col(segments.columns[0]).alias(segment_col))
        return units.join(wanted, segment_col, "left_semi").select(*units.columns)
    return units.filter(F.col(segment_col).isin(*segments))


def plan_sizes(units: DataFrame, design: Design,
               segment_col: str = "customer_segment") -> DataFrame:
    """Planned size of every group in every listed segment, with metric and duration."""
    totals = (_in_segments(units, design, segment_col)
              .groupBy(segment_col).agg(F.count("*").alias("segment_size")))
    return (totals
            .select(segment_col, "segment_size",
                    F.explode(_group_array(design, F.col("segment_size"))).alias("g"))
            .select(segment_col, "segment_size", "g.test_group", "g.treatment", "g.description",
                    "g.allocation_percent", "g.group_size",
                    F.lit(design.primary_metric).alias("primary_metric"),
                    F.lit(design.duration_days).alias("duration_days")))


def assign_stratified(units: DataFrame, design: Design, *, id_col: str = "customer_id",
                      segment_col: str = "customer_segment", seed: int = 42,
                      prefix_digits: int = 3) -> DataFrame:
    """Random split of each listed segment in the planned proportions, exact to the unit.

    Units are ordered by ``md5(seed:id)``, then id (ids must be unique), and the order is cut at
    the planned ranks; what is left over and unlisted segments are dropped.

    A segment can hold a large part of all units, so it is never ranked in one task.  Counts per
    hash prefix show which prefix every cut falls into; only units of those prefixes are ranked,
    which yields the exact boundary unit of each group.  Assigning a unit is then a comparison
    with its segment's boundaries: the pass over all units has no shuffle.  Both broadcasts hold
    at most ``len(segments) * len(groups)`` rows.
    """
    listed = _in_segments(units, design, segment_col)
    # A table of segments may be of any size: its boundaries are joined as Catalyst sees fit.
    small = (lambda rows: rows) if isinstance(design.segments, DataFrame) else F.broadcast
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    position = F.struct(hashed.alias("hash"), F.col(id_col).alias("id"))
    prefix = F.substring(hashed, 1, prefix_digits)

    slim = listed.select(F.col(segment_col).alias("_segment"), prefix.alias("_prefix"),
                         position.alias("_position"))
    in_segment = Window.partitionBy("_segment")
    ranges = (
        slim.groupBy("_segment", "_prefix").agg(F.count("*").alias("_rows"))
        .withColumn("_total", F.sum("_rows").over(in_segment))
        .withColumn("_upto", F.sum("_rows").over(in_segment.orderBy("_prefix")))
        .withColumn("_before", F.col("_upto") - F.col("_rows"))
    )
    cuts = (
        ranges.select("_segment", "_prefix", "_before", "_upto",
                      F.explode(_group_array(design, F.col("_total"))).alias("_g"))
        .filter((F.col("_before") < F.col("_g.cut")) & (F.col("_g.cut") <= F.col("_upto")))
        .groupBy("_segment", "_prefix", "_before")
        .agg(F.collect_list(F.struct("_g.test_group", "_g.cut")).alias("_cuts"))
    )
    in_prefix = Window.partitionBy("_segment", "_prefix").orderBy("_position")
    boundaries = (
        slim.join(small(cuts), ["_segment", "_prefix"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(in_prefix))
        .withColumn("_cut", F.explode("_cuts"))
        .filter(F.col("_rank") == F.col("_cut.cut"))
        .groupBy("_segment")
        .agg(*[F.max(F.when(F.col("_cut.test_group") == g.name, F.col("_position")))
               .alias(f"_end_{i}") for i, g in enumerate(design.groups)])
    )
    group = F.lit(None).cast("string")
    for i, g in reversed(list(enumerate(design.groups))):
        group = F.when(position <= F.col(f"_end_{i}"), F.lit(g.name)).otherwise(group)
    return (
        listed.join(small(boundaries), F.col(segment_col) == F.col("_segment"))
        .select(*[F.col(name) for name in units.columns], group.alias("test_group"))
        .dropna(subset=["test_group"])
    )


def assign_by_hash(customers: DataFrame, test_name: str, *, id_col: str = "customer_id",
                   share_a: int = 50, group_col: str = "test_group") -> DataFrame:
    """Sticky A/B group from a stable hash of customer and test; needs no stored assignment."""
    bucket = hash_bucket(F.col(id_col).cast("string"), F.lit(test_name))
    return customers.withColumn(group_col, F.when(bucket < share_a, "A").otherwise("B"))


def sample_size(baseline: Column, effect: Column, alpha: float = 0.05,
                power: float = 0.8) -> Column:
    """Units needed per group to detect ``baseline`` moving by ``effect``.

    n = 2 ((z[1 - alpha/2] + z[power]) / d)^2 with the standardised difference
    d = |effect| / sqrt(p (1 - p)) at the mean p of both rates.  Null where d is undefined or 0.
    """
    normal = NormalDist()
    z = normal.inv_cdf(1 - alpha / 2) + normal.inv_cdf(power)
    mean_rate = baseline + effect / 2
    spread = mean_rate * (1 - mean_rate)
    usable = (spread > 0) & (effect != 0)
    d = F.abs(effect) / F.sqrt(F.when(usable, spread))
    return F.ceil(2 * F.pow(F.lit(z) / d, F.lit(2.0))).cast("long")


def sample_size_by_segment(units: DataFrame, minimum_detectable_effect: float,
                           alpha: float = 0.05, power: float = 0.8,
                           segment_col: str = "customer_segment",
                           flag_col: str = "converted") -> DataFrame:
    """Required size per group, from each segment's observed conversion rate."""
    rates = units.groupBy(segment_col).agg(
        F.count("*").alias("segment_size"),
        safe_rate(F.sum(F.col(flag_col).cast("long")), F.count("*")).alias("baseline_rate"),
    )
    needed = sample_size(F.col("baseline_rate"), F.lit(float(minimum_detectable_effect)),
                         alpha, power)
    return rates.withColumn("required_per_group", needed)
