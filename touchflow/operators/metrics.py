"""Metrics of experiment groups.

Two kinds: rates and revenue divide a sum by *all* units of the group (a null counts as zero),
means ignore nulls.  A metric whose input column is missing is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from touchflow.functions.scalars import safe_rate

# Metric -> input column.
RATES = {"conversion_rate": "converted", "engagement_rate": "engaged",
         "retention_rate": "retained"}
PER_UNIT = RATES | {"revenue_per_customer": "revenue"}
MEANS = {"time_to_conversion": "time_to_conversion",
         "customer_satisfaction": "satisfaction_score"}

RETAIL = ("conversion_rate", "revenue_per_customer", "engagement_rate", "retention_rate")
NON_RETAIL = ("engagement_rate", "conversion_rate", "time_to_conversion",
              "customer_satisfaction")


def _input(units: DataFrame, metric: str) -> Column | None:
    source = PER_UNIT.get(metric) or MEANS[metric]
    return F.col(source).cast("double") if source in units.columns else None


def _value(units: DataFrame, metric: str) -> Column:
    source = _input(units, metric)
    if source is None:
        return F.lit(0.0)
    if metric in PER_UNIT:
        return safe_rate(F.sum(source), F.count("*"))
    return F.avg(source)


def group_metrics(units: DataFrame, metrics: Sequence[str],
                  by: Sequence[str] = ("test_group",)) -> DataFrame:
    """One row per group: size and the named metrics, all in a single aggregation."""
    return units.groupBy(*by).agg(
        F.count("*").alias("sample_size"),
        *[_value(units, metric).alias(metric) for metric in metrics],
    )


def retail_metrics(units: DataFrame) -> DataFrame:
    return group_metrics(units, RETAIL)


def non_retail_metrics(units: DataFrame) -> DataFrame:
    return group_metrics(units, NON_RETAIL)


def distinct_groups(units: DataFrame) -> DataFrame:
    return units.select("test_group").distinct()


def metric_moments(units: DataFrame, metrics: Sequence[str],
                   by: Sequence[str] = ("test_group",)) -> DataFrame:
    """Long form for the tests: one row per (group, metric) with the sufficient statistics.

    ``n`` counts the observations behind the mean, ``total`` their sum and ``variance`` is the
    sample variance; ``sample_size`` is the size of the group.
    """
    aggregates = [F.count("*").alias("sample_size")]
    for metric in metrics:
        source = _input(units, metric)
        source = F.lit(0.0) if source is None else source
        observed = F.coalesce(source, F.lit(0.0)) if metric in PER_UNIT else source
        aggregates.append(F.struct(
            F.lit(metric).alias("metric"),
            _value(units, metric).alias("metric_value"),
            F.count(observed).alias("n"),
            F.coalesce(F.sum(observed), F.lit(0.0)).alias("total"),
            F.var_samp(observed).alias("variance"),
        ).alias(metric))
    wide = units.groupBy(*by).agg(*aggregates)
    return (wide.select(*by, "sample_size", F.explode(F.array(*metrics)).alias("m"))
            .select(*by, "sample_size", "m.*"))
