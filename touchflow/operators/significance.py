"""Each treatment against the control group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchflow.functions.distributions import (
    normal_critical, normal_p_value, t_critical_value, t_p_value,
)
from touchflow.functions.scalars import fixed, title_words
from touchflow.operators.experiments import Design
from touchflow.operators.metrics import RATES

# Name of the control group and texts of the report.
CONTROL = "control"
WINNER_TEXT = "%s group with %s%% lift"
DEPLOY_TEXT = "Deploy %s treatment to all customers"
NO_WINNER_TEXT = "No statistically significant difference found"
CONTINUE_TEXT = "Continue testing with larger sample size or longer duration"


def pair_with_control(moments: DataFrame, control: str = CONTROL,
                      by: Sequence[str] = ("metric",), keep_control: bool = False) -> DataFrame:
    """One row per treatment and metric, control statistics in ``c_*``, treatment in ``t_*``.

    The window spans one row per group.  Without a control row the ``c_*`` columns are null.
    ``keep_control`` pairs the control with itself too.
    """
    peers = Window.partitionBy(*by)
    names = ("sample_size", "metric_value", "n", "total", "variance")
    is_control = F.col("test_group") == control
    paired = moments.select(
        *by, "test_group",
        *[F.max(F.when(is_control, F.col(name))).over(peers).alias(f"c_{name}")
          for name in names],
        *[F.col(name).alias(f"t_{name}") for name in names],
    )
    return paired if keep_control else paired.filter(~is_control)


def _difference() -> Column:
    return F.col("t_metric_value") - F.col("c_metric_value")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def _proportion_columns(alpha: float) -> tuple[dict[str, Column], dict[str, Column]]:
    n1, n2 = F.col("c_n"), F.col("t_n")
    p1, p2 = F.col("c_metric_value"), F.col("t_metric_value")
    pooled = _ratio(F.col("c_total") + F.col("t_total"), n1 + n2)
    inverse = _ratio(F.lit(1.0), n1) + _ratio(F.lit(1.0), n2)
    margin = F.lit(normal_critical(alpha)) * F.sqrt(
        _ratio(p1 * (1 - p1), n1) + _ratio(p2 * (1 - p2), n2))
    return ({"_error": F.sqrt(pooled * (1 - pooled) * inverse), "_margin": margin},
            {"p_value": normal_p_value("statistic")})


def _t_columns(alpha: float, assumed_cv: float | None
               ) -> tuple[dict[str, Column], dict[str, Column]]:
    if assumed_cv is None:
        n1, n2 = F.col("c_n"), F.col("t_n")
        v1, v2 = F.col("c_variance"), F.col("t_variance")
    else:
        n1, n2 = F.col("c_sample_size"), F.col("t_sample_size")
        v1, v2 = (F.pow(F.col(name) * assumed_cv, F.lit(2.0))
                  for name in ("c_metric_value", "t_metric_value"))
    # The variance of a single observation is undefined and has weight 0.
    weighted = F.coalesce((n1 - 1) * v1, F.lit(0.0)) + F.coalesce((n2 - 1) * v2, F.lit(0.0))
    freedom = F.when((n1 > 0) & (n2 > 0) & (n1 + n2 > 2), (n1 + n2 - 2).cast("double"))
    error = F.sqrt(_ratio(weighted, freedom)
                   * (_ratio(F.lit(1.0), n1) + _ratio(F.lit(1.0), n2)))
    return ({"_df": freedom, "_error": error,
             "_margin": t_critical_value(F.lit(alpha), freedom) * error},
            {"p_value": t_p_value("statistic", "_df")})


def _tested(pairs: DataFrame, columns: tuple[dict[str, Column], dict[str, Column]]
            ) -> DataFrame:
    """Statistic (0 where the error is 0), p-value and interval."""
    spread, probability = columns
    statistic = F.when(F.col("_error") > 0, _ratio(_difference(), F.col("_error"))).when(
        F.col("_error") == 0, F.lit(0.0))
    return (pairs.withColumns(spread).withColumn("statistic", statistic)
            .withColumns(probability)
            .withColumn("ci_lower", _difference() - F.col("_margin"))
            .withColumn("ci_upper", _difference() + F.col("_margin"))
            .drop("_df", "_error", "_margin"))


def with_proportion_test(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Two-proportion z-test: pooled error for z, unpooled for the interval.

    A pooled error of 0 gives z = 0; an empty or missing control gives nulls.
    """
    return _tested(pairs, _proportion_columns(alpha))


def with_t_test(pairs: DataFrame, alpha: float = 0.05,
                assumed_cv: float | None = None) -> DataFrame:
    """Pooled two-sample t-test with n1 + n2 - 2 degrees of freedom.

    Uses the observed variances.  ``assumed_cv`` replaces them: each standard deviation is then
    that fraction of the group's mean, and n is the size of the group.
    """
    return _tested(pairs, _t_columns(alpha, assumed_cv))


def significance(moments: DataFrame, alpha: float = 0.05, control: str = CONTROL,
                 assumed_cv: float | None = None,
                 by: Sequence[str] = ("metric",)) -> DataFrame:
    """Verdict per treatment and metric: rates by the z-test, all else by the t-test.

    Both are computed for each of the few rows and one is kept, so ``moments`` is read once.
    """
    return _judged(pair_with_control(moments, control, by), alpha, assumed_cv, by)


def _judged(pairs: DataFrame, alpha: float = 0.05, assumed_cv: float | None = None,
            by: Sequence[str] = ("metric",)) -> DataFrame:
    is_rate = F.col("metric").isin(*RATES)
    outputs = ("statistic", "p_value", "ci_lower", "ci_upper")
    z = with_proportion_test(pairs, alpha).withColumnsRenamed({n: f"z_{n}" for n in outputs})
    both = with_t_test(z, alpha, assumed_cv)
    tested = both.withColumns({
        "test": F.when(is_rate, "proportion").otherwise("t"),
        **{name: F.when(is_rate, F.col(f"z_{name}")).otherwise(F.col(name))
           for name in outputs}})
    lift = F.when(F.col("c_metric_value") > 0,
                  _ratio(_difference(), F.col("c_metric_value")) * 100
                  ).when(F.col("c_metric_value").isNotNull(), F.lit(0.0))
    return tested.select(
        *by, "test_group", "test",
        F.col("c_sample_size").alias("control_size"),
        F.col("t_sample_size").alias("treatment_size"),
        F.col("c_metric_value").alias("control_metric"),
        F.col("t_metric_value").alias("treatment_metric"),
        lift.alias("lift_percentage"),
        "p_value",
        (F.col("p_value") < alpha).alias("is_significant"),
        "ci_lower", "ci_upper",
        F.abs(_difference()).alias("effect_size"),
    )


def _advice(significant: Column) -> tuple[Column, Column]:
    """Result and recommendation of the best treatment."""
    result = F.when(significant, F.format_string(WINNER_TEXT, _title_group(),
                                                 fixed("lift_percentage", 2)))
    advice = F.when(significant, F.format_string(DEPLOY_TEXT, "test_group"))
    return result.otherwise(NO_WINNER_TEXT), advice.otherwise(CONTINUE_TEXT)


def winner(verdicts: DataFrame, primary_metric: str) -> DataFrame:
    """The treatment with the largest lift (first name on ties) and what to do about it."""
    best = (verdicts.filter(F.col("metric") == primary_metric)
            .orderBy(F.desc_nulls_last("lift_percentage"), "test_group").limit(1))
    significant = F.coalesce(F.col("is_significant"), F.lit(False))
    result, advice = _advice(significant)
    return best.select(
        "metric", "test_group", "lift_percentage", "p_value",
        significant.alias("is_significant"), result.alias("result"),
        advice.alias("recommendation"))


def _title_group() -> Column:
    return F.replace(title_words(F.col("test_group")), F.lit(" "), F.lit("_"))


def _line(section: str, group: Column, label: Column | str, value: Column) -> Column:
    text = F.lit(label) if isinstance(label, str) else label
    return F.struct(F.lit(section).alias("section"), group.alias("test_group"),
                    text.alias("label"), value.alias("value"))


def summary(moments: DataFrame, design: Design, alpha: float = 0.05, control: str = CONTROL
            ) -> DataFrame:
    """Report lines as rows: (section, test_group, label, value), values formatted as text.

    One pass over the moments: each row of a group and metric spells out its own lines.
    """
    judged = _judged(pair_with_control(moments, control, keep_control=True), alpha)
    treated = F.col("test_group") != control
    primary = F.col("metric") == design.primary_metric
    best = Window.partitionBy("metric", treated).orderBy(
        F.desc_nulls_last("lift_percentage"), "test_group")
    ranked = judged.withColumn("_rank", F.row_number().over(best))

    own, nobody = F.col("test_group"), F.lit(None).cast("string")
    shown = [("Vertical Type", design.vertical), ("Primary Metric", design.primary_metric),
             ("Test Duration", f"{design.duration_days} days")]
    if design.start_date:
        shown.append(("Start Date", design.start_date))
    against = F.concat(_title_group(), F.lit(" vs Control"))
    significant = F.coalesce(F.col("is_significant"), F.lit(False))
    result, advice = _advice(significant)
    lines = [
        (F.lit(True), [_line("result", own, title_words(F.col("metric")),
                             fixed("treatment_metric", 4))]),
        (primary, [_line("sample_size", own, "Customers",
                         F.col("treatment_size").cast("string"))]),
        (primary & ~treated, [_line("overview", nobody, label, F.lit(value))
                              for label, value in shown]),
        (primary & treated, [
            _line("significance", against, "Lift",
                  F.concat(fixed("lift_percentage", 2), F.lit("%"))),
            _line("significance", against, "P-value", fixed("p_value", 4)),
            _line("significance", against, "Statistically Significant",
                  F.when(F.col("is_significant"), "Yes").otherwise("No")),
            _line("significance", against, "Confidence Interval", F.format_string(
                "[%s, %s]", fixed("ci_lower", 4), fixed("ci_upper", 4)))]),
        (primary & treated & (F.col("_rank") == 1), [
            _line("recommendation", own, F.when(significant, "Winner").otherwise("Result"), result),
            _line("recommendation", own, "Recommendation", advice)]),
    ]
    each = F.flatten(F.array(*[
        F.when(holds, F.array(*rows)).otherwise(F.filter(F.array(*rows), lambda _: F.lit(False)))
        for holds, rows in lines]))
    return ranked.select(F.explode(each).alias("line")).select("line.*")
