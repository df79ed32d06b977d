"""Column expressions shared by the operators."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from touchflow.schemas import ACTIONS


def brand_region_segment() -> Column:
    """Brand and region joined by ``_``; null if either is null."""
    return F.concat(F.col("brand_preference"), F.lit("_"), F.col("region"))


def segment_priority() -> Column:
    """Above 1000 High, above 500 Medium, all else (null too) Low."""
    value = F.col("lifetime_value")
    return F.when(value > 1000, "High").when(value > 500, "Medium").otherwise("Low")


def is_weekend(at: Column) -> Column:
    return F.when(F.dayofweek(at).isin(1, 7), 1).otherwise(0)


def hash_bucket(*parts: Column) -> Column:
    """Stable bucket 0..99 of the parts joined by ``:``; the same on every run and engine."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100).cast("int")


def action_label(code: Column) -> Column:
    """Name of a class code; ``no_action`` for a code outside the list."""
    pairs = chain.from_iterable((F.lit(i), F.lit(name)) for i, name in enumerate(ACTIONS))
    label = F.try_element_at(F.create_map(*pairs), code.cast("int"))
    return F.coalesce(label, F.lit("no_action"))


def one_hot(code: Column, n_classes: int) -> Column:
    """Probability array with 1.0 at ``code``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                       lambda i: F.when(i == code, 1.0).otherwise(0.0))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, days included."""
    return F.call_function("div", F.unix_micros(end) - F.unix_micros(start),
                           F.lit(1_000_000))


def title_words(text: Column) -> Column:
    """``conversion_rate`` to ``Conversion Rate``."""
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def safe_rate(total: Column, rows: Column) -> Column:
    """total / rows as double; 0.0 for an empty group."""
    return F.coalesce(F.try_divide(total.cast("double"), rows.cast("double")), F.lit(0.0))


def fixed(value: Column | str, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded from the exact binary value.

    ``format_string`` would round the shortest decimal form, half up, so 1006.925 (which is
    stored slightly below) would print as 1006.93.
    """
    column = F.col(value) if isinstance(value, str) else value
    return F.call_function("format_number", column, F.lit("0." + "0" * digits))
