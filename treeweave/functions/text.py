"""Counts, token estimates and display numbers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The weights of the token estimate.
BYTES_PER_TOKEN = 3.3
TOKENS_PER_WORD = 0.75
TOKENS_PER_LINE = 0.1


def byte_count(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def word_count(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("bigint")


def line_count(text: Column) -> Column:
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    open_end = (F.length(text) > 0) & ~text.endswith("\n")
    return (breaks + open_end.cast("int")).cast("bigint")


def marker_count(text: Column) -> Column:
    """Non-overlapping occurrences of the block marker, so `a === b` inside a source counts as well."""
    return ((F.length(text) - F.length(F.replace(text, F.lit("=== "), F.lit("")))) / 4).cast("bigint")


def token_estimate(n_bytes: Column, n_words: Column, n_lines: Column) -> Column:
    """Single-precision arithmetic throughout, then truncation."""

    def single(value) -> Column:
        column = value if isinstance(value, Column) else F.lit(value)
        return column.cast("float")

    # A division widens to double, and the optimizer then skips a bare cast to single; the product by one keeps it.
    by_bytes = single(single(n_bytes) * single(1.0) / single(BYTES_PER_TOKEN))
    mean = single((by_bytes + single(n_words) * single(TOKENS_PER_WORD)) / single(2.0))
    return (mean + single(n_lines) * single(TOKENS_PER_LINE)).cast("bigint")


def text_tokens(text: Column) -> Column:
    return token_estimate(byte_count(text), word_count(text), line_count(text))


def _one_decimal(value: Column) -> Column:
    return F.replace(F.format_number(value, 1), F.lit(","), F.lit(""))


def size_label(n_bytes: Column) -> Column:
    value = n_bytes.cast("double")
    label = F.when(value < 1024, F.concat(_one_decimal(value), F.lit(" B")))
    for power, unit in ((1, " KB"), (2, " MB")):
        label = label.when(value < 1024.0 ** (power + 1), F.concat(_one_decimal(value / 1024.0**power), F.lit(unit)))
    return label.otherwise(F.concat(_one_decimal(value / 1024.0**3), F.lit(" GB")))


def token_label(tokens: Column) -> Column:
    value = tokens.cast("double")
    return (
        F.when(tokens >= 1_000_000, F.concat(_one_decimal(value / 1e6), F.lit("M")))
        .when(tokens >= 1_000, F.concat(_one_decimal(value / 1e3), F.lit("k")))
        .otherwise(tokens.cast("string"))
    )
