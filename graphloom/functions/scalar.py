"""Scalar functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def number_text(c: Column) -> Column:
    """A double as text without an exponent, whole numbers without a fraction."""
    long = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), "0+$", "")
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).when(F.abs(c) < 1e7, c.cast("string")).otherwise(long)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def strip_reference(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))


def wrap_reference(c: Column) -> Column:
    return F.when(c.startswith("[[") & c.endswith("]]"), c).otherwise(F.concat(F.lit("[["), c, F.lit("]]")))


@F.pandas_udf(StringType())
def nfc(c: pd.Series) -> pd.Series:
    """Composed characters (Unicode NFC), which has no built-in function."""
    return c.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def fold_typography(c: Column) -> Column:
    """Composed; curly quotes, dashes, ellipses and hard spaces to plain characters; lower case."""
    return F.lower(F.replace(F.translate(nfc(c), "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- "), F.lit("…"), F.lit("...")))


def title_case(c: Column) -> Column:
    """meeting-note -> Meeting Note: parts between dashes with a capital first letter."""
    return F.array_join(F.transform(F.split(c, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def spaced(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def dirname(path: Column) -> Column:
    """Up to the last slash; nothing without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")


def decode(value_type: Column, text: Column, number: Column) -> Column:
    """A stored field as JSON: numbers and booleans bare, lists as they are, the rest as strings."""
    quoted = F.substring(F.to_json(F.array(text)), 2, 2_000_000_000)
    quoted = F.substring(quoted, F.lit(1), F.length(quoted) - 1)
    return F.when(value_type == "number", number_text(number)).when(value_type.isin("boolean", "list"), text).otherwise(quoted)


def json_items(text: Column) -> Column:
    """A stored list as an array of texts."""
    return F.from_json(text, "array<string>")


def normal_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"[^\w\s]", ""), r"\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def round2(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def end_of_week(d: Column) -> Column:
    return F.date_add(d, 6 - F.weekday(d))


def snake_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def token_estimate(c: Column) -> Column:
    return F.ceil(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) * 1.3)


def safe_filename(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r'[\\:*?"<>|]', ""), r"\s+", " "))


def to_boolean(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    h, m, r = (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def quote_yaml(c: Column) -> Column:
    """A string as YAML: plain if it starts with a letter and holds only safe characters and can't be
    read as something else, else in double quotes."""
    safe = c.rlike(r"^[a-zA-Z][a-zA-Z0-9 _.\-]*$") & (c == F.trim(c)) & ~F.lower(c).isin("true", "false", "yes", "no", "on", "off") & ~c.isin("null", "Null", "NULL")
    return F.when(safe, c).otherwise(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def quote_key(c: Column) -> Column:
    return F.when(c.rlike(r"^[a-zA-Z_][a-zA-Z0-9_\-]*$"), c).otherwise(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
