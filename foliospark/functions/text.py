"""Column functions of the revision tools: white space, search snippets, numbers, names, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Unicode white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def alignment_key(text: Column) -> Column:
    return F.lower(normalised(text))


def not_blank(text: Column) -> Column:
    return F.coalesce(normalised(text) != "", F.lit(False))


def compare_key(text: Column) -> Column:
    """What a line is compared by: its text without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def match_count(text: Column, query: Column) -> Column:
    """Non-overlapping, case-insensitive occurrences of a query."""
    low, asked = F.lower(text), F.lower(query)
    return F.when(F.length(asked) > 0, ((F.length(low) - F.length(F.replace(low, asked, F.lit("")))) / F.length(asked)).cast("long")).otherwise(F.lit(0).cast("long"))


def snippet(text: Column, query: Column, around: int = 40) -> Column:
    """The first occurrence with its surroundings, white space as spaces; leading dots where something is cut on the left."""
    at = F.call_function("instr", F.lower(text), F.lower(query))
    start = F.greatest(at - 1 - around, F.lit(0))
    end = F.least(at - 1 + F.length(query) + around, F.length(text))
    cut = F.trim(F.regexp_replace(F.substring(text, start + 1, end - start), r"(?U)\s", " "))
    return F.when(at > 0, F.concat(F.when(start > 0, "...").otherwise(""), cut))


def numeral(value: Column | str, pattern: str) -> Column:
    """A number by a decimal pattern, half to even on the binary value."""
    return F.call_function("format_number", F.col(value) if isinstance(value, str) else value, F.lit(pattern))


def one_decimal(value: Column) -> Column:
    """One decimal, half to even on the binary value; null gives the empty string."""
    return F.coalesce(numeral(value, "0.0"), F.lit(""))


def corners(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """(l,t)-(r,b) with one decimal; null gives the empty string."""
    d = one_decimal
    return F.when(left.isNull(), "").otherwise(F.concat(F.lit("("), d(left), F.lit(","), d(top), F.lit(")-("), d(right), F.lit(","), d(bottom), F.lit(")")))


def html_escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def base_name(path: Column) -> Column:
    """What follows the last slash of either kind; the whole path where that is empty."""
    last = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.when(last == "", path).otherwise(last)


def extension(path: Column) -> Column:
    """What follows the last dot of the base name, in lower case; empty without one."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return precision(tp, fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide((2 * tp).cast("double"), (2 * tp + fp + fn).cast("double")), F.lit(0.0))


def valid(tp: Column, fp: Column, fn: Column) -> Column:
    return tp + fp + fn > 0
