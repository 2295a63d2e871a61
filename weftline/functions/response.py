"""Predicates and signals of a fetched response, as expressions over its columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAP = 2 * 1024 * 1024


def ok(status: Column, error: Column) -> Column:
    return error.isNull() & F.coalesce(status.between(200, 299), F.lit(False))


def not_modified(status: Column) -> Column:
    return F.coalesce(status == 304, F.lit(False))


def is_html(content_type: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html"))


def truncated(body: Column, cap: int = CAP) -> Column:
    return F.coalesce(F.octet_length(body) >= cap, F.lit(False))


def content_encoded(headers: Column) -> Column:
    return F.coalesce(F.map_contains_key(headers, "content-encoding"), F.lit(False))


def header_charset(content_type: Column) -> Column:
    """The charset a content type names, null without one: its parameter, unquoted, in lower case."""
    pair = F.filter(F.split(F.lower(content_type), ";"), lambda p: F.trim(F.substring_index(p, "=", 1)) == "charset")
    value = F.btrim(F.substring_index(F.get(pair, F.lit(0)), "=", -1), F.lit(" \t\"'"))
    return F.nullif(value, F.lit(""))
