"""Scalar expressions on names, paths, numbers and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, or ``default`` where den is 0 or a side is null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(default))


def method_key(*parts: Column) -> Column:
    return F.concat_ws(" | ", *parts)


def safe_name(text: Column, longest: int = 180) -> Column:
    """A file name: runs of other characters than word characters, '-' and '.' become '__'."""
    cleaned = F.regexp_replace(text, r"(?U)[^\w\-.]+", "__")
    return F.substring(F.regexp_replace(cleaned, r"^[._]+|[._]+$", ""), 1, longest)


def natural_key(text: Column) -> Column:
    """A string that sorts digit runs by value, whatever their length: each run without its leading
    zeros follows the number of its digits, in four places."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    value = lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", "")
    counted = lambda p: F.concat(F.lpad(F.length(value(p)).cast("string"), 4, "0"), value(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), counted(p)).otherwise(p)), "")


def short_method(key: Column, longest: int = 80) -> Column:
    return F.substring(key, 1, longest)


def shape_text(h: Column, w: Column) -> Column:
    return F.concat(h.cast("string"), F.lit("x"), w.cast("string"))


def nearest_int(v: Column) -> Column:
    """Half to even."""
    return F.rint(v).cast("int")


def label_text(label: Column) -> Column:
    """A trimmed label; none or blank is 'unlabeled'."""
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit("unlabeled"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
