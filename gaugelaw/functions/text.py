"""Columns over short texts and numbers: cells, labels, parameter lists, rounding, paths and words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of names that count as paths of a repository.
EXTENSIONS = ("py", "md", "json", "csv", "txt", "yaml", "html", "svg")


def significant(x: Column, digits: int = 6) -> Column:
    """A number rounded to so many significant digits; 0, nulls and what is not finite stay."""
    plain = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x == 0)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(plain, x).otherwise(F.round(x * scale) / scale)


def cell(x: Column, kind: str = "string") -> Column:
    """What an import writes for a value: nothing for null, 1 or 0 for a boolean."""
    text = F.when(x, "1").otherwise("0") if kind == "boolean" else x.cast("string")
    return F.when(x.isNull(), "").otherwise(text)


def pairs(text: Column) -> Column:
    """The map in "k=v,k=v", trimmed; items without a name or "=" are left out, and of a name that occurs twice the last counts."""
    items = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^[^=\s][^=]*="))
    each = F.transform(items, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_extract(p, "=(.*)$", 1)).alias("v")))
    last = F.filter(each, lambda e, i: ~F.exists(F.slice(each, i + 2, F.size(each)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def label(kind: Column, names: Column) -> Column:
    """A default label: the kind and the names it is about, joined by hyphens; the kind alone without names."""
    return F.when(F.size(names) > 0, F.concat_ws("-", kind, F.array_join(F.array_sort(names), "-"))).otherwise(kind)


def describe_scales(scales: Column) -> Column:
    """Factors by name in words: "p x2.0, q x3.0", in the order of the names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(scales)), lambda e: F.concat(e["key"], F.lit(" x"), e["value"].cast("string"))), ", ")


def is_repo_path(x: Column, folders: Sequence[str] = ("src", "tests", "docs", "examples")) -> Column:
    """Whether a word looks like a path of a repository: no address, and a known ending or a known first folder."""
    plain = ~x.rlike(r"^[a-z]+://|\s|^$")
    return plain & (F.element_at(F.split(x, r"\."), -1).isin(*EXTENSIONS) & x.contains(".") | (F.substring_index(x, "/", 1).isin(*folders) & x.contains("/")))


def powers_in(text: Column) -> Column:
    """The names that a text raises to a whole power, as "name**n" without white space, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w*\s*(?:\*\*|\^)\s*\d+)"), 1), lambda x: F.replace(F.regexp_replace(x, r"\s", ""), F.lit("^"), F.lit("**"))))


def names_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text has one of the words, in any case."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return F.coalesce(out, F.lit(False))


def steps_of(values: Column) -> Column:
    """The differences of neighbouring values of an array."""
    return F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda b, a: b - a)
