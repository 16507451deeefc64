"""Reading the many written forms of one annotation value.

All functions build Column expressions from built-in functions, so they run inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ["true", "yes", "1", "t", "y"]
FALSE_WORDS = ["false", "no", "0", "f", "n"]


def name_key(c: Column) -> Column:
    """Key under which names that differ only in case, blanks or joining marks are equal; null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def squeeze(c: Column) -> Column:
    """Trimmed, each run of white space as one blank."""
    return F.trim(F.regexp_replace(c, r"[\s\x{A0}]+", " "))


def as_bool(c: Column) -> Column:
    """true/false of a bool in any usual spelling, null of all else."""
    v = F.lower(squeeze(c))
    return F.when(v.isin(TRUE_WORDS), F.lit(True)).when(v.isin(FALSE_WORDS), F.lit(False))


def as_int(c: Column) -> Column:
    """Whole number: sign, leading zeros, comma-grouped thousands and a zero fraction are accepted."""
    v = squeeze(c)
    v = F.when(v.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.0*)?$"), F.regexp_replace(v, ",", "")).otherwise(v)
    plain = F.when(v.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(v, r"(^\+)|(\.0*$)", ""))
    # an exponent form counts if its value is whole
    d = F.when(v.rlike(r"^[+-]?\d+(\.\d+)?[eE][+-]?\d+$"), v).try_cast("double")
    whole = F.when((d == F.floor(d)) & (F.abs(d) < 9e15), d.cast("bigint"))
    return F.coalesce(plain.try_cast("bigint"), whole)


def as_float(c: Column) -> Column:
    """Number: decimal comma or point, exponent, bare fraction (.5) and percentages (as a fraction of 1)."""
    v = F.lower(squeeze(c))
    percent = v.rlike(r"%$")
    v = F.trim(F.regexp_replace(v, r"%$", ""))
    grouped = v.rlike(r"^[+-]?\d{1,3}(,\d{3})+\.\d+$") | v.rlike(r"^[+-]?\d{1,3}(,\d{3}){2,}$")
    v = F.when(grouped, F.regexp_replace(v, ",", "")).otherwise(F.regexp_replace(v, ",", "."))
    number = F.when(v.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?$"), v).try_cast("double")
    return F.when(percent, number / 100).otherwise(number)


def _labels(key_to_label: dict[str, str] | Column) -> Column:
    return key_to_label if isinstance(key_to_label, Column) else F.create_map(*[F.lit(x) for pair in key_to_label.items() for x in pair])


def as_label(c: Column, key_to_label: dict[str, str] | Column) -> Column:
    """The vocabulary label of which `c` is a spelling, else null; the vocabulary may be a map column."""
    if isinstance(key_to_label, dict) and not key_to_label:
        return F.lit(None).cast("string")
    table = _labels(key_to_label)
    return F.try_element_at(table, name_key(c))


def as_label_list(c: Column, key_to_label: dict[str, str] | Column) -> Column:
    """Sorted distinct vocabulary labels of a complete list, else null.

    Accepted: a bracketed list with items in double, single or no quotes separated by commas, or bare
    labels separated by `;`, `|` or `,`. A list that is not closed, or holds anything that is no label,
    is null; `[]` is an empty list.
    """
    v = squeeze(c)
    bracketed = v.rlike(r"^\[.*\]$")
    inner = F.when(bracketed, F.regexp_replace(v, r"^\[\s*|\s*\]$", "")).otherwise(v)
    items = F.split(inner, r"\s*[,;|]\s*")
    quoted = F.transform(items, lambda x: F.regexp_replace(x, r"""^"([^"]*)"$|^'([^']*)'$""", "$1$2"))
    table = _labels(key_to_label)
    # quotes that are left over, and brackets inside, make an item no label
    labels = F.transform(quoted, lambda x: F.when(~x.rlike(r"""["'\[\]{}]"""), F.try_element_at(table, name_key(x))))
    empty = F.array().cast("array<string>")
    return (
        F.when(bracketed & (inner == ""), empty)
        .when(v.rlike(r"^[^\[\]{}]+$") | bracketed, F.when(~F.exists(labels, lambda x: x.isNull()), F.array_sort(F.array_distinct(labels))))
    )


def label_keys(vocabulary: list[str]) -> dict[str, str]:
    """Comparison key of each label, as name_key gives it."""
    return {"".join(ch for ch in x.lower() if ch.isalnum()): x for x in vocabulary}
