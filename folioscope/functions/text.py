"""Scalar expressions over titles, names, years, identifiers and stored values."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: chapter titles that hold no narrative text
PARATEXT = ["title page", "table of contents", "contents", "errata", "advertisement", "subscribers", "index"]
# fixed values: endings of a first name that mark a classical one
CLASSICAL_ENDINGS = ["us", "ia", "issa", "andra", "ander", "enes", "oles", "inda", "etta", "ina"]


def is_paratext(title: Column) -> Column:
    """Whether a chapter title names front or back matter; null counts as no title."""
    return F.lower(F.coalesce(title, F.lit(""))).rlike("|".join(PARATEXT))


def is_named(kind: Column, name: Column, generic: Sequence[str] = ("the ", "a ", "an ", "his ", "her ", "my ", "our ", "their ", "some ", "one ", "two ", "old ", "young ", "another ")) -> Column:
    """A character with a proper name: of type character, capitalised, and not a generic phrase."""
    generic_start = F.lower(name).rlike("^(" + "|".join(generic) + ")")
    return F.coalesce((kind == "character") & name.rlike(r"^\p{Lu}") & ~generic_start, F.lit(False))


def section_scheme(section: Column) -> Column:
    """'p500:25' -> 'p500'; a bare number or anything else -> 'unknown'."""
    return F.when(section.rlike(r"^[^:]+:\d+$"), F.substring_index(section, ":", 1)).otherwise("unknown")


def section_seq(section: Column) -> Column:
    """'p500:25' -> 25, '7' -> 7, anything else -> 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(section, F.lit("")), r"^(?:[^:]+:)?(\d+)$", 1).try_cast("bigint"), F.lit(0))


def coerce_list(value: Column) -> Column:
    """A stored list as an array: JSON or Python spelling; anything unreadable is an empty array."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def norm_bool(value: Column) -> Column:
    """Three-valued reading: true/1, false/0/empty, null for all else."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "1"), F.lit(True)).when(v.isin("false", "0", ""), F.lit(False))


def norm_list(value: Column) -> Column:
    """Sorted labels, duplicates kept."""
    return F.array_sort(coerce_list(value))


def truthy(value: Column) -> Column:
    """The reading that rates use: true, 1 or yes."""
    return F.coalesce(F.lower(value).isin("true", "1", "yes"), F.lit(False))


def list_contains(value: Column, element: str) -> Column:
    """Whether a stored list holds an element; an unreadable list holds none."""
    return F.coalesce(F.array_contains(F.from_json(value, "array<string>"), element), F.lit(False))


def serialize(value: Column, kind: str) -> Column:
    """How a value is stored: booleans as words, lists as JSON, null as an empty text."""
    text = F.to_json(value) if kind in ("list", "struct", "map") else value.cast("string")
    return F.coalesce(text, F.lit(""))


def half_century(year: Column) -> Column:
    """1723 -> '1700-1749'; rounds down for years before 0 too; null stays null."""
    low = (F.floor(year / 50) * 50).cast("bigint")
    return F.concat(low.cast("string"), F.lit("-"), (low + 49).cast("string"))


def century_range(year: Column) -> Column:
    """1723 -> '1700-1800'."""
    low = (F.floor(year / 100) * 100).cast("bigint")
    return F.concat(low.cast("string"), F.lit("-"), (low + 100).cast("string"))


def period_bin(year: Column, breaks: Sequence[int]) -> Column:
    """Label 'low-(high-1)' of the interval [low, high) that holds the year; null outside all."""
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(breaks, breaks[1:]))):
        out = F.when((year >= low) & (year < high), f"{low}-{high - 1}").otherwise(out)
    return out


def period_dummies(year: Column, breaks: Sequence[int] = (1600, 1650, 1700, 1750, 1800, 1850, 1900)) -> dict[str, Column]:
    """One 0/1 column per interval."""
    return {f"period_{low}_{high - 1}": F.coalesce(((year >= low) & (year < high)).cast("int"), F.lit(0)) for low, high in zip(breaks, breaks[1:])}


def ordinal(value: Column, ranks: Mapping[str, int]) -> Column:
    """Rank of an ordered label, -1 if unknown, empty or null."""
    table = F.create_map(*[F.lit(x) for p in ranks.items() for x in p])
    return F.coalesce(F.try_element_at(table, value), F.lit(-1))


def last_name(author: Column) -> Column:
    """What stands before the first comma."""
    return F.trim(F.substring_index(author, ",", 1))


def model_slug(model: Column) -> Column:
    """Name of a model as part of a file name: after the last slash, lower, without dots and colons."""
    return F.regexp_replace(F.lower(F.substring_index(model, "/", -1)), r"[.:]", "")


def path_slug(ident: Column) -> Column:
    """Identifier as a file name."""
    return F.regexp_replace(F.regexp_replace(F.lower(ident), r"^_", ""), r"[/\s]+", "_")


def slug_to_id(slug: Column) -> Column:
    """'quarto_Q0000000' -> '_quarto/Q0000000' (case of the slug kept); null if it has no corpus part."""
    return F.when(slug.rlike(r"^[^_]+_.+"), F.concat(F.lit("_"), F.substring_index(slug, "_", 1), F.lit("/"), F.regexp_extract(slug, r"^[^_]+_(.+)$", 1)))


def sane_year(year: Column) -> Column:
    """A year between -500 and 2100, read through a number; else null."""
    y = year.cast("string").try_cast("double").cast("int")
    return F.when(y.between(-500, 2100), y)


def json_text(meta: Column, key: str) -> Column:
    """A JSON field as text, empty if missing."""
    return F.coalesce(F.get_json_object(meta, f"$.{key}"), F.lit(""))


def first_text(*values: Column) -> Column:
    """The first value that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values], F.lit(""))


def full_title(title: Column, sub: Column, alternate: Column | None = None) -> Column:
    """Title with its subtitle after ': ', or after a blank where the title ends in a mark; an alternate title comes first."""
    main = first_text(alternate, title) if alternate is not None else first_text(title)
    s = F.trim(F.regexp_replace(F.coalesce(sub, F.lit("")), r"^[\s:;,]+", ""))
    return F.when(s == "", main).when(main == "", s).when(main.rlike(r"[:;.?!,]$"), F.concat(main, F.lit(" "), s)).otherwise(F.concat(main, F.lit(": "), s))


def source_label(family: Column, agent: Column, task: Column, version: Column) -> Column:
    return F.concat(family, F.lit(":"), agent, F.lit(":"), task, F.lit(":v"), version.cast("string"))


def keep_last_words(text: Column, n: int) -> Column:
    """The last n words, marked by '... ' if any were left out."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) <= n, text).otherwise(F.concat(F.lit("... "), F.array_join(F.slice(words, -n, n), " ")))


def classify_name(name: Column, realistic: Column | None = None) -> Column:
    """type, realistic, classical, other or unknown, in that order of tests; `realistic`: array of known everyday names."""
    out = F.when(F.coalesce(name, F.lit("")) == "", "unknown").when(F.lower(name).rlike("^(the |a |an )") | name.rlike(r"^[A-Z][a-z]+'s "), "type")
    if realistic is not None:
        words = F.transform(F.split(F.lower(name), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))
        out = out.when(F.arrays_overlap(words, realistic), "realistic")
    return out.when(F.lower(F.substring_index(F.trim(name), " ", 1)).rlike("(" + "|".join(CLASSICAL_ENDINGS) + ")$"), "classical").otherwise("other")


def header_field(text: Column, field: str) -> Column:
    """Value of 'Field: value' on a line of its own among the first 1,000 characters (the last one counts); null if absent."""
    return F.nullif(F.trim(F.regexp_extract(F.substring(text, 1, 1000), rf"(?s)^.*(?:^|\n){field}:[ \t]*([^\n]*)", 1)), F.lit(""))


def id_author(ident: Column) -> Column:
    """Author part of an identifier whose last part is Author.Title.Year."""
    return F.nullif(F.substring_index(F.element_at(F.split(ident, "/"), -1), ".", 1), F.lit(""))


def id_title(ident: Column) -> Column:
    """Title part of such an identifier, without a final year."""
    tail = F.regexp_replace(F.element_at(F.split(ident, "/"), -1), r"\.\d{4}$", "")
    return F.when(tail.contains("."), F.regexp_extract(tail, r"^[^.]*\.(.*)$", 1))


def item_key(ident: Column, section: Column, prompt: Column) -> Column:
    """'id::section', or a digest of the prompt where there is no id; the same in every process."""
    return F.coalesce(F.concat(F.nullif(ident, F.lit("")), F.lit("::"), F.coalesce(section, F.lit(""))), F.substring(F.sha2(prompt, 256), 1, 12))


def parse_field_spec(spec: str | tuple[str, str]) -> dict[str, str | None]:
    """'f', ('f', label) or ('f::element', label) as field, element and label."""
    name, label = spec if isinstance(spec, tuple) else (spec, None)
    field, _, element = name.partition("::")
    return {"field": field, "element": element or None, "label": label or (element or field)}


#: Order matters: prefixes of local servers come before substrings of model names.
ROUTES = [("local/", "local"), ("ollama/", "local"), ("vllm/", "local"), ("rule", "rule")]


def provider_route(model: Column, routes: Sequence[tuple[str, str]] = tuple(ROUTES)) -> Column:
    """Provider of a model name by the first prefix that fits, else 'rule' (the deterministic one)."""
    out = None
    for prefix, provider in routes:
        out = F.when(model.startswith(prefix), provider) if out is None else out.when(model.startswith(prefix), provider)
    return out.otherwise("rule")


def strip_route(model: Column, routes: Sequence[tuple[str, str]] = tuple(ROUTES)) -> Column:
    return F.regexp_replace(model, "^(" + "|".join(p for p, _ in routes if p.endswith("/")) + ")", "")


def resolve_model(name: str, short: Mapping[str, str]) -> str:
    """Full name of a short tag; a name with a slash or a known prefix passes; anything else is an error."""
    if name in short:
        return short[name]
    if "/" in name or any(name.startswith(p.rstrip("/")) for p, _ in ROUTES):
        return name
    raise KeyError(f"unknown model {name!r}; known tags: {', '.join(sorted(short))}")


def base_url(backend: str, environ: Mapping[str, str] | None = None, default: str = "http://127.0.0.1:8000/v1") -> str:
    """Address of a local server: of the backend, else the general one, else the default."""
    env = os.environ if environ is None else environ
    return env.get(f"{backend.upper()}_BASE_URL") or env.get("LOCAL_BASE_URL") or default


def recognised(estimated: Column, year: Column, author: Column, first_name: Column) -> Column:
    """Whether a model seems to know a text: its year is the catalogue's, and the author is unnamed or has the first name it gave."""
    given = F.lower(F.trim(first_name))
    nameless = F.coalesce(F.trim(author), F.lit("")).rlike(r"(?i)^(anon(ymous)?\.?|unknown)?$")
    return F.coalesce((estimated == year) & (nameless | ((given != "") & F.contains(F.lower(author), given))), F.lit(False))
