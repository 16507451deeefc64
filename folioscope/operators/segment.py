"""Texts into passages: windows, chapters, parts, chunks, and the prompts made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import is_paratext, last_name


def words(text: Column) -> Column:
    """White-space separated words; an empty or null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def _once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """Adds a column behind a generator, so that the optimizer doesn't compute it anew for each use."""
    return df.withColumn(name, F.explode(F.array(c)))


def fixed_windows(texts: DataFrame, key: str, text: str, size: int = 500) -> DataFrame:
    """(key, seq, text, n_words): consecutive windows of `size` words; the last may be short. A text without words gives none."""
    w = _once(texts.select(key, words(F.col(text)).alias("_w")), "w", F.col("_w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.size("w") - 1) / size).cast("bigint"))
    rows = w.select(key, "w", F.explode(starts).alias("seq"))
    part = F.slice("w", (F.col("seq") * size + 1).cast("int"), F.lit(size))
    return rows.select(key, "seq", F.array_join(part, " ").alias("text"), F.size(part).alias("n_words"))


def window_starts(total: Column, size: int, count: int, strategy: str) -> Column:
    """Start words of `count` windows: even, stratified (ends and evenly inside) or endpoints; one window where the text is shorter than one."""
    last = F.greatest(F.lit(0), total - size).cast("bigint")
    zero = F.lit(0).cast("bigint")
    if strategy == "endpoints" or (strategy == "stratified" and count <= 2):
        starts = F.array(zero, last)
    elif strategy in ("stratified", "even"):
        starts = F.array((F.floor(total / 2) - size // 2).cast("bigint")) if count == 1 else F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * last / (count - 1)).cast("bigint"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return F.when(total < size, F.array(zero)).otherwise(starts)


def sampled_windows(texts: DataFrame, key: str, text: str, size: int = 500, count: int = 5, strategy: str = "even") -> DataFrame:
    """(key, section_id, passage_index, start, text, n_words) of windows at chosen places; windows may overlap."""
    w = _once(texts.select(key, words(F.col(text)).alias("_w")), "w", F.col("_w")).filter(F.size("w") > 0)
    starts = window_starts(F.size("w"), size, count, strategy)
    rows = w.withColumn("_s", starts).select(key, "w", F.size("_s").alias("n"), F.posexplode("_s").alias("i", "start"))
    part = F.slice("w", (F.col("start") + 1).cast("int"), F.lit(size))
    return rows.select(key, F.format_string("W%04d", F.col("i") + 1).alias("section_id"), F.concat((F.col("i") + 1).cast("string"), F.lit("/"), F.col("n").cast("string")).alias("passage_index"), "start", F.array_join(part, " ").alias("text"), F.size(part).alias("n_words"))


def head_mid_tail(texts: DataFrame, key: str, text: str, opening: int = 2000, middle: int = 1000, closing: int = 2000) -> DataFrame:
    """(key, opening, middle, closing); a short text is all opening."""
    w = _once(texts.select(key, words(F.col(text)).alias("_w")), "w", F.col("_w"))
    n = F.size("w")
    short = n < opening + middle
    start = F.greatest(F.lit(opening), (F.floor(n / 2) - middle // 2).cast("int"))
    join = lambda c: F.array_join(c, " ")
    return w.select(
        key, F.when(short, join(F.col("w"))).otherwise(join(F.slice("w", 1, opening))).alias("opening"), F.when(short, F.lit("")).otherwise(join(F.slice("w", start + 1, F.lit(middle)))).alias("middle"),
        F.when(short, F.lit("")).otherwise(join(F.slice("w", F.greatest(F.lit(1), n - closing + 1), F.lit(closing)))).alias("closing"),
    )


def chapters(sections: DataFrame, key: str, order: str, title: str, text: str, least: int = 200, most: int = 3000, limit: int | None = None) -> DataFrame:
    """(key, section_id, passage_index, title, text, n_words): chapters of readable length.

    Empty sections and front or back matter are left out; texts with fewer than three sections give none;
    a section is joined to the following ones until it has `least` words; one of more than `most` words is
    divided into equal windows, the last of which takes the rest; with `limit` an even sample is kept.
    """
    kept = sections.filter((F.trim(F.col(text)) != "") & ~is_paratext(F.col(title))).select(
        F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.nullif(F.col(title), F.lit("")), F.col(order).cast("string")).alias("t"), F.trim(F.col(text)).alias("x"), F.size(words(F.col(text))).cast("bigint").alias("n")
    )
    per = kept.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("o", "t", "x", "n"))).alias("s")).filter(F.size("s") >= 3)
    # the lengths alone decide which section starts a new chapter, so the fold carries numbers, not texts
    state = F.struct(F.lit(0).cast("bigint").alias("words"), F.array().cast("array<boolean>").alias("starts"))
    folded = F.aggregate(F.col("s"), state, lambda a, x: F.struct(
        F.when((F.size(a["starts"]) == 0) | (a["words"] >= least), x["n"]).otherwise(a["words"] + x["n"]).alias("words"),
        F.concat(a["starts"], F.array((F.size(a["starts"]) == 0) | (a["words"] >= least))).alias("starts"),
    ), lambda a: a["starts"])
    flat = per.withColumn("starts", folded).select("k", F.inline(F.arrays_zip("s", "starts"))).select("k", "s.*", "starts")
    seen = Window.partitionBy("k").orderBy("o")
    merged = flat.withColumn("g", F.sum(F.col("starts").cast("int")).over(seen)).groupBy("k", "g").agg(F.array_sort(F.collect_list(F.struct("o", "t", "x"))).alias("s"))
    merged = merged.select("k", "g", F.col("s")[0]["o"].cast("string").alias("sid"), F.array_join(F.col("s.t"), " / ").alias("t"), F.array_join(F.col("s.x"), "\n\n").alias("x"))
    split = _once(merged, "w", words(F.col("x"))).withColumn("n", F.size("w"))
    parts = F.when(F.col("n") <= most, 1).otherwise(F.ceil(F.col("n") / most).cast("int"))
    rows = split.withColumn("parts", parts).select("*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("p"))
    size = F.floor(F.col("n") / F.col("parts")).cast("int")
    begin = (F.col("p") - 1) * size
    length = F.when(F.col("p") == F.col("parts"), F.col("n") - begin).otherwise(size)
    whole = F.col("parts") == 1
    out = rows.select(
        "k", "g", "p", F.when(whole, F.col("sid")).otherwise(F.concat("sid", F.lit("."), F.col("p").cast("string"))).alias("section_id"),
        F.when(whole, F.col("t")).otherwise(F.concat("t", F.lit(" (part "), F.col("p").cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit(")"))).alias("title"),
        F.when(whole, F.col("x")).otherwise(F.array_join(F.slice("w", begin + 1, length), " ")).alias("text"), length.alias("n_words"),
    )
    place = Window.partitionBy("k")
    out = out.withColumn("i", F.row_number().over(place.orderBy("g", "p")) - 1).withColumn("total", F.count(F.lit(1)).over(place))
    if limit:
        out = out.filter((F.col("total") <= limit) | F.array_contains(even_places(F.col("total"), limit), F.col("i")))
        out = out.withColumn("i", F.row_number().over(place.orderBy("g", "p")) - 1).withColumn("total", F.count(F.lit(1)).over(place))
    return out.select(F.col("k").alias(key), "section_id", F.concat((F.col("i") + 1).cast("string"), F.lit("/"), F.col("total").cast("string")).alias("passage_index"), "title", "text", "n_words")


def even_places(total: Column, count: int) -> Column:
    """`count` places from 0 to total - 1, evenly spaced, both ends among them."""
    if count == 1:
        return F.array(F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (total - 1) / (count - 1)).cast("int"))


def even_sample(rows: DataFrame, key: str, order: list[str], count: int) -> DataFrame:
    """Up to `count` rows of each key, evenly spaced in order, first and last among them."""
    w = Window.partitionBy(key)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.filter((F.col("_n") <= count) | F.array_contains(even_places(F.col("_n"), count), F.col("_i"))).drop("_i", "_n")


def stratified_sample(rows: DataFrame, label: str, key: list[str], total: int, labels: int, seed: str = "0") -> DataFrame:
    """About total / labels rows of each label in a seeded order that is the same in every engine (md5 of seed and key)."""
    order = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(order, *key)))
    return ranked.filter(F.col("_r") <= max(1, total // max(1, labels))).drop("_r")


def html_chunks(pages: DataFrame, key: str, html: str, heading: str = "h2", item: str = "p", most: int = 20) -> DataFrame:
    """(key, section, chunk, heading, text): at most `most` items under their heading, which each chunk repeats; what has no heading passes through."""
    parts = F.split(F.coalesce(F.col(html), F.lit("")), rf"(?i)(?=<{heading}[ >])")
    sections = pages.select(F.col(key).alias("k"), F.posexplode(parts).alias("section", "body")).filter(F.trim("body") != "")
    head = F.regexp_extract("body", rf"(?is)^(<{heading}[ >].*?</{heading}>)", 1)
    sections = sections.withColumn("heading", head).withColumn("rest", F.substr("body", F.length("heading") + 1))
    items = F.filter(F.split("rest", rf"(?i)(?=<{item}[ >])"), lambda x: F.trim(x) != "")
    rows = sections.withColumn("items", items)
    chunked = rows.select("k", "section", "heading", "items", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("items") - 1) / most).cast("int")))).alias("chunk"))
    body = F.array_join(F.slice("items", F.col("chunk") * most + 1, F.lit(most)), "")
    return chunked.select(F.col("k").alias(key), "section", "chunk", "heading", F.concat("heading", body).alias("text"))


def mention_windows(tokens: DataFrame, mentions: DataFrame, doc: str, token: str, word: str, entity: str, start: str, window: int = 125, most: int = 3) -> DataFrame:
    """(doc, entity, start, text): up to `most` windows of +-`window` tokens around mentions, no two starts nearer than two windows.

    mentions: (doc, entity, start, rank), of which the lowest rank that has mentions is used (a name
    before a pronoun). The choice is a fold over each entity's sorted mentions; the text comes from an
    equi-join on token blocks, not from a range join.
    """
    best = mentions.withColumn("_m", F.min("rank").over(Window.partitionBy(doc, entity))).filter("rank = _m")
    starts = best.groupBy(doc, entity).agg(F.array_sort(F.collect_set(start)).alias("s"))
    state = F.struct(F.lit(-1).cast("bigint").alias("end"), F.array().cast("array<bigint>").alias("out"))
    chosen = F.aggregate(F.col("s"), state, lambda a, x: F.when((x.cast("bigint") < a["end"] + window) | (F.size(a["out"]) >= most), a).otherwise(F.struct((x.cast("bigint") + window).alias("end"), F.concat(a["out"], F.array(x.cast("bigint"))).alias("out"))), lambda a: a["out"])
    picked = starts.select(doc, entity, F.explode(chosen).alias("start"))
    block = picked.select(doc, entity, "start", F.explode(F.sequence(F.floor((F.col("start") - window) / window), F.floor((F.col("start") + window) / window))).alias("_b"))
    located = tokens.select(doc, F.col(token).alias("_t"), F.col(word).alias("_w"), F.floor(F.col(token) / window).alias("_b"))
    joined = block.join(located, [doc, "_b"]).filter(F.abs(F.col("_t") - F.col("start")) <= window)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_w"))), lambda x: x["_w"]), " ")
    return joined.groupBy(doc, entity, "start").agg(text.alias("text"))


def roster(clusters: DataFrame, doc: str, entity: str, name: str, count: str, least: int = 10, most: int = 50) -> DataFrame:
    """The most mentioned entities of each document as one line each: rank, name, mentions."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc(count), entity))
    kept = clusters.filter((F.col(count) >= least) & (F.col(entity) != 0)).withColumn("rank", rank).filter(F.col("rank") <= most)
    return kept.select(doc, entity, "rank", F.format_string("%s (%d mentions)", F.col(name), F.col(count)).alias("line"))


def descriptors(words_of: DataFrame, entity: list[str], role: str, word: str, most: int = 15) -> DataFrame:
    """The most frequent words of each role of an entity; ties by word."""
    counted = words_of.groupBy(*entity, role, word).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*entity, role).orderBy(F.desc("n"), word))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= most)


def passage_prompt(text: Column, title: Column, author: Column, year: Column, index: Column, chapter: Column | None = None) -> Column:
    """Header lines for what is known, then the passage."""
    line = lambda label, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(label + ": "), c.cast("string")))
    lines = [line("Title", title), line("Author", last_name(author)), line("Year", year), line("Passage", index)]
    if chapter is not None:
        lines.append(line("Chapter", chapter))
    head = F.concat_ws("\n", *lines)
    return F.concat(F.when(head != "", F.concat(head, F.lit("\n\n"))).otherwise(""), F.lit("PASSAGE:\n"), text)


def chunk_prompts(passages: DataFrame, key: str, order: str, text: str, n_words: str, size: int = 10) -> DataFrame:
    """(key, chunk, first, last, prompt): passages in chunks of `size`, each under a line with its number and length."""
    ranked = passages.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).withColumn("chunk", F.floor(F.col("_i") / size).cast("int"))
    line = F.concat(F.format_string("--- P%03d (%d words) ---\n", F.col("_i"), F.col(n_words)), F.col(text))
    listed = F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), line.alias("l"))))
    return ranked.groupBy(key, "chunk").agg(F.min("_i").alias("first"), F.max("_i").alias("last"), F.array_join(F.transform(listed, lambda x: x["l"]), "\n\n").alias("prompt"))


def parse_triples(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, s, p, o, ctx) of lines like '(s, p, o)' or '(s, p, o, ctx)'; other lines are skipped."""
    pattern = r"^\s*\(([^,()]+),\s*([^,()]+),\s*([^,()]+?)(?:,\s*([^()]+?))?\)\s*$"
    rows = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "l")).filter(F.col("l").rlike(pattern))
    return rows.select(key, "line", *[F.trim(F.regexp_extract("l", pattern, i)).alias(n) for i, n in enumerate(("s", "p", "o"), 1)], F.nullif(F.trim(F.regexp_extract("l", pattern, 4)), F.lit("")).alias("ctx"))


def parse_sections(text: Column, names: Sequence[str] = ("TIER 1", "TIER 2", "SUMMARY")) -> dict[str, Column]:
    """The parts of an output under its section headings, without the headings; empty where one is missing."""
    stop = "|".join(names)
    return {n: F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?s)(?:^|\n)[#*\s]*{n}[^\n]*\n(.*?)(?=\n[#*\s]*(?:{stop})|$)", 1)) for n in names}


def tail_lines(lines: Column, most: int) -> Column:
    """The last lines of a list, under a line that says how many were left out."""
    n = F.size(lines)
    return F.when(n <= most, lines).otherwise(F.concat(F.array(F.format_string("... %d earlier lines omitted", n - most)), F.slice(lines, -most, most)))


def next_id(ids: Column) -> Column:
    """One more than the highest number among ids like C07."""
    return F.coalesce(F.array_max(F.transform(ids, lambda x: F.regexp_extract(x, r"^C(\d+)$", 1).try_cast("int"))), F.lit(0)) + 1


def meta_prompt(title: Column, author: Column, year: Column, subject: Column, form: Column, extra: Column | None = None) -> Column:
    """A text described by its metadata, one line for each value that is there; the year as the half century it falls in."""
    from folioscope.functions.text import half_century

    def line(name: str, c: Column) -> Column:
        v = F.trim(c.cast("string"))
        return F.when(v != "", F.concat(F.lit(f"{name}: "), v))

    lines = [line("Title", title), line("Author", author), line("Printed", half_century(year)), line("Subjects", subject), line("Form", form)]
    return F.concat_ws("\n", *lines, *([line("Note", extra)] if extra is not None else []))


def word_prompt(word: Column, part_of_speech: Column) -> Column:
    """A word with its part of speech in brackets, where it has one."""
    return F.when(F.coalesce(F.trim(part_of_speech), F.lit("")) == "", word).otherwise(F.concat(word, F.lit(" ["), F.trim(part_of_speech), F.lit("]")))


def introductions(characters: DataFrame, passages: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, id, name, prompt): each named character of a text with its first passages that name it, in reading order.

    characters: (key, id, name); passages: (key, seq, text, id) for each mention of a character.
    """
    from folioscope.functions.text import is_named

    named = characters.filter(is_named(F.lit("character"), F.col("name"))).select(key, "id", "name").distinct()
    place = F.row_number().over(Window.partitionBy(key, "id").orderBy("seq"))
    first = passages.select(key, "id", "seq", "text").distinct().withColumn("_n", place).filter(F.col("_n") <= most)
    told = first.groupBy(key, "id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_p"))
    body = F.array_join(F.transform("_p", lambda p: F.concat(F.lit("("), p["seq"].cast("string"), F.lit(") "), p["text"])), "\n")
    return named.join(told, [key, "id"]).select(key, "id", "name", F.concat(F.lit("Who is "), "name", F.lit("?\n"), body).alias("prompt"))
