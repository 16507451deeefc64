"""Texts that were cut off, found by how rarely their last words end anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.runtime import Workspace

#: What a cut may leave behind: a broken character, entity, tag or escape, a hyphen, an ellipsis added by the exporter.
RESIDUE = r"(?:�+|&[#\p{L}\p{N}]{0,8}|<[^<>]{0,40}|\\[a-z0-9]{0,5}|%[0-9A-Fa-f]?|(?<=[\p{L}\p{N}])[-­]|\s*\.\.\.)$"
#: Residues that no writer leaves: they prove a cut by themselves.
BROKEN = r"^(?:�+|&(?:#\d*|[a-z]{2,8})?|\\u[0-9a-f]{0,4})$"
#: As many other places, mostly ends, make a last capitalised word after its two predecessors a customary closing,
#: if they are also this share of the texts: pieces that cuts leave grow in number with the texts, as closings do.
CLOSING, CLOSINGS = 4, 0.0003
TOKEN = r"[\p{L}\p{N}]++(?:['’][\p{L}\p{N}]++)*+|\n[ \t]*\n\s*|\n|\.\.\.|[^\s\p{L}\p{N}\"“”«»‘„]"
#: Places for which the estimate from one token less counts in the estimate from three or two tokens.
WEIGHT = 15
#: Bits of the filter through which the places of all texts pass; it is broadcast, and never larger than this.
FILTER_BITS = 23
#: Share of ends from which a sequence counts as one that ends something.
ENDS = 0.02
#: Share of full stops after a sequence from which a sentence may end there: its writer may have left out the stop.
STOPS = 0.15
#: Places from which a capitalised last word counts as known, and not as a piece of one.
KNOWN = 20
#: The same for one word anywhere, followed by an end or a mark, before an added ellipsis.
PAUSES = 0.005


def _rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(" \t\n\r\f\v\u00a0\u200b"))


def _words(text: Column) -> Column:
    """Number of words, as one more than the blanks, line ends and paragraph ends between them."""
    return F.size(F.split(text, " ")) + F.size(F.split(F.replace(text, F.lit("\n\n"), F.lit("\n")), "\n")) - 1


def _shape(x: Column) -> Column:
    """Class of a token: words in capitals, capitalised words and numbers are classes, other tokens stand for themselves."""
    code = F.ascii(x)
    upper = code.between(65, 90) | code.between(192, 222)
    capitals = (F.length(x) > 1) & (F.upper(x) == x)
    return (
        F.when(code.between(97, 122), x)
        .when(upper, F.when(capitals, "XX").otherwise("Xx"))
        .when(code.between(48, 57), "9")
        .when(code == 10, F.when(F.length(x) > 1, "¶¶").otherwise("¶"))
        .otherwise(x)
    )


def _layout(text: Column) -> Column:
    """1 for lined text (verse, headings), else 0.

    Lined text has line ends but neither paragraphs nor speakers in capitals before a full stop, or is
    one line without any mark that ends a sentence, but for a leading numeral.
    """
    lines = text.contains("\n") & ~text.contains("\n\n") & ~text.rlike(r"(?:^|\n)\p{Lu}{4,}\.")
    return F.when(lines | (~text.contains("\n") & ~text.rlike(r"[\p{Ll}\p{N}\"”»)\]] ?[.!?]")), 1).otherwise(0)


def _keys(layout: Column, a: Column, b: Column, c: Column) -> list[Column]:
    """Hashes of the last three, two and one tokens within their layout."""
    return [F.xxhash64(layout, a, b, c), F.xxhash64(layout, b, c), F.xxhash64(layout, c)]


def _closing(a: Column, b: Column, c: Column, word: Column) -> Column:
    """Hash of a trigram whose last word stands for itself rather than for its class; null where that is the same."""
    return F.when(word != c, F.xxhash64(F.lit("itself"), a, b, word))


def _itself(c: Column, word: Column) -> Column:
    """Hash of a word that stands for a class, for itself; null for other tokens."""
    return F.when(word != c, F.xxhash64(F.lit("word"), word))


def _sequences(texts: DataFrame, text: str) -> DataFrame:
    """One row per token w with its class c, those of the two before it (a, b) and of the one after it (d): '$' at the end, '^' before the start."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))
    # generators keep the optimizer from computing the tokens anew for each of their uses
    rows = texts.select(_layout(F.col(text)).alias("layout"), F.explode(F.array(tokens)).alias("t"))
    pad = F.concat(F.array(F.lit("^"), F.lit("^")), "t", F.array(F.lit("$")))
    rows = rows.select("layout", F.size("t").alias("n"), F.explode(F.array(pad)).alias("p"))
    zipped = F.arrays_zip(*[F.slice("p", F.lit(i + 1), F.col("n")).alias(x) for i, x in enumerate("abwd")])
    # classes are found after the tokens are rows, where generated code does it
    flat = rows.select("layout", F.inline(zipped)).toDF("layout", "a", "b", "w", "d")
    return flat.select("layout", *[_shape(F.col(x)).alias("c" if x == "w" else x) for x in "abwd"], "w")


def last_words(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One row per text with letters: its last tokens after the residue of a cut, their keys, and what the residue was."""
    # ten runs between blanks hold the last three tokens and any residue; where there are fewer, this is the whole text.
    # They are cut from the last 64 runs, since trimming a long text costs its length, but from all of it where those are blanks.
    near = F.substring_index(F.col(text), " ", -64)
    trimmed = _rstrip(near)
    enough = (F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) >= 10) | (near == F.col(text))
    body = F.substring_index(F.when(enough, trimmed).otherwise(_rstrip(F.col(text))), " ", -10)
    frame = documents.filter(F.col(text).rlike(r"\p{L}")).select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.array(F.length(text), F.octet_length(text), _words(F.col(text))).alias("measures"),
        _layout(F.col(text)).alias("layout"), F.explode(F.array(body)).alias("body"),
    )
    residue = F.coalesce(F.nullif(F.regexp_extract("body", RESIDUE, 0), F.lit("")), F.lit(""))
    frame = frame.select("key", "source", "measures", "layout", F.xxhash64("body").alias("tail"), residue.alias("residue"), F.explode(F.array(_rstrip(F.regexp_replace("body", RESIDUE, "")))).alias("bare"))
    kept = ["key", "source", "measures", "layout", "tail", "residue"]
    frame = frame.select(*kept, F.explode(F.array(F.regexp_extract_all(F.col("bare"), F.lit(TOKEN), F.lit(0)))).alias("w"))
    frame = frame.select(*kept, "w", F.explode(F.array(F.transform(F.slice("w", F.greatest(F.lit(1), F.size("w") - 2), F.lit(3)), _shape))).alias("t"))
    raw = F.try_element_at("w", F.lit(-1))
    at = lambda i: F.coalesce(F.try_element_at("t", F.lit(-i)), F.lit("^"))
    last = F.explode(F.array(F.struct(raw.alias("word"), at(3).alias("a"), at(2).alias("b"), at(1).alias("c")))).alias("x")
    out = frame.select("key", "source", "measures", "layout", "tail", F.trim("residue").alias("residue"), last).select("key", "source", "measures", "layout", "tail", "residue", "x.*")
    k3, k2, k1 = _keys(F.col("layout"), F.col("a"), F.col("b"), F.col("c"))
    return out.select("key", "source", "measures", "layout", "tail", "residue", "word", "c", k3.alias("k3"), k2.alias("k2"), k1.alias("k1"), F.xxhash64(1 - F.col("layout"), "c").alias("kx"), _closing(F.col("a"), F.col("b"), F.col("c"), F.col("word")).alias("k4"), _itself(F.col("c"), F.col("word")).alias("k5"))


def _passing(keyed: DataFrame, wanted: DataFrame, space: Workspace) -> DataFrame:
    """The rows of `keyed` whose key k may be wanted: those that set a bit of a filter of 2 to the FILTER_BITS bits.

    The filter only spares work; what it lets through by mistake is dropped when the counts are joined.
    """
    place = F.col("k").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    bits = space.keep(wanted.select(word.alias("word"), F.expr("shiftleft(1L, cast(k & 63 AS int))").alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits")))
    return keyed.withColumn("word", word).join(F.broadcast(bits), "word").filter(F.getbit("bits", bit) == 1).drop("word", "bits")


SLOTS = {"3": "k3", "2": "k2", "1": "k1", "x": "kx", "4": "k4", "5": "k5"}


def _counts(documents: DataFrame, text: str, ends: DataFrame, space: Workspace) -> DataFrame:
    """One row per distinct combination of keys of `ends` (type), with a struct of counts c3, c2, c1, cx, c4, c5 for each.

    Places are added up by key before anything is shuffled, whatever the number of keys, so neither
    a common word nor the number of texts makes a large partition or broadcast.
    """
    types = space.keep(ends.select("type", "layout", F.col("c").rlike(r"^[\p{Ll}’']+$").alias("plain"), *SLOTS.values()).dropDuplicates(["type"]))
    asked = types.select("type", F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.col(k).alias("k")) for i, k in SLOTS.items()])).alias("s")).select("type", "s.*").filter("k IS NOT NULL")
    places = _sequences(documents.filter(F.col(text).isNotNull()).select(text), text)
    over = F.col("d").isin("$", "¶", "¶¶")
    mark, stop = F.col("d").isin(",", ";", ":", "…", "—", ")", "]"), F.col("d").isin(".", "!", "?")
    keys = F.array(*_keys(F.col("layout"), F.col("a"), F.col("b"), F.col("c")), _closing(F.col("a"), F.col("b"), F.col("c"), F.col("w")), _itself(F.col("c"), F.col("w")))
    follows = F.when(over, F.when(F.col("d") == "$", 4).otherwise(3)).when(stop, 2).when(mark, 1).when(F.col("d").isin("\ufffd", "-", "...", "&", "<"), -1).otherwise(0)
    keyed = _passing(places.select(F.explode(keys).alias("k"), follows.alias("next")), asked.select("k"), space)
    counted = keyed.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("next") >= 3).alias("over"), F.count_if(F.col("next").isin(4, -1)).alias("last"), F.count_if(F.col("next") >= 1).alias("paused"), F.count_if(F.col("next") == 2).alias("stopped")
    )
    found = asked.join(counted.hint("merge"), "k").select("type", "slot", F.struct("n", "over", "last", "paused", "stopped").alias("s"))
    wide = found.groupBy("type").agg(*[F.max(F.when(F.col("slot") == i, F.col("s"))).alias(f"c{i}") for i in SLOTS])
    return space.keep(types.select("type", "layout", "plain", "k1").join(wide.hint("merge"), "type", "left"))


def judge(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, cut, rule, chance): as `cut_off`, with the rule that decided and the estimated chance that a text or line ends there.

    Rules: trigram (the smoothed estimate), piece (of a word that nothing goes on from), residue (what no
    writer leaves), field (an added ellipsis at a field limit), pause (an added ellipsis after a word that
    no pause follows); null for texts that aren't cut.
    """
    space = Workspace(documents.sparkSession, "truncation")
    ends = last_words(documents, key, text, source)
    ends = space.keep(ends.withColumn("type", F.xxhash64("layout", "word", "c", *SLOTS.values())))
    counts = _counts(documents, text, ends, space)
    # chance of an end after any word, by layout, from the words that end some text
    plain = counts.filter("plain AND c1 IS NOT NULL").select("layout", "k1", "c1").dropDuplicates(["layout", "k1"])
    rates = {r.layout: r.rate for r in plain.groupBy("layout").agg((F.sum(F.greatest(F.col("c1.over") - F.col("c1.last"), F.lit(0))) / F.sum(F.col("c1.n") - F.col("c1.last"))).alias("rate")).collect()}  # two rows
    base = F.when(F.col("layout") == 1, F.lit(float(rates.get(1) or 0.0))).otherwise(F.lit(float(rates.get(0) or 0.0)))
    joined = ends.join(counts.drop("layout", "plain", "k1").hint("merge"), "type", "left")
    joined = joined.join(ends.groupBy("tail").agg(F.count(F.lit(1)).alias("copies")).hint("merge"), "tail")
    # neither the place of the text itself nor that of a copy of it is evidence; after taking off a residue it wasn't counted as an end
    own = F.when(F.col("residue") == "", 1).otherwise(0)
    n = {i: F.coalesce(F.col(f"c{i}.n"), F.lit(0)) for i in SLOTS}
    over_ = {i: F.coalesce(F.col(f"c{i}.over"), F.lit(0)) for i in SLOTS}
    last = {i: F.coalesce(F.col(f"c{i}.last"), F.lit(0)) for i in SLOTS}
    word = F.col("word").rlike(r"^[\p{Ll}’']+$")
    chance, stops = base, F.lit(0.0)
    for i in "12":  # a last word may be a cut piece wherever it ends a text: of words only what stands within texts counts
        out = F.when(word, last[i]).otherwise(own)
        within = F.greatest(n[i] - out, F.lit(0))
        chance = (F.greatest(over_[i] - out, F.lit(0)) + WEIGHT * chance) / (within + WEIGHT)
        stops = (F.coalesce(F.col(f"c{i}.stopped"), F.lit(0)) + WEIGHT * stops) / (within + WEIGHT)
    others = F.greatest(n["3"] - F.col("copies"), F.lit(0))
    chance = (F.greatest(over_["3"] - own * F.col("copies"), F.lit(0)) + WEIGHT * chance) / (others + WEIGHT)
    stops = (F.coalesce(F.col("c3.stopped"), F.lit(0)) + WEIGHT * stops) / (others + WEIGHT)
    total = ends.count()
    docs = F.lit(total)
    closing = (n["4"] - own >= F.greatest(F.lit(CLOSING), F.lit(CLOSINGS) * docs)) & ((over_["4"] - own) * 2 >= n["4"] - own)
    everywhere = n["1"] + n["x"]
    stray = last["1"] + last["x"]
    # a real word that only ever ends texts is common and keeps its company, a piece of a word does not
    kept = (n["2"] >= 0.6 * n["1"]) & (stray > 2 + F.lit(0.001) * docs)
    piece = word & (everywhere - stray <= 0.05 * everywhere) & ~kept
    paused = F.coalesce(F.col("c1.paused"), F.lit(0)) + F.coalesce(F.col("cx.paused"), F.lit(0))
    held = (paused / F.greatest(everywhere, F.lit(1)) < PAUSES) & word
    # a field limit is a length in characters, bytes or words at which the texts of a source pile up
    sized = ends.select("source", F.posexplode("measures").alias("measure", "size"))
    lengths = sized.groupBy("source", "measure", "size").agg(F.count(F.lit(1)).alias("same"))
    near = Window.partitionBy("source", "measure").orderBy("size").rangeBetween(-50, 50)
    piles = lengths.withColumn("around", F.sum("same").over(near)).filter((F.col("same") >= 4) & (F.col("same") * 4 >= F.col("around")))
    limits = piles.groupBy(F.col("source").alias("_s")).agg(F.collect_set(F.struct("measure", "size")).alias("limits"))
    judged = joined.withColumns({"_chance": chance, "_stops": stops}).join(limits, F.col("source").eqNullSafe(F.col("_s")), "left")
    reached = F.filter(F.array(*[F.struct(F.lit(i).alias("measure"), F.col("measures")[i].alias("size")) for i in range(3)]), lambda m: F.array_contains("limits", m))
    judged = judged.withColumn("limit", F.coalesce(F.size(reached) > 0, F.lit(False)))
    dots = F.col("residue") == "..."
    broken = F.lower("residue").rlike(BROKEN)
    # where sentences often stop, the writer may have left out the stop - unless the text fills its field
    whole = word | (F.coalesce(F.col("c5.n"), F.lit(0)) >= KNOWN)
    unstopped = (F.col("residue") == "") & (F.col("_stops") >= STOPS) & whole & ~F.col("limit")
    rule = (
        F.when(broken, "residue")
        .when(dots, F.when(F.col("limit"), "field").when(piece, "piece").when(held, "pause"))
        .when((F.col("_chance") < ENDS) & ~closing & ~unstopped, "trigram")
        .when(piece, "piece")
    )
    return judged.select(F.col("key").alias(key), "source", rule.alias("rule"), F.col("_chance").alias("chance")).select(key, "source", F.col("rule").isNotNull().alias("cut"), "rule", "chance")


def cut_off(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, cut) for every document whose text has a letter, in SQL alone.

    The last three tokens of each text (words, marks and line ends; names, words in capitals and numbers
    as classes; whatever a cut left behind taken off) are looked up among all places of all texts: how
    often they stand inside a line or sentence, and how often at the end of a line or text. A text whose
    last trigram is frequent inside but almost never at an end is cut off. The chance of an end after a
    trigram is smoothed by that after its last two tokens, that by the one after its last, and that by
    the one after any word of its layout: one estimate, however rare the trigram. In lined text, where
    any word may end a line, a word that occurs nowhere but at ends of texts, in ever other company, is a
    piece of a word. A capitalised last word counts for itself where it closes a share of the texts
    (a printer's closing). Lined and running text are counted apart. Places are added up by key before
    they are shuffled. An ellipsis that an exporter adds after its cut is told
    from a writer's by the field limit of the source: a length at which texts of one source pile up. A
    text that ends where sentences often stop, but without the stop, is taken for its writer's, unless it
    fills such a field. `judge` gives the rule that decided.

    Defined cases: null, empty and blank texts and texts without letters get no row; repeated rows are
    judged alike and kept; a null source is a source of its own; very short texts are judged by the
    tokens they have; other columns are ignored; an empty table gives an empty one.
    """
    return judge(documents, key, text, source).select(key, "source", "cut")
