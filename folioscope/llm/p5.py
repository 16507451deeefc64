"""Problem 5: splits that keep related records together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.groups import stars
from folioscope.runtime import Workspace, read, small

#: Headings that name nobody, after case and blanks.
NAMELESS = ["", "-", "?", "??", "n/a", "na", "none", "null", "nil", "anon", "anon.", "anonymous", "anonym", "anonyme", "anonimo", "anónimo", "unknown", "unbekannt", "inconnu", "desconocido", "various", "n.n.", "s.n.", "[anon]", "[anon.]", "[anonymous]"]
#: Sorts after every work id, so that the smallest member of a group is a work.
_ENTITY = "\uffff"
#: Size of the space of hashes, the bins in which the passages are counted along it, the number of hash functions tried, and what tells them apart.
SPACE, BINS, TRIES, STRIDE = 1 << 31, 4096, 16, 1640531527


def headings(author: Column) -> Column:
    """The author headings of a work: split at `;`, without outer blanks and case, those that name nobody left out."""
    parts = F.transform(F.split(F.coalesce(author, F.lit("")), ";"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"^[\s\x{A0}]+|[\s\x{A0}]+$", ""))))
    return F.array_distinct(F.filter(parts, lambda x: ~x.isin(NAMELESS) & x.rlike(r"\p{L}")))


def related(records: DataFrame, key: str, entities: Column, name: str = "related") -> DataFrame:
    """(member, root) for every record: root is the smallest key of the records that share an entity, directly or indirectly.

    Records are linked to their entities, not to one another, so an entity that a third of all records
    share costs as many links as it has records.

    Defined cases: records with a null key are left out; null or empty `entities` and a record without
    any leave it alone in its group; repeated records count once. Other columns are ignored.
    """
    keyed = records.filter(F.col(key).isNotNull())
    links = keyed.select(F.col(key).alias("u"), F.explode(entities).alias("e")).select("u", F.concat(F.lit(_ENTITY), "e").alias("v"))
    grouped = stars(links, "u", "v", name).filter(~F.col("member").startswith(_ENTITY))
    everyone = keyed.select(F.col(key).alias("member")).distinct()
    return everyone.join(grouped, "member", "left").select("member", F.coalesce("root", "member").alias("root"))


def text_groups(texts: DataFrame) -> DataFrame:
    match = F.when(F.col("match_group").isNotNull(), F.array(F.concat(F.lit("m:"), F.col("match_group").cast("string")))).otherwise(F.array().cast("array<string>"))
    entities = F.concat(F.transform(headings(F.col("author")), lambda h: F.concat(F.lit("a:"), h)), match)
    return related(texts, "_id", entities)


def assign(sizes: DataFrame, group: str, size: str, shares: list[tuple[str, float]]) -> DataFrame:
    """(group, split, size): the hash of the group identifier falls into ranges that hold the shares of all records.

    Records are counted along the space of hashes in BINS bins; each range ends at the edge of a bin where
    the records so far are nearest to its share. Every group is placed by its hash alone, a hot one too,
    so an edge can miss its share by no more than half of the bin it falls into. TRIES hash functions (an
    md5 digest times an odd number) are tried, and the one with the smallest largest deviation is taken.

    Defined cases: an empty table gives an empty one; a null group is left out; shares must be positive
    and are scaled to sum to 1.
    """
    names = [n for n, _ in shares]
    upto = np.cumsum([s for _, s in shares]) / sum(s for _, s in shares)
    place = F.shiftright(F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 8), 16, 10).cast("bigint"), 1)
    placed = sizes.filter(F.col(group).isNotNull()).select(group, size, place.alias("_at"))

    def bin_(k: Column) -> Column:
        at = (F.col("_at") * (k * F.lit(STRIDE) % F.lit(SPACE)).bitwiseOR(F.lit(1))) % F.lit(SPACE)
        return F.shiftright(at, (SPACE // BINS).bit_length() - 1).cast("int")

    tried = placed.select(F.explode(F.expr(f"sequence(0L, {TRIES - 1}L)")).alias("k"), "_at", F.col(size).alias("_n"))
    counts = np.zeros((TRIES, BINS + 1))
    for r in tried.groupBy("k", bin_(F.col("k")).alias("bin")).agg(F.sum("_n").alias("n")).collect():  # at most TRIES x BINS rows
        counts[r.k, r.bin + 1] = r.n
    before = counts.cumsum(1)
    total = before[0, -1]
    edges = np.array([[int(np.abs(before[k] - u * total).argmin()) for u in upto[:-1]] + [BINS] for k in range(TRIES)])
    reached = np.diff(np.take_along_axis(before, edges, 1), prepend=0.0, axis=1)
    errors = np.abs(reached - np.diff(upto, prepend=0.0) * total).max(1).round(6)
    best = int(errors.argmin())
    split = F.lit(names[-1])
    for n, edge in reversed(list(zip(names[:-1], edges[best][:-1].tolist()))):
        split = F.when(bin_(F.lit(best).cast("bigint")) < edge, n).otherwise(split)
    return placed.select(group, split.alias("split"), size)


def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(passages with group and split, groups with split and number of passages)"""
    space = Workspace(spark, "splits")
    groups = space.keep(text_groups(read(spark, d, "texts")).withColumnsRenamed({"member": "_id", "root": "group"}))
    passages = space.keep(read(spark, d, "passage_annotations").select("_id", "scheme", "seq").distinct())
    counted = passages.groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    sized = counted.join(groups, "_id", "left").groupBy(F.coalesce("group", "_id").alias("group")).agg(F.sum("n").alias("n"))
    shares = [(r.split_name, r.target_share) for r in read(spark, d, "split_targets").filter("target_share > 0").orderBy(F.desc("target_share"), "split_name").limit(1000).collect()]
    placed = space.keep(assign(space.keep(sized), "group", "n", shares))
    of_work = space.keep(groups.join(small(placed), "group").select("_id", "group", "split"))
    return passages.join(small(of_work), "_id", "left"), placed


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """One row per passage with its group of related works and its split."""
    return _splits(spark, d)[0].select("_id", "scheme", "seq", "group", "split")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of the distinct passages that each split reached, beside its target."""
    placed = _splits(spark, d)[1]
    reached = placed.groupBy(F.col("split").alias("split_name")).agg(F.sum("n").alias("passages"), F.count(F.lit(1)).alias("groups"))
    total = placed.agg(F.sum("n")).first()[0]
    targets = read(spark, d, "split_targets")
    return targets.join(reached, "split_name", "left").select(
        "split_name", "target_share", F.coalesce("passages", F.lit(0)).alias("passages"), F.coalesce("groups", F.lit(0)).alias("groups"), (F.coalesce("passages", F.lit(0)) / F.lit(total)).alias("reached_share")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return text_groups(read(spark, d, "texts")).filter("root < member").select(F.col("root").alias("id_first"), F.col("member").alias("id_other"))


_GROUPS = """
WITH RECURSIVE e AS (
  SELECT _id, 'a:' || h AS e FROM (SELECT _id, lower(trim(unnest(string_split(author, ';')))) AS h FROM texts)
  WHERE regexp_matches(h, '\\p{L}') AND h NOT IN ('n/a', 'na', 'none', 'null', 'nil', 'anon', 'anon.', 'anonymous', 'anonym', 'anonyme', 'anonimo', 'anónimo', 'unknown',
    'unbekannt', 'inconnu', 'desconocido', 'various', 'n.n.', 's.n.', '[anon]', '[anon.]', '[anonymous]')
  UNION SELECT _id, 'm:' || match_group FROM texts WHERE match_group IS NOT NULL),
star AS (SELECT e, min(_id) AS hub FROM e GROUP BY e),
ways AS (SELECT _id AS a, hub AS b FROM e JOIN star USING (e) UNION SELECT hub, _id FROM e JOIN star USING (e)),
reach AS (SELECT a AS member, a AS root FROM ways UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.member)
"""
FOUND_SQL = _GROUPS + """
SELECT min(root) AS id_first, member AS id_other FROM reach GROUP BY member HAVING min(root) < member
"""
_PLACED = _GROUPS + f""",
work AS (SELECT member AS _id, min(root) AS "group" FROM reach GROUP BY member),
passage AS (SELECT DISTINCT _id, scheme, seq FROM passage_annotations),
sized AS (SELECT coalesce(w."group", p._id) AS "group", count(*) AS n FROM passage p LEFT JOIN work w USING (_id) GROUP BY 1),
hashed AS (SELECT *, ('0x' || substr(md5("group"), 1, 8))::BIGINT >> 1 AS pos FROM sized),
total AS (SELECT sum(n) AS total FROM sized),
bound AS (SELECT split_name, sum(target_share) OVER w / sum(target_share) OVER () AS upto, target_share / sum(target_share) OVER () AS share, row_number() OVER w AS j, count(*) OVER () AS js
  FROM split_targets WHERE target_share > 0 WINDOW w AS (ORDER BY target_share DESC, split_name ROWS UNBOUNDED PRECEDING)),
tried AS (SELECT k, "group", n, ((pos * (((k * {STRIDE}) % {SPACE}) | 1)) % {SPACE}) // {SPACE // BINS} AS bin FROM hashed, range({TRIES}) t(k)),
bins AS (SELECT k, bin, sum(n) AS n FROM tried GROUP BY 1, 2),
edges AS (SELECT k, e, coalesce(sum(n) OVER (PARTITION BY k ORDER BY e ROWS UNBOUNDED PRECEDING), 0) AS before FROM (SELECT x.k, e, coalesce(n, 0) AS n FROM range({TRIES}) x(k), range({BINS + 1}) y(e) LEFT JOIN bins b ON b.k = x.k AND b.bin = y.e - 1)),
cuts AS (SELECT e.k, b.j, b.split_name, b.share, CASE WHEN b.j = any_value(b.js) THEN {BINS} ELSE arg_min(e.e, (abs(e.before - b.upto * t.total), e.e)) END AS edge FROM edges e, bound b, total t GROUP BY e.k, b.j, b.split_name, b.share),
ends AS (SELECT c.*, e.before FROM cuts c JOIN edges e ON e.k = c.k AND e.e = c.edge),
reached AS (SELECT k, abs(before - coalesce(lag(before) OVER (PARTITION BY k ORDER BY j), 0) - share * total) AS miss FROM ends, total),
best AS (SELECT k FROM reached GROUP BY k ORDER BY round(max(miss), 6), k LIMIT 1),
placed AS (SELECT t."group", t.n, (SELECT arg_min(split_name, j) FROM cuts c WHERE c.k = t.k AND t.bin < c.edge) AS split FROM tried t WHERE k = (SELECT k FROM best))
"""
SPLITS_SQL = _PLACED + """SELECT p._id, p.scheme, p.seq, coalesce(w."group", p._id) AS "group", s.split FROM passage p LEFT JOIN work w USING (_id) JOIN placed s ON s."group" = coalesce(w."group", p._id)"""
SHARES_SQL = _PLACED + """SELECT t.split_name, t.target_share, coalesce(sum(n), 0)::BIGINT AS passages, count(n) AS groups, coalesce(sum(n), 0) / (SELECT total FROM total) AS reached_share
FROM split_targets t LEFT JOIN placed p ON p.split = t.split_name GROUP BY 1, 2"""
QUERIES = {"p5_found": p5_found, "p5_splits": p5_splits, "p5_shares": p5_shares}
ORACLES = {"p5_found": FOUND_SQL, "p5_splits": SPLITS_SQL, "p5_shares": SHARES_SQL}
