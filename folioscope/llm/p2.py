"""Problem 2: consolidating pairwise matches into groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.values import name_key
from folioscope.llm.groups import boruvka
from folioscope.runtime import read


def character_number(c: Column) -> Column:
    """The number of a character id such as C07, null of anything malformed."""
    return F.regexp_extract(F.nullif(F.trim(c), F.lit("")), r"^[Cc][\s_.\-]*0*(\d{1,18})$", 1).try_cast("bigint")


def same_as_groups(relations: DataFrame, characters: DataFrame) -> DataFrame:
    """(_id, member, root) for every character of every work, whether of the register or of a link only.

    Defined cases: ids that are null or malformed link nothing; type spellings that differ in case,
    blanks or joining marks are one type, and look-alike types (not_same_as, same_name_as) are others;
    a character without links is its own root. Other columns are ignored.
    """
    links = relations.filter(name_key(F.col("type")) == "sameas").select(
        F.struct("_id", character_number(F.col("a")).alias("n")).alias("u"), F.struct("_id", character_number(F.col("b")).alias("n")).alias("v")
    )
    links = links.filter(F.col("u._id").isNotNull() & F.col("u.n").isNotNull() & F.col("v.n").isNotNull())
    grouped = boruvka(links, "u", "v", "same-as").select(F.col("member._id").alias("_id"), F.col("member.n").alias("member"), F.col("root.n").alias("root"))
    known = characters.select("_id", character_number(F.col("id")).alias("member")).filter("_id IS NOT NULL AND member IS NOT NULL")
    everyone = known.unionByName(grouped.select("_id", "member")).distinct()
    return everyone.join(grouped, ["_id", "member"], "left").select("_id", "member", F.coalesce("root", "member").alias("root"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return same_as_groups(read(spark, d, "relations"), read(spark, d, "new_characters"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_groups(spark, d).filter("root < member").select("_id", "root", "member")


_LINKS = r"""
links AS (SELECT DISTINCT _id, a, b FROM (
  SELECT _id, TRY_CAST(regexp_extract(trim(a), '^[Cc][\s_.\-]*0*(\d{1,18})$', 1) AS BIGINT) AS a,
              TRY_CAST(regexp_extract(trim(b), '^[Cc][\s_.\-]*0*(\d{1,18})$', 1) AS BIGINT) AS b
  FROM relations WHERE regexp_replace(lower(type), '[^\p{L}\p{N}]+', '', 'g') = 'sameas')
  WHERE _id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
ways AS (SELECT _id, a, b FROM links UNION SELECT _id, b, a FROM links),
reach AS (SELECT _id, a AS member, a AS root FROM ways
  UNION SELECT r._id, w.b, r.root FROM reach r JOIN ways w ON w._id = r._id AND w.a = r.member),
grouped AS (SELECT _id, member, min(root) AS root FROM reach GROUP BY ALL)
"""
FOUND_SQL = f"WITH RECURSIVE {_LINKS} SELECT _id, root, member FROM grouped WHERE root < member"
GROUPS_SQL = rf"""WITH RECURSIVE {_LINKS},
known AS (SELECT _id, TRY_CAST(regexp_extract(trim(id), '^[Cc][\s_.\-]*0*(\d{{1,18}})$', 1) AS BIGINT) AS member FROM new_characters)
SELECT _id, member, coalesce(root, member) AS root
FROM (SELECT _id, member FROM known WHERE _id IS NOT NULL AND member IS NOT NULL UNION SELECT _id, member FROM grouped) LEFT JOIN grouped USING (_id, member)"""
QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
ORACLES = {"p2_found": FOUND_SQL, "p2_groups": GROUPS_SQL}
