"""Readers: passages, manifests, graph results, cluster files, name lists, images and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import slug_to_id
from folioscope.operators.segment import fixed_windows, words

GRAPH = """characters array<struct<id:string,name:string,gender:string,`class`:string,notes:string,aliases:array<string>,intro_text:string,descriptions:array<string>>>,
relations array<struct<a:string,b:string,type:string,passage:string,detail:string>>, events array<struct<who:string,what:string,whom:string,`where`:string,passage:string,detail:string>>,
dialogue array<struct<speaker:string,addressee:string,passage:string,gist:string>>, summaries array<struct<start:int,`end`:int,text:string>>,
metadata struct<source:string,model:string,schema_version:string,n_passages:int,n_chunks:int,chunk_size:int,elapsed_seconds:double>"""
# fixed values: file endings of images
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}


def passages_from_text(spark: SparkSession, path: str, size: int = 500) -> DataFrame:
    """(path, seq, text, n_words) of whole text files, in windows of `size` words."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return fixed_windows(whole, "path", "text", size)


def passages_from_list(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """(seq, text, n_words) of texts in memory."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq bigint, text string")
    return rows.withColumn("n_words", F.size(words(F.col("text"))))


def passages_from_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, _id, seq, text, n_words) of JSON lines files. The first line may be a header with _id; without one the id comes from the file name. Blank lines are skipped.

    A record with `_id` and no `seq` is the header, so no order of lines is needed to tell it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value")).filter(F.trim("value") != "")
    rows = lines.select("path", F.from_json("value", "_id string, _n_passages int, seq bigint, text string, n_words int").alias("r")).select("path", "r.*")
    heads = rows.filter("_id IS NOT NULL AND seq IS NULL").groupBy("path").agg(F.min("_id").alias("_h"))
    slug = F.regexp_extract("path", r"([^/]+?)(?:\.[^/.]+)*$", 1)
    body = rows.filter("seq IS NOT NULL").join(heads, "path", "left")
    return body.select("path", F.coalesce("_h", slug_to_id(slug)).alias("_id"), "seq", "text", F.coalesce("n_words", F.size(words(F.col("text")))).alias("n_words"))


def passages_from_packed(spark: SparkSession, path: str) -> DataFrame:
    """(path, _id, seq, text, n_words) of JSON lines files of many texts, whose passages have the _id of their text; headers are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "_id string, seq bigint, text string, n_words int").alias("r"))
    return lines.select("path", "r.*").filter("seq IS NOT NULL").withColumn("n_words", F.coalesce("n_words", F.size(words(F.col("text")))))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV list of passages; _id and seq are required, other columns stay."""
    rows = spark.read.csv(path, header=True)
    missing = {"_id", "seq"} - set(rows.columns)
    if missing:
        raise ValueError(f"the manifest lacks {sorted(missing)}")
    return rows.withColumn("seq", F.col("seq").cast("bigint"))


def manifest_keys(spark: SparkSession, path: str) -> DataFrame:
    return manifest(spark, path).select("_id", "seq").distinct()


def attach(wanted: DataFrame, passages: DataFrame, key: Sequence[str] = ("_id", "seq")) -> tuple[DataFrame, DataFrame]:
    """(manifest rows with their passages, manifest rows without)."""
    extra = [c for c in passages.columns if c not in key and c not in wanted.columns]
    texts = passages.select(*key, *extra)
    return wanted.join(texts, list(key)), wanted.join(texts.select(*key), list(key), "left_anti")


def graph_results(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One row per result file that has a source and characters."""
    rows = spark.read.schema(GRAPH).option("multiLine", True).option("recursiveFileLookup", str(recursive).lower()).json(path)
    return rows.withColumn("path", F.col("_metadata.file_path")).filter("metadata.source IS NOT NULL AND size(characters) > 0")


def graph_tables(results: DataFrame) -> dict[str, DataFrame]:
    """The parts of graph results as tables keyed by graph_id; `ord` keeps the order of the document."""
    source = F.col("metadata.source").alias("graph_id")
    out = {n: results.select(source, F.posexplode(n).alias("ord", "r")).select("graph_id", "ord", "r.*") for n in ("characters", "relations", "events", "dialogue", "summaries")}
    out["story"] = out["summaries"].groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n\n").alias("story"))
    return out


def entity_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated tokens or mentions with a header; malformed lines are dropped. Without a schema every column is text, so files are read once."""
    reader = spark.read.options(sep="\t", header=True, mode="DROPMALFORMED", quote="")
    return (reader.schema(schema) if schema else reader).csv(path)


CLUSTERS = "characters array<struct<id: int, count: int, mentions: struct<proper: array<struct<n: string, c: int>>, common: array<struct<n: string, c: int>>, pronoun: array<struct<n: string, c: int>>>>>"


def cluster_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, count, name, rank): the clusters of entity files in JSON, named by their most frequent proper, else common, else pronoun mention; rank 0, 1 or 2 tells which."""
    rows = spark.read.schema(CLUSTERS).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("path"), F.explode("characters").alias("c"))
    best = lambda kind: F.get(F.array_sort(F.transform(F.coalesce(F.col(f"c.mentions.{kind}"), F.array()), lambda m: F.struct((-m["c"]).alias("n"), m["n"].alias("name")))), F.lit(0))["name"]
    names = [best(k) for k in ("proper", "common", "pronoun")]
    rank = F.when(names[0].isNotNull(), 0).when(names[1].isNotNull(), 1).otherwise(2)
    return rows.select("path", "c.id", "c.count", F.coalesce(*names).alias("name"), rank.alias("rank"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(name): third and fourth field of the lines that start with a digit and have at least five fields, in lower case."""
    fields = F.split("value", ",")
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^\d")).withColumn("f", fields).filter(F.size("f") >= 5)
    return lines.select(F.explode(F.array(F.col("f")[2], F.col("f")[3])).alias("name")).select(F.lower(F.trim("name")).alias("name")).filter("name <> ''").distinct()


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, mime); unknown endings count as png."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for p in MIME.items() for x in p])
    return spark.read.format("binaryFile").load(path).select("path", "content", F.coalesce(F.try_element_at(table, ending), F.lit("image/png")).alias("mime"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length) of PDF files; drawing their pages is left to a provider."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content", "length")


def embeddings(vectors: DataFrame, ids: DataFrame | None = None, scheme: str | None = None) -> DataFrame:
    """Vectors of the wanted texts and scheme; both filters are optional."""
    out = vectors if scheme is None else vectors.filter(F.col("scheme") == scheme)
    return out if ids is None else out.join(ids.select("_id").distinct(), "_id", "left_semi")
