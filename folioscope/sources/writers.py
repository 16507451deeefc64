"""Writers: results, passages per text, previews, and the move of older annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import model_slug, path_slug
from folioscope.runtime import Workspace


def results_csv(results: DataFrame, path: str, text: str = "text") -> None:
    """Result rows with the _failed flag and without the text."""
    kept = results.drop(text, "prompt", "raw")
    flat = kept.withColumns({f.name: F.to_json(f.name) for f in kept.schema.fields if f.dataType.typeName() in ("array", "struct", "map")})
    flat.write.mode("overwrite").csv(path, header=True, escape='"')


def result_name(source, model):
    """File name of a saved result, from its source and model (columns)."""
    return F.concat(path_slug(source), F.lit("."), model_slug(model), F.lit(".json"))


def results_json(results: DataFrame, path: str, source: str = "source", model: str = "model") -> None:
    """One JSON line per result; each source and model has a folder with the name of its saved result."""
    body = F.to_json(F.struct(*[F.col(c) for c in results.columns]))
    results.select(body.alias("value"), result_name(F.col(source), F.col(model)).alias("name")).write.mode("overwrite").partitionBy("name").text(path)


def passages_jsonl(passages: DataFrame, path: str, key: str = "_id") -> None:
    """One folder per text with one file of JSON lines: a header with _id and the number of passages, then the passages in order.

    Every text's rows are in one task, as its file is; the header is a row that sorts first.
    """
    heads = passages.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(key, F.lit(-1).cast("bigint").alias("seq"), F.to_json(F.struct(F.col(key).alias("_id"), F.col("_n").alias("_n_passages"))).alias("value"))
    body = passages.select(key, F.col("seq").cast("bigint").alias("seq"), F.to_json(F.struct("seq", "text", "n_words")).alias("value"))
    rows = heads.unionByName(body).withColumn("slug", path_slug(F.col(key)))
    rows.repartition("slug").sortWithinPartitions("slug", "seq").select("slug", "value").write.mode("overwrite").partitionBy("slug").text(path)


def packed_jsonl(passages: DataFrame, path: str, key: str = "_id") -> None:
    """The lines of `passages_jsonl` with many texts to a file, for collections of so many texts that a file each would take longer than their passages.

    A text is whole in one file, its header first, then its passages in order; every line has the _id of its text.
    """
    text, order = Window.partitionBy(key), F.col("seq").cast("bigint")
    head = F.to_json(F.struct(F.col(key).alias("_id"), F.count(F.lit(1)).over(text).alias("_n_passages")))
    body = F.to_json(F.struct(F.col(key).alias("_id"), order.alias("seq"), "text", "n_words"))
    first = F.row_number().over(text.orderBy(order)) == 1
    lines = passages.select(F.when(first, head).alias("head"), body.alias("body"))
    lines.select(F.explode(F.array_compact(F.array("head", "body"))).alias("value")).write.mode("overwrite").text(path)


def select_texts(texts: DataFrame, passages: DataFrame, least: int, key: str = "_id") -> DataFrame:
    """Texts with at least `least` passages, with their number, most first."""
    counted = passages.groupBy(key).agg(F.count(F.lit(1)).alias("n_passages")).filter(F.col("n_passages") >= least)
    return texts.join(counted, key).orderBy(F.desc("n_passages"), key)


def markdown(passages: DataFrame, title: str, text: str, facts: list[str]):
    """(markdown): a preview of each passage with its annotations."""
    lines = [F.concat(F.lit("## "), F.coalesce(F.col(title), F.lit("(untitled)"))), *[F.concat(F.lit(f"- **{f}**: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in facts], F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit("")))]
    return passages.withColumn("markdown", F.concat_ws("\n", *lines))


def migrate_annotations(spark: SparkSession, old: str, new: str) -> int:
    """Older JSON lines of one annotator (item fields and values side by side) into key/value lines; lines already moved are skipped. Returns how many were added."""
    rows = spark.read.option("primitivesAsString", True).json(old)
    keys = [c for c in ("_id", "section_id", "annotator", "timestamp") if c in rows.columns]
    value = F.to_json(F.struct(*[c for c in rows.columns if c not in keys]))
    moved = rows.select(F.to_json(F.struct(*keys)).alias("key"), value.alias("value")).distinct()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(new)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        moved = moved.join(spark.read.schema("key string, value string").json(new), ["key", "value"], "left_anti")
    space = Workspace(spark, "migrate")
    moved, seen = space.keep(moved, F.count(F.lit(1)).alias("n"))
    if seen["n"]:
        moved.write.mode("append").json(new)
    space.clear()
    return seen["n"]
