"""Scans of the formats around the pipeline: JSON documents, position logs, camera files, binary tiles and file names.

Each parser takes a DataFrame of texts or bytes, so it works on spark.read.text,
spark.read.json or binaryFile input, and on columns made from tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MASK_SCHEMA = "masks array<struct<tag: string, prob: double, polygons: struct<include: array<array<array<double>>>, exclude: array<array<array<double>>>>>>"


def read_mask_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Mask documents of a folder, one file each."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("clip"), F.col("value").alias("json"))
    return parse_mask_polygons(files)


def parse_mask_polygons(documents: DataFrame) -> DataFrame:
    """(clip, mask_index, kind, poly_index, tag, prob, ring) of documents (clip, json); rings of fewer than three points go."""
    d = documents.withColumn("d", F.from_json("json", MASK_SCHEMA)).select("clip", F.posexplode("d.masks").alias("mask_index", "m"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"m.polygons.{k}").alias("rings")) for k in ("include", "exclude")])
    r = d.withColumn("k", F.explode(kinds)).select("clip", "mask_index", "m.tag", "m.prob", "k.kind", F.posexplode("k.rings").alias("poly_index", "ring"))
    return r.where(F.size("ring") >= 3).select("clip", "mask_index", "kind", "poly_index", F.coalesce("tag", F.lit("unknown")).alias("tag"), "prob", "ring")


def parse_b3dm(blobs: DataFrame) -> DataFrame:
    """(id, error, glb_offset, glb_bytes) of blobs (id, content): a header of magic and six little-endian numbers, four tables, then the model."""
    digits = lambda k: F.hex(F.substring("content", 5 + 4 * k, 4))
    u32 = lambda k: F.conv(F.concat(*[F.substring(digits(k), p, 2) for p in (7, 5, 3, 1)]), 16, 10).cast("long")
    head = {n: u32(k) for k, n in enumerate(("version", "bytes", "ft_json", "ft_bin", "bt_json", "bt_bin"))}
    at = 28 + head["ft_json"] + head["ft_bin"] + head["bt_json"] + head["bt_bin"]
    n = F.length("content")
    error = (
        F.when(n < 28, "truncated header").when(F.substring("content", 1, 4) != F.lit("b3dm").cast("binary"), "bad magic")
        .when(head["bytes"] != n, "length differs").when(at >= n, "tables exceed the file")
        .when(F.substring(F.col("content"), (at + 1).cast("int"), F.lit(4)) != F.lit("glTF").cast("binary"), "no model")
    )
    return blobs.select("id", error.alias("error"), F.when(error.isNull(), at).alias("glb_offset"), F.when(error.isNull(), n - at).cast("long").alias("glb_bytes"))


def parse_position_log(lines: DataFrame) -> DataFrame:
    """(file, line, t, lat, lon) of lines (file, line, value).

    The header is a file's first line that names timestamp, latitude and
    longitude, in any order; rows start with a digit and come after it; rows
    whose place is not a number go.
    """
    v = F.regexp_replace("value", "^﻿", "")
    low = lines.withColumn("value", v)
    names = F.transform(F.split(F.lower("value"), ","), lambda c: F.trim(c))
    is_head = F.lower("value").contains("timestamp") & F.lower("value").contains("latitude") & F.lower("value").contains("longitude")
    head = low.where(is_head).groupBy("file").agg(F.min_by(names, "line").alias("h"), F.min("line").alias("at"))
    rows = low.join(head, "file").where((F.col("line") > F.col("at")) & F.col("value").rlike("^[0-9]")).withColumn("c", F.split("value", ","))
    at = lambda n: F.try_element_at("c", F.array_position("h", n).cast("int")).try_cast("double")
    out = rows.select("file", "line", at("timestamp").alias("t"), at("latitude").alias("lat"), at("longitude").alias("lon"))
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out.where(good("lat") & good("lon"))


def parse_camera_file(lines: DataFrame) -> DataFrame:
    """(file, section, key, value) of lines (file, line, value) of an INI text: a key belongs to the last section named above it."""
    s = lines.withColumn("sec", F.when(F.col("value").rlike(r"^\s*\[.*\]\s*$"), F.regexp_extract("value", r"\[(.*)\]", 1)))
    s = s.withColumn("section", F.last("sec", ignorenulls=True).over(Window.partitionBy("file").orderBy("line")))
    kv = s.where(F.col("sec").isNull() & F.col("value").contains("="))
    return kv.select("file", "section", F.trim(F.regexp_extract("value", r"^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract("value", r"^[^=]*=(.*)$", 1)).alias("value"))


def parse_mask_names(names: DataFrame) -> DataFrame:
    """Adds base, tag, mask_index and prob to file names (name, ...), tagged form first, then without a tag; other names go."""
    tagged, plain = r"^(.+)_([A-Za-z0-9]+)_mask([0-9]+)_prob\(([0-9.]+)\)\.png$", r"^(.+)_mask([0-9]+)_prob\(([0-9.]+)\)\.png$"
    g = lambda p, k: F.regexp_extract("name", p, k)
    t = F.col("name").rlike(tagged)
    return names.where(F.col("name").rlike(plain)).select(
        *names.columns, F.when(t, g(tagged, 1)).otherwise(g(plain, 1)).alias("base"), F.when(t, g(tagged, 2)).alias("tag"),
        F.when(t, g(tagged, 3)).otherwise(g(plain, 2)).cast("int").alias("mask_index"), F.when(t, g(tagged, 4)).otherwise(g(plain, 3)).cast("double").alias("prob"))


def pending(inputs: DataFrame, done: DataFrame, known: DataFrame) -> DataFrame:
    """Tags to process: known ones without an output.  Every tag of known and done goes into the joins once."""
    return inputs.join(known.distinct(), "tag", "left_semi").join(done.distinct(), "tag", "left_anti")


def write_by_tag(df: DataFrame, path: str) -> None:
    """One folder per tag; tags in df replace their old output, others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("tag").parquet(path)


def split_bad_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (good rows, bad lines)."""
    raw = spark.read.text(path).withColumn("r", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return raw.where("r._bad IS NULL").select("r.*").drop("_bad"), raw.where("r._bad IS NOT NULL").select("value")


def write_label_grid(label: DataFrame, path: str, width: int, height: int, bounds: dict[str, float], tags: dict[str, int]) -> None:
    """A label raster as pixels in rows of tiles, and one row of meta data beside it; both replace what an earlier run left."""
    spark = label.sparkSession
    label.withColumn("band", F.expr("y div 512")).repartition("band").sortWithinPartitions("y", "x").write.mode("overwrite").partitionBy("band").parquet(f"{path}/pixels")
    meta = spark.range(1).select(F.lit(width).alias("width"), F.lit(height).alias("height"), *[F.lit(float(v)).alias(k) for k, v in bounds.items()], F.to_json(F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])).alias("tags"))
    meta.write.mode("overwrite").json(f"{path}/meta")


def read_label_grid(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(label raster, meta data); the raster's rows can be pruned by band."""
    return spark.read.parquet(f"{path}/pixels"), spark.read.json(f"{path}/meta")
