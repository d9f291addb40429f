"""Media files as rows: globbed sources, crop boxes, and reports of lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of pictures and recordings.
EXTENSIONS = {
    "frame": ["png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp"],
    "audio": ["wav", "mp3", "flac", "ogg", "m4a", "aac", "opus", "wma", "aif", "aiff"],
}


def _parts(df: DataFrame) -> DataFrame:
    file = F.element_at(F.split("path", "/"), -1)
    return df.withColumns({"stem": F.regexp_replace(file, r"\.[^.]*$", ""), "ext": F.lower(F.regexp_extract(file, r"\.([^.]*)$", 1))})


def sources(spark: SparkSession, globs: Mapping[str, Sequence[str]]) -> DataFrame:
    """path, kind, stem, content of all files that the globs of each kind match; the extension's case does not matter.

    Paths that several globs match come once; two files of one stem are an error, found by the query itself.
    """
    parts = []
    for kind, patterns in globs.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(patterns)).select("path", "length", "content")
        parts.append(_parts(files).where(F.col("ext").isin(EXTENSIONS[kind])).withColumn("kind", F.lit(kind)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.dropDuplicates(["path"])
    twice = every.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("stem", F.raise_error(F.concat(F.lit("two sources named "), "stem")).cast("boolean").alias("bad"))
    return every.join(twice, "stem", "left").where(F.coalesce("bad", F.lit(True))).select("path", "kind", "stem", "ext", "length", "content")


def crop_box(text: Column, width: int, height: int) -> Column:
    """struct<x, y, w, h> of 'x,y,w,h' in pixels, or fractions when all are <= 1: clamped, even, at least 8 x 8 or an error."""
    v = F.transform(F.split(text, ","), lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: x <= 1)
    scale = [width, height, width, height]
    at = [F.bround(v[i] * F.when(whole, float(scale[i])).otherwise(1.0)).cast("long") for i in range(4)]
    x, y = F.greatest(at[0], F.lit(0)), F.greatest(at[1], F.lit(0))
    w, h = F.least(at[2], width - x), F.least(at[3], height - y)
    small = F.raise_error(F.concat(F.lit("box too small: "), text)).cast("long")
    even = lambda c: c - c % 2
    return F.struct(x.alias("x"), y.alias("y"), F.when((w < 8) | (h < 8), small).otherwise(even(w)).alias("w"), even(h).alias("h"))


def report_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """segment (file stem) and line of text reports."""
    lines = spark.read.text(paths).select(F.col("value").alias("line"), F.input_file_name().alias("path"))
    return _parts(lines).select(F.col("stem").alias("segment"), "line")
