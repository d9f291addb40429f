"""Reports, plans and states of runs as tables: sinks that replace what was there at the end only, and scans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of report.csv and the forms of the metrics in a program's printed text.
REPORT_COLUMNS = ["name", "source", "fidelity", "distinct_pitches", "notes", "note_density", "bits_per_note", "mean_cents"]
METRICS = {
    "fidelity": (r"spectral fidelity\s+([\d.]+)", "double"),
    "distinct_pitches": (r"distinct pitches\s+(\d+) of", "int"),
    "notes": (r"distinct pitches\s+\d+ of (\d+)", "int"),
    "note_density": (r"note density\s+([\d.]+)", "double"),
    "bits_per_note": (r"-> ([\d.]+) bits", "double"),
    "mean_cents": (r"pitch residual\s+mean\s+([\d.]+)", "double"),
}
REPORT_SCHEMA = "name string, source string, fidelity double, distinct_pitches int, notes int, note_density double, bits_per_note double, mean_cents double"


def metrics(text: Column) -> list[Column]:
    """A column for each metric of a program's text; null where it is not printed."""
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return [found(pattern).cast(kind).alias(name) for name, (pattern, kind) in METRICS.items()]


def file_name(stem: Column, kind: str) -> Column:
    """Name of what belongs to a stem: its chroma sidecar, annotated picture, words, plan or verify report."""
    ends = {"sidecar": ".chroma.png", "annotated": ".annotated.png", "words": ".txt", "plan": ".plan.json", "verify": ".verify.json", "notes": ".notes.wav"}
    return F.concat(F.regexp_replace(stem, r"\.[^./]*$", ""), F.lit(ends[kind]))


def replace(df: DataFrame, path: str, kind: str = "json", **options: str) -> None:
    """Write a folder of files beside the path and put it in place last, so that readers see the old one or the new one whole."""
    spark = df.sparkSession
    beside = f"{path}.new-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    getattr(writer, kind)(beside)
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(place(path), True)
    if not fs.rename(place(beside), place(path)):
        raise OSError(f"{beside} could not be put in place as {path}")


def write_report(rows: DataFrame, path: str) -> None:
    """report.csv: the eight columns, in the order of the sources; one row a source that has a verify report."""
    kinds = dict(f.strip().split() for f in REPORT_SCHEMA.split(","))
    have = set(rows.columns)
    typed = [(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in REPORT_COLUMNS]
    replace(rows.select(*typed).orderBy("source", "name"), path, "csv", header="true")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=REPORT_SCHEMA)


def read_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """variant and the columns of every variant's report, folder/VARIANT/report.csv."""
    variant = F.regexp_extract(F.input_file_name(), r"/([^/]+)/report\.csv", 1)
    return spark.read.csv(f"{folder}/*/report.csv", header=True, schema=REPORT_SCHEMA).select(variant.alias("variant"), *REPORT_COLUMNS)


def write_sweep(rows: DataFrame, variants: DataFrame, path: str) -> None:
    """sweep.csv: all variants' rows with their labels, in the order of variants."""
    labelled = rows.join(variants.select(F.col("id").alias("variant"), "label"), "variant")
    replace(labelled.select("variant", "label", *REPORT_COLUMNS).orderBy("variant", "source", "name"), path, "csv", header="true")


PLAN_SCHEMA = "key string, source string, duration double, tile_sec double, tiles array<string>, band array<double>"


def write_plans(plans: DataFrame, path: str) -> None:
    """Duration, tiles and band of recordings, with the key of the settings that they rest on."""
    replace(plans.select(*[f.strip().split()[0] for f in PLAN_SCHEMA.split(", ")]), path, "json")


def read_plans(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Plans; with a key, those that hold for it."""
    plans = spark.read.schema(PLAN_SCHEMA).json(path)
    return plans if key is None else plans.where(F.col("key") == key)


def write_state(keys: dict[str, str], spark: SparkSession, path: str) -> None:
    replace(spark.createDataFrame(sorted(keys.items()), "stage string, key string"), path, "json")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("stage string, key string").json(path)


def refuse_stale(stale: DataFrame, shards: int) -> None:
    """A run of one of several shards must not delete what others may be writing; stale: stage, stored, wanted."""
    rows = stale.collect()  # a row a stage
    if rows and shards > 1:
        raise RuntimeError("stale outputs of " + ", ".join(sorted(r["stage"] for r in rows)) + "; run one whole job first")


def without_stale(outputs: DataFrame, stale: DataFrame) -> DataFrame:
    """Outputs (name, stage, ...) less those of stale stages, which are then made again."""
    return outputs.join(F.broadcast(stale.select("stage")), "stage", "left_anti")  # a row a stage


def summary(report: DataFrame) -> DataFrame:
    """rows, scored, mean, sd, least, least_name, most, most_name of a report's fidelity."""
    named = lambda order: F.min_by("name", F.struct(order, "name"))
    scored = F.col("fidelity").isNotNull()
    return report.agg(
        F.count(F.lit(1)).alias("rows"), F.count("fidelity").alias("scored"), F.avg("fidelity").alias("mean"), F.stddev_pop("fidelity").alias("sd"),
        F.min("fidelity").alias("least"), named(F.when(scored, F.col("fidelity")).otherwise(float("inf"))).alias("least_name"),
        F.max("fidelity").alias("most"), named(F.when(scored, -F.col("fidelity")).otherwise(float("inf"))).alias("most_name"),
    )


