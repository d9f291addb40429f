"""Recipes as relations: sources, variants, jobs, tiles, shards, keys, resume and reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavegrid.functions.tables import RANGES
from wavegrid.operators.ordering import numbered


def variants(spark: SparkSession, axes: Mapping[str, Sequence], allowed: Column | None = None) -> DataFrame:
    """Every combination of the axes, sorted by name, numbered before impossible ones are dropped; values as strings. id, one column an axis, label."""
    df = spark.range(1).select()
    for name in sorted(axes):
        at = spark.createDataFrame([(i, str(v)) for i, v in enumerate(axes[name])], f"`_{name}` int, `{name}` string")
        df = df.crossJoin(F.broadcast(at))
    order = Window.orderBy(*[f"_{n}" for n in sorted(axes)])  # the sweep's own few rows
    label = F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), F.col(n)) for n in sorted(axes)])
    df = df.withColumns({"id": F.format_string("v%03d", F.row_number().over(order)), "label": label})
    df = df.select("id", *sorted(axes), "label")
    return df.where(allowed) if allowed is not None else df


def shard(df: DataFrame, order: str, index: int, of: int) -> DataFrame:
    """Every of-th row from the index-th (from 1) in the order of a unique column, numeric or string."""
    return numbered(df, order).where(F.col("place") % of == index - 1).drop("place")


def pending(sources: DataFrame, artifacts: DataFrame, stem: str = "stem") -> DataFrame:
    """Sources whose completion marker does not exist."""
    return sources.join(artifacts.select(stem), stem, "left_anti")


def tiles(sources: DataFrame, stem: str, duration: str, tile: float) -> DataFrame:
    """Equal tiles of about ``tile`` seconds with half a second of grace; one tile keeps the bare stem. name, start, length."""
    n = F.greatest(F.lit(1), F.ceil((F.col(duration) - 0.5) / tile)).cast("int") if tile > 0 else F.lit(1)
    t = sources.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    length = F.col(duration) / F.col("n")
    name = F.when(F.col("n") == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit(".t"), F.lpad(F.col("k").cast("string"), 3, "0")))
    return t.select(F.col(stem).alias("stem"), name.alias("name"), ((F.col("k") - 1) * length).alias("start"), length.alias("length"))


def key_of(part: object) -> str:
    """12 hex digits of the SHA-256 of an object's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(part, sort_keys=True, default=str).encode()).hexdigest()[:12]


def stage_keys(recipe: Mapping) -> dict[str, str]:
    """A key for each stage; each holds the key of the stage before, so a change goes down the chain."""
    audio = recipe["audio"]
    shape = {k: audio[k] for k in ("rows", "cols", "f_lo", "f_hi")}
    decode = recipe.get("decode", {})
    encode_key = key_of([recipe.get("encode", {}), {k: audio[k] for k in ("sr", "tile")}])
    notate_key = key_of([encode_key, recipe.get("notate", {})])
    return {
        "encode": encode_key,
        "decode": key_of([encode_key, shape, decode]),
        "notate": notate_key,
        "notes_decode": key_of([notate_key, shape, recipe.get("notes_decode", {}), decode.get("palette")]),
    }


def stale(state: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Stages whose stored key differs from the recipe's: stage, stored, wanted."""
    wanted = state.sparkSession.createDataFrame(sorted(keys.items()), "stage string, wanted string")
    return state.select("stage", F.col("key").alias("stored")).join(F.broadcast(wanted), "stage", "right").where("stored is not null and stored <> wanted")


def report(rows: DataFrame, by: str, name: str, value: str) -> DataFrame:
    """Per group: mean, population deviation, and the names of the least and largest value; ties go to the smaller name."""
    least = F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(name).alias("n"))))
    most = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("v"), F.col(name).alias("n"))))
    g = rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), least.alias("a"), most.alias("b"))
    return g.select(by, "n", "mean", "sd", F.col("a.n").alias("least_name"), F.col("a.v").alias("least"), F.col("b.n").alias("most_name"), (-F.col("b.v")).alias("most"))


def ranked(rows: DataFrame, variant: str, value: str, top: int = 12) -> DataFrame:
    """Variants by mean value: rank, variant, mean, sd, n, and whether best - worst is lost in noise (< 2 sd of the best)."""
    g = rows.where(F.col(value).isNotNull()).groupBy(variant).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("mean").desc(), variant)  # one row a variant
    whole = Window.partitionBy()
    spread = F.max("mean").over(whole) - F.min("mean").over(whole)
    g = g.withColumns({"rank": F.row_number().over(order), "noise": spread < 2 * F.first("sd").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return g.where(F.col("rank") <= top)


def run_settings(options: Mapping[str, object]) -> dict[str, object]:
    """Band, sample rate, frequency scale, grid and lens parameters of a run from a page's few options (range, fscale, rows, cols, lens).

    The spectral lens makes square pictures of one quadrant, so that columns follow rows there.
    """
    band = RANGES.get(options.get("range", "standard"), RANGES["standard"])
    rows, cols = int(options["rows"]), int(options["cols"])
    square = options.get("lens") == "spectral"
    return {**band, "scale": "linear" if options.get("fscale") == "linear" else "log", "rows": rows, "cols": rows if square else cols, "lens_params": {"mode": "quadrant"} if square else {}}


def flags(config: Mapping, keys: Sequence[str]) -> list[str]:
    """Command-line flags of the known keys: True is a bare flag, a table becomes key=val,key=val."""
    out: list[str] = []
    for k in sorted(set(config) & set(keys)):
        v, flag = config[k], "--" + k.replace("_", "-")
        if isinstance(v, bool):
            out += [flag] if v else []
        else:
            out += [flag, ",".join(f"{a}={b}" for a, b in v.items()) if isinstance(v, dict) else str(v)]
    return out
