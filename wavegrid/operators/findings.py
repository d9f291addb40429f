"""Findings with boxes and rates: agreement between lenses, touching tiles, report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates_agree(a: Column, b: Column, tolerance: float = 0.2) -> Column:
    """Equal, double or half within the tolerance; a missing rate agrees with any."""
    near = lambda k: F.abs(a - k * b) <= tolerance * F.greatest(a, k * b)
    return a.isNull() | b.isNull() | near(1.0) | near(2.0) | near(0.5)


def agreeing_pairs(findings: DataFrame, clip: str, near: float = 0.15) -> DataFrame:
    """Pairs of findings of different lenses in one clip whose boxes overlap or whose centres are near, and whose rates agree.

    An equi-join on the clip and grid cells of the boxes' surroundings, not a join of all with all.
    """
    cell = 0.25
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - near) / cell), F.floor((F.col(hi) + near) / cell))
    celled = findings.withColumn("_cy", F.explode(span("y0", "y1"))).withColumn("_cx", F.explode(span("x0", "x1")))
    cols = ["id", "lens", "x0", "y0", "x1", "y1", "rate"]
    a = celled.select(F.col(clip).alias("clip"), "_cx", "_cy", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = celled.select(F.col(clip).alias("clip"), "_cx", "_cy", *[F.col(c).alias(f"b_{c}") for c in cols])
    overlap = (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    dx, dy = (F.col(f"a_{p}0") + F.col(f"a_{p}1") - F.col(f"b_{p}0") - F.col(f"b_{p}1") for p in "xy")
    close = F.sqrt(dx * dx + dy * dy) / 2 < near
    pairs = a.join(b, ["clip", "_cx", "_cy"]).where((F.col("a_id") < F.col("b_id")) & (F.col("a_lens") != F.col("b_lens")))
    return pairs.where((overlap | close) & rates_agree(F.col("a_rate"), F.col("b_rate"))).select("clip", "a_id", "b_id").distinct()


def tile_components(tiles: DataFrame, clip: str, tolerance: float) -> DataFrame:
    """Adds region: the smallest tile number that 8-neighbours of similar rate reach. A clip's tiles, a bounded grid, meet in one task."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {(y, x): i for i, (y, x) in enumerate(zip(pdf["y"], pdf["x"], strict=True))}
        rate = pdf["rate"].to_numpy()
        parent = list(range(len(pdf)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for (y, x), i in at.items():
            for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
                j = at.get((y + dy, x + dx))
                if j is not None and abs(rate[i] - rate[j]) <= tolerance:
                    a, b = root(i), root(j)
                    parent[b] = a
        ids = pdf["tile"].to_numpy()
        least: dict[int, int] = {}
        for i in range(len(pdf)):
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
        return pdf.assign(region=[least[root(i)] for i in range(len(pdf))])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema]
    return tiles.groupBy(clip).applyInPandas(run, ", ".join([*fields, "region long"]))


# The forms of report lines. FOUND_LINE's groups: channel kind, place, rate, channel.
FOUND_LINE = r"^found \d+ \(([a-z ,]+)[:)].*?\): (\w+ \w+) \(x.*?repeats ([\d.]+) times.*? in ([a-z-]+),"
COMB_LINE = r"([\d.]+) a second and its multiples"


def tally(lines: DataFrame, step: float = 0.02) -> DataFrame:
    """Rates read from report lines, with the number of segments that have each and its places: rate, segments, places; the widest spread first."""
    got = lambda i: F.regexp_extract("line", FOUND_LINE, i)
    clock = F.when(F.contains("line", F.lit("printed clock")) | F.contains("line", F.lit("edge of the picture")), " (clock)").otherwise("")
    rows = lines.where(F.col("line").rlike(FOUND_LINE)).select(
        "segment", (F.bround(got(3).cast("double") / step) * step).alias("rate"), F.concat(got(2), clock, F.lit(" in "), got(4)).alias("place")
    )
    counted = rows.groupBy(F.round("rate", 6).alias("rate")).agg(F.countDistinct("segment").alias("segments"), F.array_join(F.array_sort(F.collect_set("place")), "; ").alias("places"))
    return counted.orderBy(F.desc("segments"), "rate")


def combs(lines: DataFrame) -> DataFrame:
    """Bases of which a camera or light has multiples, by report lines: base, segments; the widest spread first."""
    rows = lines.where(F.col("line").rlike(COMB_LINE)).select("segment", F.regexp_extract("line", COMB_LINE, 1).cast("double").alias("base"))
    return rows.groupBy("base").agg(F.countDistinct("segment").alias("segments")).orderBy(F.desc("segments"), "base")


def agreement(findings: DataFrame, clip: str, near: float = 0.15, tolerance: float = 0.2) -> DataFrame:
    """Things of each clip: clip, thing, lenses, pieces, kind, place, rate, members.

    Findings (clip, id, lens, name, x0, y0, x1, y1, rate) join, in the order of id, the first thing that has a
    finding like them: overlapping or near, with equal, double or half rates if both have one. What several lenses
    saw comes first. A clip's findings are a few dozen and meet in one task.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf.sort_values("id").reset_index(drop=True)
        x0, y0, x1, y1, rate = (f[c].to_numpy(float) for c in ("x0", "y0", "x1", "y1", "rate"))
        rate = np.nan_to_num(rate)
        overlap = (np.minimum.outer(x1, x1) > np.maximum.outer(x0, x0)) & (np.minimum.outer(y1, y1) > np.maximum.outer(y0, y0))
        close = np.hypot(np.subtract.outer(x0 + x1, x0 + x1), np.subtract.outer(y0 + y1, y0 + y1)) / 2 < near
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.divide.outer(rate, rate)
        like = np.any([np.abs(ratio / k - 1) < tolerance for k in (1, 2, 0.5)], axis=0) | (rate[:, None] == 0) | (rate == 0)
        same = (overlap | close) & like
        things: list[list[int]] = []
        for i in range(len(f)):
            home = next((t for t in things if same[i, t].any()), None)
            if home is None:
                things.append([i])
            else:
                home.append(i)
        seen = [sorted(set(f["lens"][t])) for t in things]
        order = sorted(range(len(things)), key=lambda k: len(seen[k]) == 1)
        out = []
        for n, k in enumerate(order):
            own, first = things[k], things[k][0]
            rates = rate[own][rate[own] > 0]
            kind = "seen by both" if len(seen[k]) == 2 else f"seen by {len(seen[k])} lenses" if len(seen[k]) > 2 else f"only {seen[k][0]} saw" + (" (in pieces)" if len(own) > 1 else "")
            third = lambda c, names: names[min(2, max(0, int(c * 3)))]
            place = f"{third((y0[first] + y1[first]) / 2, ['upper', 'middle', 'lower'])} {third((x0[first] + x1[first]) / 2, ['left', 'centre', 'right'])}"
            members = ", ".join(f"{a} {b}" for a, b in zip(f["lens"][own], f["name"][own], strict=True))
            out.append((f[clip][0], n, seen[k], len(own), kind, place, float(rates.min()) if len(rates) else None, members))
        return pd.DataFrame(out, columns=["clip", "thing", "lenses", "pieces", "kind", "place", "rate", "members"])

    kind = findings.schema[clip].dataType.simpleString()
    schema = f"clip {kind}, thing int, lenses array<string>, pieces int, kind string, place string, rate double, members string"
    return findings.select(clip, "id", "lens", "name", "x0", "y0", "x1", "y1", "rate").groupBy(clip).applyInPandas(run, schema)


def agreement_lines(things: DataFrame) -> DataFrame:
    """clip, thing, line: the things in words."""
    swings = F.when(F.col("rate").isNotNull(), F.format_string("; about %.2f swings a second", "rate")).otherwise("")
    return things.select("clip", "thing", F.concat("kind", F.lit(": "), "place", swings, F.lit(" ("), "members", F.lit(")")).alias("line"))


def clip_summary(frames: DataFrame, readings: DataFrame) -> DataFrame:
    """clip, text: span, gaps and skips of a clip's frames, then what each lens read, as lines of one text.

    frames: clip, ts, h, w; readings: clip, lens, lines. A skip is a gap over 0.5 s and four times the usual.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("clip").orderBy("ts")
    gaps = frames.select("clip", "ts", "h", "w", (F.lead("ts").over(w) - F.col("ts")).alias("gap"))
    usual = gaps.groupBy("clip").agg(
        F.percentile("gap", 0.5).alias("usual"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count(F.lit(1)).alias("n"), F.max("h").alias("h"), F.max("w").alias("w")
    )  # a clip's frames
    skip = F.struct("ts", F.concat(F.floor(F.col("ts") / 60).cast("string"), F.lit(":"), F.format_string("%04.1f", F.col("ts") % 60), F.format_string(" (%.1f s)", "gap")).alias("said"))
    skips = gaps.join(usual.select("clip", "usual"), "clip").where(F.col("gap") > F.greatest(F.lit(0.5), 4 * F.col("usual"))).groupBy("clip").agg(F.slice(F.array_sort(F.collect_list(skip)), 1, 8).alias("skips"))
    read = readings.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("lens", "lines"))).alias("read"))  # a row a lens
    body = F.transform("read", lambda r: F.concat_ws("\n", F.concat(F.lit("["), r["lens"], F.lit("]")), F.concat_ws("\n", r["lines"])))
    head = F.format_string("segment: %.2f to %.2f s, %d frames read at %dx%d; frames %.2f to %.2f s apart", "t0", "t1", "n", "w", "h", "least", "most")
    skipped = F.concat(F.lit("the camera skipped frames at "), F.concat_ws(", ", F.transform("skips", lambda s: s["said"])))
    return usual.join(skips, "clip", "left").join(read, "clip", "left").select("clip", F.concat_ws("\n", head, F.when(F.col("skips").isNotNull(), skipped), F.concat_ws("\n", body)).alias("text"))
