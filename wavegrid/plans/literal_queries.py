"""Queries on fixed tables: scales, notations, names, keys, sweeps."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavegrid.functions import music, numbers, tables
from wavegrid.operators import jobs
from wavegrid.plans.catalog import query, table


def values(rows: list[tuple]) -> str:
    """SQL literal rows."""
    one = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else repr(v)
    return "(values " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


SCALE_ROWS = [(10, n, i, s, None) for n, v in tables.SCALES.items() for i, s in enumerate(v)] + [(60, n, i, None, r) for n, v in tables.RATIO_SCALES.items() for i, r in enumerate(v)]


def scales(spark):
    """The scale dimension: base, name, degree, semitone, ratio; with the seven tunings built from fifths."""
    fixed = spark.createDataFrame(SCALE_ROWS, "base int, name string, degree int, semitone int, ratio double")
    return fixed.unionByName(tunings(spark))


def tunings(spark):
    rows = [(n, i, tables.FIFTHS[x], tables.FIFTHS[notes.split()[0]]) for n, notes in tables.TUNINGS.items() for i, x in enumerate(notes.split())]
    df = spark.createDataFrame(rows, "name string, string int, fifth int, first int")
    ratio = music.fold_fifths((F.col("fifth") - F.col("first")).cast("double"))
    df = df.withColumn("ratio", ratio)
    degree = F.row_number().over(Window.partitionBy("name").orderBy("ratio")) - 1
    return df.select(F.lit(60).alias("base"), "name", degree.alias("degree"), F.lit(None).cast("int").alias("semitone"), "ratio")


FIFTH_ROWS = [(n, tables.FIFTHS[x] - tables.FIFTHS[notes.split()[0]]) for n, notes in tables.TUNINGS.items() for x in notes.split()]
TUNING_SQL = f"""t as (select name, pow(1.5, k) / pow(2.0, floor(log2(pow(1.5, k)) + 1e-12)) as ratio from {values(FIFTH_ROWS)} v(name, k)),
tunings as (select 60 as base, name, (row_number() over (partition by name order by ratio) - 1)::int as degree, null::int as semitone, ratio from t)"""


@query("chain_of_fifths", f"with {TUNING_SQL} select name, degree, round(ratio, 9) as ratio from tunings")
def chain_of_fifths(spark, d):
    return tunings(spark).select("name", "degree", F.round("ratio", 9).alias("ratio"))


@query("known_scales", f"with {TUNING_SQL}, a as (select base, name, degree, semitone::int as semitone, ratio::double as ratio from {values(SCALE_ROWS)} v(base, name, degree, semitone, ratio) union all select * from tunings) select base, name, count(*) as degrees, round(max(coalesce(ratio, pow(2.0, semitone / 12.0))), 9) as top from a group by 1, 2")
def known_scales(spark, d):
    top = F.max(F.coalesce("ratio", F.pow(F.lit(2.0), F.col("semitone") / 12.0)))
    return scales(spark).groupBy("base", "name").agg(F.count(F.lit(1)).alias("degrees"), F.round(top, 9).alias("top"))


@query("same_scale", f"with {TUNING_SQL} select t.name, count(*) as degrees from tunings t join {values([(i, r) for i, r in enumerate(tables.RATIO_SCALES['babylonian'])])} b(degree, ratio) on t.degree = b.degree and abs(t.ratio - b.ratio) < 1e-9 group by 1 having count(*) = 7")
def same_scale(spark, d):
    """Tunings that equal the Babylonian ratio scale in every degree."""
    b = spark.createDataFrame(list(enumerate(tables.RATIO_SCALES["babylonian"])), "degree int, b double")
    same = tunings(spark).join(F.broadcast(b), "degree").where(F.abs(F.col("ratio") - F.col("b")) < 1e-9)
    return same.groupBy("name").agg(F.count(F.lit(1)).alias("degrees")).where("degrees = 7")


@query("scale_cents", f"select name, degree, round(100 * (12 * log2(ratio) - round_even(12 * log2(ratio), 0)), 6) as cents from {values([r for r in SCALE_ROWS if r[0] == 60])} v(base, name, degree, semitone, ratio)")
def scale_cents(spark, d):
    m = 12 * F.log2("ratio")
    return scales(spark).where("base = 60").join(F.broadcast(spark.createDataFrame([(n,) for n in tables.RATIO_SCALES], "name string")), "name", "left_semi").select("name", "degree", F.round(100 * (m - F.bround(m)), 6).alias("cents"))


@query("scale_fractions", f"select name, degree, num || '/' || den as fraction from (select name, degree, d.d as den, round_even(ratio * d.d, 0)::bigint as num, row_number() over (partition by name, degree order by round(abs(round_even(ratio * d.d, 0) / d.d - ratio), 15), d.d) as k from {values([r for r in SCALE_ROWS if r[0] == 60])} v(base, name, degree, semitone, ratio), range(1, 1000) d(d)) where k = 1")
def scale_fractions(spark, d):
    fixed = spark.createDataFrame([r for r in SCALE_ROWS if r[0] == 60], "base int, name string, degree int, semitone int, ratio double")
    return fixed.select("name", "degree", numbers.limit_denominator(F.col("ratio")).alias("fraction"))


MENU = {"minor_pent": "Pentatonic", "major_pent": "Pentatonic", "hirajoshi": "Pentatonic", "in_sen": "Pentatonic", "major": "Seven-note modes", "minor": "Seven-note modes", "dorian": "Seven-note modes", "phrygian": "Seven-note modes", "lydian": "Seven-note modes"}


@query("scale_menu", f"select coalesce(g.grp, 'Other') as grp, s.name from {values([(n,) for n in tables.SCALES])} s(name) left join {values(list(MENU.items()))} g(name, grp) on s.name = g.name")
def scale_menu(spark, d):
    known = spark.createDataFrame(list(MENU.items()), "name string, grp string")
    names = spark.createDataFrame([(n,) for n in tables.SCALES], "name string")
    other = names.join(F.broadcast(known), "name", "left_anti").select(F.lit("Other").alias("grp"), "name")
    return names.join(F.broadcast(known), "name").select("grp", "name").unionByName(other)


NAMES = str(tables.NOTE_NAMES)


@query("note_names", f"select m::int as midi, ({NAMES})[(m % 12 + 1)::int] || (m // 12 - 1) as name, m::int as back from range(128) r(m)")
def note_names(spark, d):
    n = spark.range(128).select(F.col("id").cast("int").alias("midi")).withColumn("name", music.midi_name(F.col("midi")))
    return n.withColumn("back", music.name_to_midi(F.lower("name")))


@query("octave_colour", "with h as (select n_nationkey, 27.5 * pow(2.0, n_nationkey / 3.0) as hz from nation), p as (select *, ((log2(hz / 400e12) % 1) + 1) % 1 * 5 as h from h), s as (select *, floor(h)::int % 6 as k, 1 - abs(h % 2 - 1) as x from p) select n_nationkey, round([1, x, 0, 0, x, 1][k + 1], 6) as r, round([x, 1, 1, x, 0, 0][k + 1], 6) as g, round([0, 0, x, 1, 1, x][k + 1], 6) as b from s")
def octave_colour(spark, d):
    hz = 27.5 * F.pow(F.lit(2.0), F.col("n_nationkey") / 3.0)
    return table(spark, d, "nation").select("n_nationkey", *[F.round(c, 6).alias(n) for n, c in zip("rgb", music.octave_rgb(hz), strict=True)])


@query("geomspace_grid", "select i::int as row, round(80.0 * pow(100.0, i / 199.0), 6) as hz, round(80.0 + i * (7920.0 / 199), 6) as linear_hz from range(200) r(i)")
def geomspace_grid(spark, d):
    g = spark.range(1).select(F.posexplode(F.arrays_zip(numbers.geomspace(80, 8000, 200).alias("g"), numbers.linspace(80, 8000, 200).alias("l"))).alias("row", "v"))
    return g.select("row", F.round("v.g", 6).alias("hz"), F.round("v.l", 6).alias("linear_hz"))


@query("row_of_frequency", "select p_partkey, round(199 * ln(p_retailprice / 80.0) / ln(100.0), 6) as row, round_even(199 * ln(p_retailprice / 80.0) / ln(100.0), 0)::int as pixel from part")
def row_of_frequency(spark, d):
    row = 199 * F.log(F.col("p_retailprice") / 80.0) / F.log(F.lit(100.0))
    return table(spark, d, "part").select("p_partkey", F.round(row, 6).alias("row"), F.bround(row).cast("int").alias("pixel"))


@query("nice_steps", "with s as (select p_partkey, p_retailprice / 8 as raw, pow(10.0, floor(log10(p_retailprice / 8))) as p from part) select p_partkey, round(case when p >= raw then p when 2 * p >= raw then 2 * p when 5 * p >= raw then 5 * p else 10 * p end, 6) as step from s")
def nice_steps(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(numbers.nice_step(F.col("p_retailprice"), 8), 6).alias("step"))


@query("ruler_ticks", "select round(m * pow(10.0, k), 3) as hz, round(199 * ln(m * pow(10.0, k) / 80.0) / ln(100.0), 4) as row from unnest([1, 2, 5]) a(m), range(1, 5) b(k) where m * pow(10.0, k) between 80 and 8000")
def ruler_ticks(spark, d):
    t = spark.range(1, 5).select(F.explode(F.transform(F.array(*[F.lit(m) for m in (1, 2, 5)]), lambda m: m * F.pow(F.lit(10.0), F.col("id")))).alias("hz")).where("hz between 80 and 8000")
    return t.select(F.round("hz", 3).alias("hz"), F.round(199 * F.log(F.col("hz") / 80.0) / F.log(F.lit(100.0)), 4).alias("row"))


@query("clock_text", "with s as (select o_orderkey, o_orderkey * 3.25::double as s from orders) select o_orderkey, printf('%02d:%02d:%05.2f', floor(s / 3600)::int, (floor(s / 60) % 60)::int, s % 60) as long_form, printf('%d:%02d', floor(s / 60)::int, (floor(s) % 60)::int) as short_form from s")
def clock_text(spark, d):
    s = F.col("o_orderkey") * 3.25
    return table(spark, d, "orders").select("o_orderkey", numbers.clock(s).alias("long_form"), numbers.short_clock(s).alias("short_form"))


@query("options_map", r"with t as (select c_custkey, 'a=' || c_nationkey || ', b = x=' || c_mktsegment || ',bad,a=' || (c_custkey % 3) as text from customer) select c_custkey, (c_custkey % 3)::varchar as a, 'x=' || regexp_extract(text, 'x=([A-Z]+)', 1) as b from t")
def options_map(spark, d):
    c = table(spark, d, "customer")
    text = F.concat(F.lit("a="), F.col("c_nationkey").cast("string"), F.lit(", b = x="), F.col("c_mktsegment"), F.lit(",bad,a="), (F.col("c_custkey") % 3).cast("string"))
    m = c.select("c_custkey", numbers.parse_options(text).alias("m"))
    return m.select("c_custkey", F.element_at("m", "a").alias("a"), F.element_at("m", "b").alias("b"))


@query("midi_quantity", "with n as (select o_orderkey, o_orderkey * 37 as n from orders) select o_orderkey, lower(case when n >= 2097152 then printf('%02X', (n >> 21) % 128 + 128) else '' end || case when n >= 16384 then printf('%02X', (n >> 14) % 128 + 128) else '' end || case when n >= 128 then printf('%02X', (n >> 7) % 128 + 128) else '' end || printf('%02X', n % 128)) as vlq from n")
def midi_quantity(spark, d):
    return table(spark, d, "orders").select("o_orderkey", numbers.variable_length(F.col("o_orderkey") * 37).alias("vlq"))


@query("tempo_grid", "with t as (select c_custkey, 60.0 / (60 + c_custkey % 120) * 4 / 8 as step from customer) select c_custkey, round(step, 9) as step, greatest(1, floor(c_custkey / step))::bigint as steps from t")
def tempo_grid(spark, d):
    step = 60.0 / (60 + F.col("c_custkey") % 120) * 4 / 8
    return table(spark, d, "customer").select("c_custkey", F.round(step, 9).alias("step"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("c_custkey") / step)).alias("steps"))


@query("string_pairs", f"""with n as (select * from {values([(i, t, c) for i, (t, c) in enumerate(tables.NOTATION)])} v(pos, term, times)), p as (select * from {values([(t, a, b) for t, (a, b) in tables.STRING_PAIRS.items()])} v(term, a, b)),
b as (select pos, n.term, a, b, times, coalesce(sum(times) over (order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as start_beat from n join p using (term)),
s as (select * from {values(list(enumerate(tables.RATIO_SCALES["babylonian"], 1)))} v(string, ratio))
select pos, term, start_beat + k as beat, round(220.0 * x.ratio, 4) as hz_a, round(220.0 * y.ratio, 4) as hz_b from b, lateral (select unnest(range(0, times)) as k), s x, s y where x.string = a and y.string = b""")
def string_pairs(spark, d):
    n = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(tables.NOTATION)], "pos int, term string, times int")
    p = spark.createDataFrame([(t, a, b) for t, (a, b) in tables.STRING_PAIRS.items()], "term string, a int, b int")
    start = F.coalesce(F.sum("times").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = n.withColumn("start", start).join(F.broadcast(p), "term").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    hz = lambda c: F.round(220.0 * F.element_at(F.array(*[F.lit(r) for r in tables.RATIO_SCALES["babylonian"]]), F.col(c)), 4)
    return b.select("pos", "term", (F.col("start") + F.col("k")).alias("beat"), hz("a").alias("hz_a"), hz("b").alias("hz_b"))


SONG_ROWS = [(i, s, j, letter, units) for i, (s, letters) in enumerate(tables.SONG) for j, (letter, units) in enumerate(letters)]


@query("seikilos_positions", f"select syllable_no, place, syllable, round(440.0 * ratio, 4) as hz, units, (sum(units) over (order by syllable_no, place) - units)::bigint as start from {values(SONG_ROWS)} s(syllable_no, syllable, place, letter, units) join {values(list(tables.LETTERS.items()))} l(letter, ratio) using (letter)")
def seikilos_positions(spark, d):
    """Nested song -> letters with their start: explode, dimension join, running sum."""
    song = spark.createDataFrame([(i, s, letters) for i, (s, letters) in enumerate(tables.SONG)], "syllable_no int, syllable string, letters array<struct<letter:string,units:int>>")
    letters = spark.createDataFrame(list(tables.LETTERS.items()), "letter string, ratio double")
    e = song.select("syllable_no", "syllable", F.posexplode("letters").alias("place", "x")).select("syllable_no", "syllable", "place", "x.letter", "x.units")
    w = Window.orderBy("syllable_no", "place").rowsBetween(Window.unboundedPreceding, 0)  # the song's few letters
    e = e.join(F.broadcast(letters), "letter").withColumn("start", F.sum("units").over(w) - F.col("units"))
    return e.select("syllable_no", "place", "syllable", F.round(440.0 * F.col("ratio"), 4).alias("hz"), "units", "start")


AXES = {"notate.base": [10, 60], "notate.scale": ["minor_pent", "harmonic", "octatonic"], "notate.voices": [3, 7]}


@query("sweep_grid", """with v as (select b::varchar as base, s as scale, v::varchar as voices, row_number() over (order by bi, si, vi) as n from (values (0, 10), (1, 60)) x(bi, b), (values (0, 'minor_pent'), (1, 'harmonic'), (2, 'octatonic')) y(si, s), (values (0, 3), (1, 7)) z(vi, v))
select printf('v%03d', n) as id, base, scale, voices from v where (base = '10') = (scale <> 'harmonic')""")
def sweep_grid(spark, d):
    known = [(str(b), n) for b, names in ((10, tables.SCALES), (60, tables.RATIO_SCALES)) for n in names]
    s = spark.createDataFrame(known, "b string, n string")
    axes = {k.split(".")[1]: v for k, v in AXES.items()}
    v = jobs.variants(spark, axes)
    return v.join(F.broadcast(s), (v.base == s.b) & (v.scale == s.n), "left_semi").select("id", "base", "scale", "voices")


RECIPE = {"audio": tables.AUDIO_DEFAULTS, "encode": {"gamma": 1.7, "auto_prep": True}, "decode": {"palette": "magma"}, "notate": {"base": 60, "scale": "harmonic"}, "notes_decode": {"color": False}}


def _json(x) -> str:
    """JSON text with sorted keys, as a SQL literal, written without the operator's help."""
    if isinstance(x, dict):
        inner = ", ".join(f'"{k}": {_json(v)[1:-1]}' for k, v in sorted(x.items()))
        return "'{" + inner + "}'"
    return "'" + ("true" if x is True else "false" if x is False else f'"{x}"' if isinstance(x, str) else str(x)) + "'"


_SHAPE = _json({k: RECIPE["audio"][k] for k in ("rows", "cols", "f_lo", "f_hi")})
#: The chain of keys in SQL: each stage hashes the key before it with its own settings.
KEYS = f"""with encode as (select substr(sha256('[' || {_json(RECIPE["encode"])} || ', ' || {_json({k: RECIPE["audio"][k] for k in ("sr", "tile")})} || ']'), 1, 12) as k),
notate as (select substr(sha256('["' || k || '", ' || {_json(RECIPE["notate"])} || ']'), 1, 12) as k from encode),
keys as (select 'encode' as stage, k as key from encode union all select 'notate', k from notate
  union all select 'decode', substr(sha256('["' || k || '", ' || {_SHAPE} || ', ' || {_json(RECIPE["decode"])} || ']'), 1, 12) from encode
  union all select 'notes_decode', substr(sha256('["' || k || '", ' || {_SHAPE} || ', ' || {_json(RECIPE["notes_decode"])} || ', "magma"]'), 1, 12) from notate)"""


@query("stage_keys", KEYS + " select stage, key from keys")
def stage_keys(spark, d):
    return spark.createDataFrame(sorted(jobs.stage_keys(RECIPE).items()), "stage string, key string")


@query("stale_stages", KEYS + " select stage, 'old' as stored, key as wanted from keys where stage = 'decode'")
def stale_stages(spark, d):
    keys = jobs.stage_keys(RECIPE)
    state = spark.createDataFrame([(s, "old" if s == "decode" else k) for s, k in keys.items()], "stage string, key string")
    return jobs.stale(state, keys)


@query("prime_voices", "select n::int as prime from range(2, 60) r(n) where not exists (select 1 from range(2, 60) k(k) where k.k < n and n % k.k = 0)")
def prime_voices(spark, d):
    return spark.range(2, 60).where(~F.exists(F.sequence(F.lit(2).cast("long"), F.greatest(F.col("id") - 1, F.lit(2))), lambda k: (k < F.col("id")) & (F.col("id") % k == 0))).select(F.col("id").cast("int").alias("prime"))


@query("spiral_points", f"select i::int as step, round(0.5 + sqrt(i / 400.0) * 0.5 * cos(i * {math.pi * (3 - math.sqrt(5))!r}), 6) as x, round(0.5 + sqrt(i / 400.0) * 0.5 * sin(i * {math.pi * (3 - math.sqrt(5))!r}), 6) as y from range(400) r(i)")
def spiral_points(spark, d):
    a, r = F.col("id") * math.pi * (3 - math.sqrt(5)), F.sqrt(F.col("id") / 400.0) * 0.5
    return spark.range(400).select(F.col("id").cast("int").alias("step"), F.round(0.5 + r * F.cos(a), 6).alias("x"), F.round(0.5 + r * F.sin(a), 6).alias("y"))


@query("crop_boxes", """with b as (select c_custkey, c_custkey % 300 as x, c_custkey % 200 as y, 8 + c_custkey % 400 as w, 8 + c_custkey % 300 as h from customer)
select c_custkey, x, y, least(w, 640 - x) // 2 * 2 as w, least(h, 480 - y) // 2 * 2 as h from b""")
def crop_boxes(spark, d):
    from wavegrid.sources.media import crop_box

    c = table(spark, d, "customer")
    text = F.concat_ws(",", F.col("c_custkey") % 300, F.col("c_custkey") % 200, 8 + F.col("c_custkey") % 400, 8 + F.col("c_custkey") % 300)
    return c.select("c_custkey", crop_box(text, 640, 480).alias("b")).select("c_custkey", "b.*")


@query("contact_sheet", "select doc_id, (n // 8)::bigint as sheet_row, n % 8 as sheet_col from (select doc_id, row_number() over (order by doc_id) - 1 as n from documents)")
def contact_sheet(spark, d):
    from wavegrid.operators.ordering import numbered

    n = numbered(table(spark, d, "documents").select("doc_id"), "doc_id")
    return n.select("doc_id", F.floor(F.col("place") / 8).alias("sheet_row"), (F.col("place") % 8).alias("sheet_col"))


@query("assembly_offsets", "select source, doc_id, (sum(n_chars) over (partition by source order by doc_id) - n_chars)::bigint as offset_samples from documents")
def assembly_offsets(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "documents").select("source", "doc_id", (F.sum("n_chars").over(w) - F.col("n_chars")).alias("offset_samples"))
