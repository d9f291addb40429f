"""Queries on the other tables: embeddings as pictures and state vectors, documents and pages as media, orders as signals and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavegrid.functions import music, numbers
from wavegrid.functions.tables import PALETTES, RATIO_SCALES
from wavegrid.operators import findings, jobs, normalise, notes, recurrence
from wavegrid.plans.catalog import query, table
from wavegrid.plans.event_queries import PENT, sql_midi, sql_nearest, sql_snap


def cells(spark, d):
    """Each embedding as one picture of 64 cells."""
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "x")).withColumn("x", F.abs(F.col("x").cast("double")))


CELLS = "with cells as (select vec_id, unnest(range(0, len(embedding)))::int as col, abs(unnest(embedding)::double) as x from embeddings)"


@query(
    "auto_prep",
    CELLS + """, p as (select vec_id, quantile_cont(x, 0.01) as lo, quantile_cont(x, 0.99) as hi, median(x) as m from cells group by 1),
s as (select c.vec_id, col, least(greatest(case when hi > lo then (x - lo) / (hi - lo) else x end, 0), 1) as v,
  least(greatest(case when hi > lo then (m - lo) / (hi - lo) else m end, 0), 1) > 0.5 as inverted from cells c join p using (vec_id))
select vec_id, col, inverted, round(pow(case when inverted then 1 - v else v end, 1.3), 6) as v from s""",
)
def auto_prep(spark, d):
    return normalise.auto_prep(cells(spark, d), "vec_id", "x").select("vec_id", "col", "inverted", F.round("v", 6).alias("v"))


@query(
    "log_compress_norm",
    CELLS + """, l as (select vec_id, col, ln(1 + 50 * x) as x from cells),
n as (select vec_id, col, (x - min(x) over w) / (max(x) over w - min(x) over w) as v from l window w as (partition by vec_id))
select vec_id, col, round(v, 6) as v from n""",
)
def log_compress_norm(spark, d):
    return normalise.log_compressed(cells(spark, d), "vec_id", "x").select("vec_id", "col", F.round("v", 6).alias("v"))


STOPS = [[int(s[i : i + 2], 16) for s in PALETTES["magma"]] for i in (1, 3, 5)]


@query(
    "palette_index",
    CELLS + f""", p as (select vec_id, quantile_cont(x, 0.01) as lo, quantile_cont(x, 0.995) as hi from cells group by 1),
l as (select vec_id, col, floor(least(greatest((x - lo) / greatest(hi - lo, 1e-9), 0), 1) * 255)::int as level from cells join p using (vec_id)),
t as (select i::int as level, i * 9 / 255.0 as part, least(floor(i * 9 / 255.0), 8)::int as k from range(256) r(i)),
c as (select level, {", ".join(f"round_even({s}[k + 1] + (part - k) * ({s}[k + 2] - {s}[k + 1]), 0)::int as {n}" for s, n in zip(STOPS, "rgb", strict=True))} from t)
select vec_id, col, level, r, g, b from l join c using (level)""",
)
def palette_index(spark, d):
    levels = normalise.palette_levels(cells(spark, d), "vec_id", "x")
    return levels.join(F.broadcast(normalise.palette_table(spark, PALETTES["magma"])), "level").select("vec_id", "col", "level", "r", "g", "b")  # 256 rows


@query(
    "octave_pixels",
    CELLS + """, f as (select vec_id, col, x, 80 * pow(100.0, col / 63.0) as hz from cells),
h as (select *, ((log2(hz / 400e12) % 1) + 1) % 1 * 5 as h from f), s as (select *, floor(h)::int % 6 as k, 1 - abs(h % 2 - 1) as t from h)
select vec_id, col, round(x * [1, t, 0, 0, t, 1][k + 1], 6) as r, round(x * [t, 1, 1, t, 0, 0][k + 1], 6) as g, round(x * [0, 0, t, 1, 1, t][k + 1], 6) as b from s""",
)
def octave_pixels(spark, d):
    c = cells(spark, d).withColumn("hz", 80 * F.pow(F.lit(100.0), F.col("col") / 63.0))
    return c.select("vec_id", "col", *[F.round(F.col("x") * v, 6).alias(n) for n, v in zip("rgb", music.octave_rgb(F.col("hz")), strict=True)])


UNITS = """with nth as (select vec_id, embedding, row_number() over (order by vec_id) - 1 as place, count(*) over () as n from embeddings),
c as (select case when n <= 1000 then place else place * 1000 // n end as pool, vec_id, unnest(range(0, len(embedding))) as k, unnest(embedding)::double as x from nth),
m as (select pool, k, min(vec_id) as i, avg(x) as x from c group by 1, 2),
v as (select min(i) as i, list(x order by k) as v from m group by pool),
u as (select i, [x / greatest(sqrt(list_sum([y * y for y in v])), 1e-9) for x in v] as unit from v)"""
PAIRS = UNITS + ", pairs as (select a.i, b.i as j, sqrt(greatest(2 - 2 * list_dot_product(a.unit, b.unit), 0)) as d from u a join u b on a.i < b.i)"


@query("recurrence_pairs", PAIRS + " select i, j, round(d, 5) as d from pairs where d < 1.05")
def recurrence_pairs(spark, d):
    return recurrence.pair_distances(table(spark, d, "embeddings"), "vec_id", largest=1.05).select("i", "j", F.round("d", 5).alias("d"))


@query("recurrence_binary", PAIRS + " select i, j from pairs where round(d, 6) <= (select round(quantile_cont(d, 0.02), 6) from pairs)")
def recurrence_binary(spark, d):
    return recurrence.pair_distances(table(spark, d, "embeddings"), "vec_id", share=0.02).select("i", "j")


@query("recurrence_image", PAIRS + ", q as (select quantile_cont(d, 0.02) as lo, quantile_cont(d, 0.98) as hi from pairs) select i, count(*) as cells, round(avg(1 - least(greatest((d - lo) / (hi - lo), 0), 1)), 5) as level from pairs, q group by 1")
def recurrence_image(spark, d):
    names, level = recurrence.recurrence_levels(table(spark, d, "embeddings"), "vec_id")
    rows = [(int(n), len(names) - 1 - k, round(float(level[k, k + 1 :].mean()), 5)) for k, n in enumerate(names[:-1])]  # a row of a bounded picture
    return spark.createDataFrame(rows, "i long, cells long, level double")


@query(
    "discords",
    """with n as (select vec_id, row_number() over (order by vec_id) - 1 as place, [x::double / greatest(sqrt(list_sum([y::double * y::double for y in embedding])), 1e-9) for x in embedding] as unit from embeddings),
b as (select greatest(1, floor(count(*) * 0.02))::int as band from n),
s as (select x.vec_id, min(sqrt(greatest(2 - 2 * list_dot_product(x.unit, y.unit), 0))) as score from n x, n y, b where abs(x.place - y.place) > band group by 1)
select vec_id, round(score, 5) as score from s order by s.score desc, vec_id limit 10""",
)
def discords(spark, d):
    return recurrence.discords(table(spark, d, "embeddings"), top=10).select(F.col("index").alias("vec_id"), F.round("score", 5).alias("score"))


@query(
    "discord_scores",
    """with n as (select vec_id, row_number() over (order by vec_id) - 1 as place, [x::double / greatest(sqrt(list_sum([y::double * y::double for y in embedding])), 1e-9) for x in embedding] as unit from embeddings),
b as (select greatest(1, floor(count(*) * 0.02))::int as band from n)
select x.vec_id, round(min(sqrt(greatest(2 - 2 * list_dot_product(x.unit, y.unit), 0))), 5) as score from n x, n y, b where abs(x.place - y.place) > band group by 1""",
)
def discord_scores(spark, d):
    return recurrence.discord_scores(table(spark, d, "embeddings")).select(F.col("index").alias("vec_id"), F.round("score", 5).alias("score"))


@query("snap_scale_base10", f"select p_partkey, {sql_snap(sql_midi('p_retailprice'), 45, PENT)} as midi from part")
def snap_scale_base10(spark, d):
    return table(spark, d, "part").select("p_partkey", music.snap_semitone(music.hz_to_midi(F.col("p_retailprice")), 45, PENT).alias("midi"))


JUST = RATIO_SCALES["just_major"]


@query(
    "snap_ratio_base60",
    f"""with r as (select p_partkey, log2(p_retailprice / 110.0) as l from part), w as (select *, l - floor(l) as within from r)
select p_partkey, round(110.0 * pow(2.0, floor(l)) * pow(2.0, {sql_nearest("within", [f"log2({x!r})" for x in [*JUST, 2.0]])}), 5) as hz from w""",
)
def snap_ratio_base60(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(music.snap_ratio(F.col("p_retailprice"), 110.0, JUST), 5).alias("hz"))


@query(
    "nearest_bin",
    "select p_partkey, round_even(p_retailprice / 10.766601562, 0)::bigint as bin from part",
)
def nearest_bin(spark, d):
    return table(spark, d, "part").select("p_partkey", F.bround(F.col("p_retailprice") / 10.766601562).cast("long").alias("bin"))


@query(
    "band_means",
    "select floor(ln(l_extendedprice / 900.0) / (ln(120.0) / 48))::bigint as band, count(*) as n, round(avg(l_extendedprice), 2) as mean from lineitem where l_extendedprice >= 900 group by 1",
)
def band_means(spark, d):
    band = F.floor(F.log(F.col("l_extendedprice") / 900.0) / (F.log(F.lit(120.0)) / 48))
    rows = table(spark, d, "lineitem").where("l_extendedprice >= 900")
    return rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 2).alias("mean"))


@query(
    "filled_bands",
    """with b as (select floor(ln(l_extendedprice / 900.0) / (ln(120.0) / 400))::bigint as band, round(sum(l_extendedprice) * 100)::bigint as cents, count(*) as n from lineitem where l_extendedprice >= 900 group by 1),
a as (select unnest(range(0, (select greatest(max(band), 400) + 1 from b))) as band), j as (select a.band, cents, n from a left join b using (band))
select band, last_value(cents ignore nulls) over (order by band) as cents, last_value(n ignore nulls) over (order by band) as n from j""",
)
def filled_bands(spark, d):
    """An empty band copies the band below."""
    band = F.floor(F.log(F.col("l_extendedprice") / 900.0) / (F.log(F.lit(120.0)) / 400))
    sums = table(spark, d, "lineitem").where("l_extendedprice >= 900").groupBy(band.alias("band")).agg(F.round(F.sum("l_extendedprice") * 100).cast("long").alias("cents"), F.count(F.lit(1)).alias("n"))
    every = sums.agg(F.greatest(F.max("band"), F.lit(400)).alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("last", F.lit(400).cast("long")))).alias("band"))
    w = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)  # bands are logarithms of prices, some hundreds
    return every.join(sums, "band", "left").select("band", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("cents", "n")])


@query(
    "pool_frames",
    """with f as (select l_shipdate::date as day, sum(l_extendedprice) as x from lineitem group by 1), n as (select row_number() over (order by day) - 1 as i, count(*) over () as t, x from f)
select floor(i * 100 / t)::bigint as pool, count(*) as frames, round(avg(x), 2) as mean from n group by 1""",
)
def pool_frames(spark, d):
    f = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("x"))
    n = f.withColumns({"i": F.row_number().over(Window.orderBy("day")) - 1, "t": F.count(F.lit(1)).over(Window.partitionBy())})  # one row a day
    return n.groupBy(F.floor(F.col("i") * 100 / F.col("t")).alias("pool")).agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("x"), 2).alias("mean"))


@query(
    "spectral_fidelity",
    """with o as (select date_trunc('month', o_orderdate)::date as m, sum(o_totalprice) as a from orders group by 1), l as (select date_trunc('month', l_shipdate)::date as m, sum(l_extendedprice) as b from lineitem group by 1),
j as (select ln(1 + a) as a, ln(1 + b) as b from o join l using (m))
select 1 as report, round((avg(a * b) - avg(a) * avg(b)) / ((stddev_pop(a) + 1e-9) * (stddev_pop(b) + 1e-9)), 4) as fidelity from j""",
)
def spectral_fidelity(spark, d):
    month = lambda c: F.to_date(F.date_trunc("month", c)).alias("m")
    o = table(spark, d, "orders").groupBy(month("o_orderdate")).agg(F.sum("o_totalprice").alias("a"))
    li = table(spark, d, "lineitem").groupBy(month("l_shipdate")).agg(F.sum("l_extendedprice").alias("b"))
    j = o.join(li, "m").select(F.lit(1).alias("report"), F.log1p("a").alias("a"), F.log1p("b").alias("b"))
    return notes.fidelity(j, ["report"], "a", "b").select("report", F.round("fidelity", 4).alias("fidelity"))


@query(
    "frame_diff_rms",
    """with f as (select o_orderpriority as cell, o_orderdate::date as day, sum(o_totalprice) as v from orders group by 1, 2), c as (select day, v - lag(v) over (partition by cell order by day) as x from f)
select day::varchar as day, round(sqrt(avg(x * x)), 2) as rms from c where x is not null group by c.day order by sqrt(avg(x * x)) desc, c.day limit 20""",
)
def frame_diff_rms(spark, d):
    f = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("cell"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    r = jobs_rms(f, False)
    return r.orderBy(F.col("rms").desc(), "day").limit(20).select(F.col("day").cast("string").alias("day"), F.round("rms", 2).alias("rms"))


def jobs_rms(frames, normalize):
    from wavegrid.operators.series import diff_rms

    return diff_rms(frames, ["day"], "v", "cell", normalize)


@query(
    "frame_diff_rms_normalized",
    """with f as (select o_orderpriority as cell, o_orderdate::date as day, sum(o_totalprice) as v from orders group by 1, 2), c as (select day, v - lag(v) over (partition by cell order by day) as x from f)
select day::varchar as day, round(sqrt(avg(x * x)) / greatest(max(abs(x)), 1e-12), 6) as rms from c where x is not null group by c.day""",
)
def frame_diff_rms_normalized(spark, d):
    f = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("cell"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    return jobs_rms(f, True).select(F.col("day").cast("string").alias("day"), F.round("rms", 6).alias("rms"))


REPORT = """select {k} as {k}, count({v}) as n, round(avg({v}), 2) as mean, round(stddev_pop({v}), 2) as sd,
  (list({n} order by {v}, {n}))[1] as least_name, min({v}) as least, (list({n} order by {v} desc, {n}))[1] as most_name, max({v}) as most from {t} group by {k}"""


@query("report_summary", REPORT.format(k="l_suppkey", n="l_orderkey", v="l_extendedprice", t="lineitem"))
def report_summary(spark, d):
    r = jobs.report(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "l_extendedprice")
    return r.withColumns({"mean": F.round("mean", 2), "sd": F.round("sd", 2)})


@query(
    "rank_variants",
    """with g as (select l_shipmode as variant, avg(v) as mean, stddev_pop(v) as sd, count(*) as n from (select l_returnflag || l_linestatus as l_shipmode, l_discount * l_tax as v from lineitem) group by 1),
r as (select *, row_number() over (order by mean desc, variant) as rank, max(mean) over () - min(mean) over () < 2 * first_value(sd) over (order by mean desc, variant rows between unbounded preceding and unbounded following) as noise from g)
select variant, round(mean, 9) as mean, round(sd, 9) as sd, n, rank, noise from r where rank <= 12""",
)
def rank_variants(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("variant"), (F.col("l_discount") * F.col("l_tax")).alias("v"))
    r = jobs.ranked(rows, "variant", "v").withColumns({"mean": F.round("mean", 9), "sd": F.round("sd", 9)})
    return r.withColumn("rank", F.col("rank").cast("long"))


@query(
    "noise_guard",
    """with s as (select d.lang as variant, l.quality::double as v from labels l join documents d using (doc_id)), g as (select variant, avg(v) as mean, stddev_pop(v) as sd, count(*) as n from s group by 1),
r as (select *, row_number() over (order by mean desc, variant) as rank, max(mean) over () - min(mean) over () < 2 * first_value(sd) over (order by mean desc, variant rows between unbounded preceding and unbounded following) as noise from g)
select variant, round(mean, 9) as mean, n, rank, noise from r""",
)
def noise_guard(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("variant")), "doc_id").withColumn("v", F.col("quality").cast("double"))
    return jobs.ranked(rows, "variant", "v").select("variant", F.round("mean", 9).alias("mean"), "n", F.col("rank").cast("long"), "noise")


@query("shard_slice", "select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as n from documents) where n % 4 = 2")
def shard_slice(spark, d):
    return jobs.shard(table(spark, d, "documents").select("doc_id"), "doc_id", 3, 4)


@query("resume_pending", "select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity = 50)")
def resume_pending(spark, d):
    done = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return jobs.pending(table(spark, d, "part").select("p_partkey"), done, "p_partkey")


@query(
    "tiles",
    """with n as (select 'doc' || doc_id as stem, n_chars / 100.0 as duration, greatest(1, ceil((n_chars / 100.0 - 0.5) / 30))::int as n from documents)
select stem, case when n = 1 then stem else stem || '.t' || lpad(k::varchar, 3, '0') end as name, round((k - 1) * duration / n, 6) as start, round(duration / n, 6) as length from n, lateral (select unnest(range(1, n + 1)) as k)""",
)
def tiles(spark, d):
    s = table(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("stem"), (F.col("n_chars") / 100.0).alias("duration"))
    return jobs.tiles(s, "stem", "duration", 30.0).select("stem", "name", F.round("start", 6).alias("start"), F.round("length", 6).alias("length"))


@query("media_kinds", r"""with p as (select page_id, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) as file from pages)
select case when regexp_extract(file, '\.([a-z0-9]+)$', 1) = '' then 'none' else regexp_extract(file, '\.([a-z0-9]+)$', 1) end as ext, count(*) as files, count(distinct regexp_replace(file, '\.[a-z0-9]+$', '')) as stems from p group by 1""")
def media_kinds(spark, d):
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1).alias("file"))
    ext = F.regexp_extract("file", r"\.([a-z0-9]+)$", 1)
    return p.groupBy(F.when(ext == "", "none").otherwise(ext).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.countDistinct(F.regexp_replace("file", r"\.[a-z0-9]+$", "")).alias("stems"))


@query("same_content", "select md5(text) as digest, count(*) as files, min(doc_id) as first from documents group by 1 having count(*) > 1")
def same_content(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("files"), F.min("doc_id").alias("first")).where("files > 1")


@query("magic_bytes", "select page_id, upper(substr(hex(encode(html)), 1, 6)) as magic, upper(substr(hex(encode(html)), 1, 6)) = 'FFD8FF' as lossless from pages")
def magic_bytes(spark, d):
    magic = F.hex(F.substring(F.col("html").cast("binary"), 1, 3))
    return table(spark, d, "pages").select("page_id", magic.alias("magic"), (magic == "FFD8FF").alias("lossless"))


LINES = r"""with lines as (select 'seg' || (o_custkey % 7) as segment,
  'found ' || (o_orderkey % 9) || ' (' || case when o_orderstatus = 'F' then 'faint, regular' else 'faint' end || ': 1 of 9): ' || ['upper left', 'middle centre', 'lower right'][(o_orderkey % 3 + 1)::int]
  || ' (x 1%-2%) repeats ' || ((o_orderkey % 40) * 0.05)::decimal(6,2) || ' times a second in ' || case when o_orderkey % 2 = 0 then 'brightness' else 'shift-across' end || ', ' || case when o_orderkey % 5 = 0 then 'printed clock' else '' end as line from orders)"""


def report_lines(spark, d):
    o = table(spark, d, "orders")
    pick = F.element_at(F.array(*[F.lit(x) for x in ("upper left", "middle centre", "lower right")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    line = F.concat(
        F.lit("found "), (F.col("o_orderkey") % 9).cast("string"), F.lit(" ("), F.when(F.col("o_orderstatus") == "F", "faint, regular").otherwise("faint"), F.lit(": 1 of 9): "), pick,
        F.lit(" (x 1%-2%) repeats "), ((F.col("o_orderkey") % 40) * F.lit(0.05)).cast("decimal(6,2)").cast("string"), F.lit(" times a second in "),
        F.when(F.col("o_orderkey") % 2 == 0, "brightness").otherwise("shift-across"), F.lit(", "), F.when(F.col("o_orderkey") % 5 == 0, "printed clock").otherwise(""),
    )
    return o.select(F.concat(F.lit("seg"), (F.col("o_custkey") % 7).cast("string")).alias("segment"), line.alias("line"))


@query(
    "hidden_tally_regex",
    LINES + r""", r as (select segment, round(round_even(regexp_extract(line, 'repeats ([\d.]+) times', 1)::double / 0.02, 0) * 0.02, 6) as rate,
  regexp_extract(line, '\): (\w+ \w+) \(x', 1) || case when contains(line, 'printed clock') then ' (clock)' else '' end || ' in ' || regexp_extract(line, ' in ([a-z-]+),', 1) as place from lines)
select rate, count(distinct segment) as segments, array_to_string(list_sort(list(distinct place)), '; ') as places from r group by 1""",
)
def hidden_tally_regex(spark, d):
    return findings.tally(report_lines(spark, d))


@query("place_words", "with c as (select s_suppkey, (s_acctbal + 1000) / 11000 as x, (s_nationkey + 0.5) / 25 as y from supplier) select s_suppkey, ['upper', 'middle', 'lower'][least(2, floor(y * 3)::int) + 1] || ' ' || ['left', 'centre', 'right'][least(2, floor(x * 3)::int) + 1] as place from c")
def place_words(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", numbers.place_words((F.col("s_acctbal") + 1000) / 11000, (F.col("s_nationkey") + 0.5) / 25).alias("place"))


def boxes(spark, d):
    c = table(spark, d, "customer")
    x, y = (F.col("c_acctbal") + 1000) / 11000, (F.col("c_nationkey") + 0.5) / 25
    return c.select(
        F.floor(F.col("c_custkey") / 40).alias("clip"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("lens"), (x - 0.05).alias("x0"), (y - 0.05).alias("y0"), (x + 0.05).alias("x1"), (y + 0.05).alias("y1"),
        F.when(F.col("c_custkey") % 5 != 0, 1 + F.col("c_custkey") % 7 / 4).alias("rate"),
    )


@query(
    "finding_overlap",
    """with b as (select c_custkey // 40 as clip, c_custkey as id, c_mktsegment as lens, (c_acctbal + 1000) / 11000 as x, (c_nationkey + 0.5) / 25 as y, case when c_custkey % 5 <> 0 then 1 + c_custkey % 7 / 4 end as rate from customer),
p as (select a.clip, a.id as a_id, b.id as b_id, a.rate as r, b.rate as s, a.x - 0.05 < b.x + 0.05 and b.x - 0.05 < a.x + 0.05 and a.y - 0.05 < b.y + 0.05 and b.y - 0.05 < a.y + 0.05 as overlap, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 0.15 as close
  from b a join b on a.clip = b.clip and a.id < b.id and a.lens <> b.lens)
select clip, a_id, b_id from p where (overlap or close) and (r is null or s is null or abs(r - s) <= 0.2 * greatest(r, s) or abs(r - 2 * s) <= 0.2 * greatest(r, 2 * s) or abs(r - s / 2) <= 0.2 * greatest(r, s / 2))""",
)
def finding_overlap(spark, d):
    return findings.agreeing_pairs(boxes(spark, d), "clip")


@query(
    "tile_components",
    """with recursive t as (select distinct on (c_nationkey, x) c_nationkey as y, floor((c_acctbal + 1000) / 500)::bigint as x, c_custkey as tile, c_custkey % 4 as rate
  from (select *, floor((c_acctbal + 1000) / 500)::bigint as x from customer) order by c_nationkey, x, c_custkey),
e as (select a.tile as a, b.tile as b from t a join t b on abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and a.tile <> b.tile and abs(a.rate - b.rate) <= 0.5),
r(a, b) as (select tile, tile from t union select r.a, e.b from r join e on r.b = e.a)
select a as tile, min(b) as region from r group by 1""",
)
def tile_components(spark, d):
    c = table(spark, d, "customer").withColumn("x", F.floor((F.col("c_acctbal") + 1000) / 500))
    first = c.groupBy(F.col("c_nationkey").alias("y"), "x").agg(F.min("c_custkey").alias("tile"))
    t = first.select(F.lit(1).alias("clip"), "y", "x", "tile", (F.col("tile") % 4).cast("double").alias("rate"))
    return findings.tile_components(t, "clip", 0.5).select("tile", "region")


@query("patch_means", "with p as (select vec_id, unnest(range(0, len(embedding))) as col, unnest(embedding)::double as x from embeddings) select vec_id, (col // 8)::int as y, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as deviation from p group by 1, 2")
def patch_means(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "x")).withColumn("x", F.col("x").cast("double"))
    return p.groupBy("vec_id", F.floor(F.col("col") / 8).cast("int").alias("y")).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("deviation"))


@query("sidecar_join", "select p.page_id, coalesce(d.source, 'grey') as sidecar from pages p left join documents d on p.page_id * 7 = d.doc_id and d.lang = 'fr'")
def sidecar_join(spark, d):
    s = table(spark, d, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("k"), "source")
    p = table(spark, d, "pages").select("page_id")
    return p.join(s, F.col("page_id") * 7 == F.col("k"), "left").select("page_id", F.coalesce("source", F.lit("grey")).alias("sidecar"))


@query("source_union", "select kind, count(*) as n, count(distinct stem) as stems from (select 'page' as kind, page_id as stem from pages union all select 'document', doc_id from documents) group by 1")
def source_union(spark, d):
    p, s = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("stem")), table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("stem"))
    return p.unionByName(s).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("stem").alias("stems"))


@query("duplicate_stems", "select source || '-' || lang as stem, count(*) as n from documents group by 1 having count(*) > 1")
def duplicate_stems(spark, d):
    return table(spark, d, "documents").groupBy(F.concat("source", F.lit("-"), "lang").alias("stem")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("prop_options", "select event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) as first_option from events")
def prop_options(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.element_at(F.from_json("props", "map<string,string>"), F.element_at(F.json_object_keys("props"), 1)).alias("first_option"))


