"""Queries on the events table: an unevenly timed signal with keys user_id and event_type."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavegrid.functions import music
from wavegrid.functions.tables import SCALES
from wavegrid.operators import normalise, notes, series, spectrum
from wavegrid.plans.catalog import query, table

HOUR = 3_600_000_000
PENT = SCALES["minor_pent"]
#: Hours covered by the spectra, a fixed length so that bins mean the same at every size.
LENGTH, BINS = 720, 60


def events(spark, d):
    return table(spark, d, "events").withColumns({"t": series.seconds(F.col("ts")), "hour": F.floor(series.micros(F.col("ts")) / HOUR).cast("long")})


EV = "with ev as (select *, epoch_us(ts) / 1e6 as t, epoch_us(ts) // 3600000000 as hour from events)"


def hourly(spark, d):
    """Mean value of each event type in each hour, with the pitch that it stands for."""
    return events(spark, d).groupBy("event_type", "hour").agg(F.avg("value").alias("weight")).withColumn("hz", 110.0 + F.col("weight"))


HOURLY = EV + ", hourly as (select event_type, hour, avg(value) as weight, 110.0 + avg(value) as hz from ev group by all)"


def sql_nearest(x: str, candidates: list) -> str:
    """SQL: the candidate nearest to x, the first of equals."""
    return f"(list_transform(list_sort(list_transform([{', '.join(map(str, range(len(candidates))))}], lambda i: {{'d': abs({x} - [{', '.join(map(str, candidates))}][i + 1]), 'i': i}})), lambda s: [{', '.join(map(str, candidates))}][s.i + 1]))[1]"


def sql_midi(hz: str) -> str:
    return f"(69.0 + 12.0 * log2(greatest({hz}, 1e-6) / 440.0))"


def sql_snap(midi: str, root: int, scale: list[int]) -> str:
    rel = f"({midi} - {root})"
    return f"({root} + floor({rel} / 12.0) * 12 + {sql_nearest(f'({rel} - floor({rel} / 12.0) * 12.0)', [*scale, 12])})::int"


def sql_pitch(hz: str) -> str:
    return f"round(440.0 * pow(2.0, (least(greatest({sql_snap(sql_midi(hz), 45, PENT)}, 21), 108) - 69.0) / 12.0), 3)"


VOICES = (
    HOURLY
    + f""", voices as (select * from (select *, row_number() over (partition by hour order by weight desc, hz) as voice from hourly) where voice <= 3),
pitched as (select *, {sql_pitch("hz")} as pitch from voices),
loud as (select hour, pitch, max(weight) as w from pitched group by all),
runs as (select *, hour - row_number() over (partition by pitch order by hour) as run, max(w) over () as top from loud),
notes as (select min(hour) * 4 / 8 as start_beat, count(*) * 4 / 8 as dur_beats, pitch as freq_hz,
  least(greatest(floor(30 + 97 * max(w) / max(top)), 1), 127)::int as velocity from runs group by pitch, run)"""
)


def transcribed(spark, d):
    loudest = notes.top_voices(hourly(spark, d), "hour", "hz", "weight", 3)
    return notes.merged(notes.snapped(loudest, "hz", 45, PENT), "hour", "pitch", "weight", grid=8)


@query("transcribe_notes", VOICES + " select * from notes")
def transcribe_notes(spark, d):
    return transcribed(spark, d)


@query("step_spectrum_mean", HOURLY + " select event_type, hour, round(weight, 6) as weight from hourly")
def step_spectrum_mean(spark, d):
    return hourly(spark, d).select("event_type", "hour", F.round("weight", 6).alias("weight"))


@query("top_voices_per_step", VOICES + " select event_type, hour, voice, round(weight, 6) as weight from voices")
def top_voices_per_step(spark, d):
    return notes.top_voices(hourly(spark, d), "hour", "hz", "weight", 3).select("event_type", "hour", F.col("voice").cast("long"), F.round("weight", 6).alias("weight"))


@query(
    "merge_sustained_notes",
    EV + """, loud as (select event_type, hour, value as pitch, max(value) as w from (select event_type, hour, floor(value / 20) as value from ev) group by all),
runs as (select *, hour - row_number() over (partition by event_type, pitch order by hour) as run, max(w) over (partition by event_type) as top from loud)
select event_type, min(hour) * 4 / 8 as start_beat, count(*) * 4 / 8 as dur_beats, pitch::bigint as freq_hz, least(greatest(floor(30 + 97 * max(w) / max(top)), 1), 127)::int as velocity
from runs group by event_type, pitch, run""",
)
def merge_sustained_notes(spark, d):
    e = events(spark, d).withColumn("pitch", F.floor(F.col("value") / 20)).withColumn("w", F.col("pitch"))
    return notes.merged(e, "hour", "pitch", "w", grid=8, by=["event_type"])


@query(
    "verify_metrics",
    VOICES + f""", m as (select freq_hz, start_beat + dur_beats as finish, abs(100 * ({sql_midi("freq_hz")} - round_even({sql_midi("freq_hz")}, 0))) as cents from notes)
select 1 as report, count(distinct round(freq_hz, 1)) as distinct_pitches, count(*) as notes, round(avg(cents), 6) as mean_cents, round(max(cents), 6) as max_cents,
  round(count(*) / greatest(max(finish), 1e-9), 9) as note_density, round(log2(greatest(count(distinct round(freq_hz, 1)), 2)), 6) as bits_per_note from m""",
)
def verify_metrics(spark, d):
    n = transcribed(spark, d).withColumns({"report": F.lit(1), "finish": F.col("start_beat") + F.col("dur_beats")})
    m = notes.measures(n, ["report"], "freq_hz", "finish")
    return m.select("report", "distinct_pitches", "notes", *[F.round(c, 6).alias(c) for c in ("mean_cents", "max_cents", "bits_per_note")], F.round("note_density", 9).alias("note_density"))


@query(
    "midi_events",
    VOICES + f""", e as (
  select round_even({sql_midi("freq_hz")}, 0)::int as midi, floor(start_beat * 480)::bigint as tick, 1 as kind, velocity from notes
  union all select round_even({sql_midi("freq_hz")}, 0)::int, floor((start_beat + dur_beats) * 480)::bigint, 0, 0 from notes)
select 1 as track, midi, tick, kind, velocity, row_number() over (order by tick, kind, midi, velocity) as place from e""",
)
def midi_events(spark, d):
    e = notes.midi_events(transcribed(spark, d), []).withColumn("track", F.lit(1))
    return e.withColumn("place", F.col("place").cast("long"))


@query(
    "reveal_score",
    EV + """, m as (select event_type, median(value) as median from ev group by 1),
o as (select event_id, ev.event_type, value, m.median, abs(value - m.median) as off from ev join m using (event_type)),
a as (select event_type, median(off) as mad from o group by 1)
select event_id, event_type, round(least(greatest((value - median) / greatest(1.4826 * mad, 1e-9), -6), 6), 6) as score from o join a using (event_type)""",
)
def reveal_score(spark, d):
    return normalise.robust_scores(events(spark, d), "event_type", "value").select("event_id", "event_type", F.round("score", 6).alias("score"))


DELTA = EV + ", d as (select *, greatest(abs(value - lag(value) over w) - 5.0, 0) as delta, lag(value) over w as before from ev window w as (partition by user_id order by t, event_id)), deltas as (select * from d where before is not null)"


def moved(spark, d):
    return series.deltas(events(spark, d), "user_id", ["t", "event_id"], floor=5.0)


@query("motion_deltas", DELTA + " select event_id, user_id, round(delta, 6) as delta from deltas")
def motion_deltas(spark, d):
    return moved(spark, d).select("event_id", "user_id", F.round("delta", 6).alias("delta"))


@query(
    "scale_to_unit",
    DELTA + """, p as (select user_id, quantile_cont(delta, 0.995) as p from deltas where delta > 0 group by 1)
select event_id, user_id, round(least(delta / greatest(coalesce(p, 0), 1e-6), 1), 6) as v from deltas left join p using (user_id)""",
)
def scale_to_unit(spark, d):
    return normalise.scaled_to_unit(moved(spark, d), "user_id", "delta").select("event_id", "user_id", F.round("v", 6).alias("v"))


@query("moving_steps", DELTA + " select hour, round(avg((delta > 0)::int), 6) as moving, count(*) as samples from deltas group by hour having avg((delta > 0)::int) > 0.7")
def moving_steps(spark, d):
    share = moved(spark, d).groupBy("hour").agg(F.avg((F.col("delta") > 0).cast("int")).alias("moving"), F.count(F.lit(1)).alias("samples"))
    return share.where("moving > 0.7").select("hour", F.round("moving", 6).alias("moving"), "samples")


@query("motion_profile", DELTA + " select event_type, hour, round(avg(delta), 6) as motion from deltas group by all")
def motion_profile(spark, d):
    return moved(spark, d).groupBy("event_type", "hour").agg(F.round(F.avg("delta"), 6).alias("motion"))


@query(
    "frame_skips",
    EV + """, g as (select user_id, event_id, t - lag(t) over (partition by user_id order by t, event_id) as gap from ev),
m as (select user_id, median(gap) as median_gap from g where gap is not null group by 1)
select event_id, user_id, round(gap, 6) as gap from g join m using (user_id) where gap > greatest(0.5, 4 * median_gap)""",
)
def frame_skips(spark, d):
    return series.skips(events(spark, d), "user_id").select("event_id", "user_id", F.round("gap", 6).alias("gap"))


@query(
    "gap_stats",
    EV + """, g as (select user_id, t - lag(t) over (partition by user_id order by t, event_id) as gap from ev)
select user_id, round(min(gap), 6) as least, round(median(gap), 6) as median, round(max(gap), 6) as most from g where gap is not null group by 1""",
)
def gap_stats(spark, d):
    g = series.gap_stats(events(spark, d), "user_id")
    return g.select("user_id", *[F.round(c, 6).alias(c) for c in ("least", "median", "most")])


BURST = EV + """, b as (select *, case when t - lag(t) over w > 1800 then 1 else 0 end as begins from ev window w as (partition by user_id order by t, event_id)),
n as (select *, sum(begins) over (partition by user_id order by t, event_id rows unbounded preceding)::bigint as burst from b)"""


@query("busy_sessions", BURST + " select user_id, burst, round(min(t), 6) as first, round(max(t), 6) as last, count(*) as samples from n group by 1, 2")
def busy_sessions(spark, d):
    b = series.bursts(events(spark, d), "user_id", 1800.0)
    return b.select("user_id", "burst", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), "samples")


@query("session_window_counts", BURST + " select user_id, sessions, count(*) as users from (select user_id, count(distinct burst) as sessions from n group by 1) group by 1, 2")
def session_window_counts(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "1800 seconds")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions")).withColumn("users", F.lit(1).cast("long"))


@query(
    "step_outliers",
    HOURLY + """, c as (select event_type, hour, abs(weight - lag(weight) over (partition by event_type order by hour)) as change from hourly),
m as (select event_type, median(change) as typical from c where change is not null group by 1),
r as (select hour, change / greatest(typical, 0.5) as ratio from c join m using (event_type) where change is not null)
select hour, round(median(ratio), 6) as ratio, count(*) as tiles from r group by 1 having median(ratio) > 2""",
)
def step_outliers(spark, d):
    return series.step_outliers(hourly(spark, d), "event_type", "hour", "weight", 2.0).select("hour", F.round("ratio", 6).alias("ratio"), "tiles")


@query(
    "onsets",
    HOURLY + """, r as (select event_type, hour, ln(weight) - lag(ln(weight)) over (partition by event_type order by hour) as rise from hourly),
s as (select event_type, hour, greatest(rise, 0) as strength from r where rise is not null),
b as (select event_type, median(strength) + 3 * stddev_pop(strength) as bar from s group by 1),
n as (select *, coalesce(lag(strength) over w, 0) as a, coalesce(lead(strength) over w, 0) as z from s window w as (partition by event_type order by hour))
select n.event_type, hour, round(strength, 6) as strength from n join b using (event_type) where strength > bar and strength > a and strength >= z""",
)
def onsets(spark, d):
    return series.onsets(hourly(spark, d), "event_type", ["hour"], "weight").select("event_type", "hour", F.round("strength", 6).alias("strength"))


@query(
    "turnarounds",
    EV + """, n as (select event_id, user_id, value, (value - lag(value) over w) * (lead(value) over w - value) as turn,
  abs(value - median(value) over (partition by user_id order by t, event_id rows between 40 preceding and 39 following)) as depth
  from ev window w as (partition by user_id order by t, event_id))
select event_id, user_id, round(depth, 6) as depth from n where turn < 0 and depth > 30""",
)
def turnarounds(spark, d):
    r = series.turn_arounds(events(spark, d), "user_id", ["t", "event_id"]).where("depth > 30")
    return r.select("event_id", "user_id", F.round("depth", 6).alias("depth"))


@query("cumulative_shift", EV + " select event_id, user_id, round(sum(value) over (partition by user_id order by t, event_id rows unbounded preceding), 4) as shift from ev")
def cumulative_shift(spark, d):
    return series.running_sum(events(spark, d), "user_id", ["t", "event_id"], "value", "shift").select("event_id", "user_id", F.round("shift", 4).alias("shift"))


@query("moving_average", EV + " select event_id, user_id, round(avg(value) over (partition by user_id order by t, event_id rows between 7 preceding and 7 following), 6) as smooth from ev")
def moving_average(spark, d):
    return series.moving_average(events(spark, d), "user_id", ["t", "event_id"], "value", 7).select("event_id", "user_id", F.round("smooth", 6).alias("smooth"))


@query("moving_average_ends", EV + """, o as (select *, row_number() over w as i, count(*) over (partition by user_id) as n, first_value(value) over w as a, last_value(value) over (partition by user_id order by t, event_id rows between unbounded preceding and unbounded following) as b,
  sum(value) over (partition by user_id order by t, event_id rows between 3 preceding and 3 following) as s from ev window w as (partition by user_id order by t, event_id))
select event_id, round(s / 7, 6) as same, round((s + greatest(0, 4 - i) * a + greatest(0, 4 - (n - i + 1)) * b) / 7, 6) as held from o""")
def moving_average_ends(spark, d):
    order = ["t", "event_id"]
    out = series.moving_average(events(spark, d), "user_id", order, "value", 3, "same", "same")
    return series.moving_average(out, "user_id", order, "value", 3, "held", "hold").select("event_id", F.round("same", 6).alias("same"), F.round("held", 6).alias("held"))


DAY = 86400.0


@query(
    "phase_concentration",
    EV + f""", a as (select user_id, avg(cos(2 * pi() * {1 / DAY!r} * (t - 1704067200))) as c, avg(sin(2 * pi() * {1 / DAY!r} * (t - 1704067200))) as s from ev group by 1)
select user_id, round(sqrt(c * c + s * s), 6) as length, round(atan2(s, c), 5) as angle from a""",
)
def phase_concentration(spark, d):
    e = events(spark, d).withColumn("t", F.col("t") - 1704067200)
    p = spectrum.phase_concentration(e, "user_id", "t", 1 / DAY)
    return p.select("user_id", F.round("length", 6).alias("length"), F.round("angle", 5).alias("angle"))


SPECTRUM = (
    HOURLY
    + f""", x as (select event_type, hour % {LENGTH} as h, weight - avg(weight) over (partition by event_type) as x from hourly),
f as (select event_type, bin, sum(x * cos(2 * pi() * ((bin * h) % {LENGTH}) / {LENGTH})) as re, sum(x * sin(2 * pi() * ((bin * h) % {LENGTH}) / {LENGTH})) as im
  from x, range(1, {BINS + 1}) b(bin) group by 1, 2),
spectrum as (select event_type, bin::int as bin, re * re + im * im as power from f)"""
)


def power(spark, d):
    h = hourly(spark, d).withColumn("h", F.col("hour") % LENGTH)
    return spectrum.dft_power(h, "event_type", "h", "weight", BINS, LENGTH)


@query("dft_power", SPECTRUM + " select event_type, bin, round(power, 3) as power from spectrum")
def dft_power(spark, d):
    return power(spark, d).select("event_type", "bin", F.round("power", 3).alias("power"))


@query(
    "hann_periodogram",
    HOURLY + f""", x as (select event_type, hour % {LENGTH} as h, (weight - avg(weight) over (partition by event_type)) * (0.5 - 0.5 * cos(2 * pi() * (hour % {LENGTH}) / {LENGTH - 1})) as x from hourly),
f as (select event_type, bin::int as bin, sum(x * cos(2 * pi() * ((bin * h) % {LENGTH}) / {LENGTH})) as re, sum(x * sin(2 * pi() * ((bin * h) % {LENGTH}) / {LENGTH})) as im
  from x, range(1, {BINS + 1}) b(bin) group by 1, 2)
select event_type, bin, round(re * re + im * im, 3) as power from f""",
)
def hann_periodogram(spark, d):
    h = hourly(spark, d).withColumn("h", F.col("hour") % LENGTH)
    return spectrum.dft_power(h, "event_type", "h", "weight", BINS, LENGTH, hann=True).select("event_type", "bin", F.round("power", 3).alias("power"))


SEGMENTS = f"""{HOURLY}, s as (select event_type, hour // 240 as segment, hour % 240 as h, weight from hourly),
x as (select *, weight - avg(weight) over (partition by event_type, segment) as x from s),
f as (select event_type, segment, bin::int as bin, sum(x * cos(2 * pi() * ((bin * h) % 240) / 240)) as re, sum(x * sin(2 * pi() * ((bin * h) % 240) / 240)) as im
  from x, range(1, 21) b(bin) group by 1, 2, 3)
select event_type, bin, round(avg(re * re + im * im), 3) as power, count(*) as segments from f group by 1, 2"""


@query("welch_like_segments", SEGMENTS)
def welch_like_segments(spark, d):
    h = hourly(spark, d).withColumns({"segment": F.floor(F.col("hour") / 240), "h": F.col("hour") % 240})
    h = h.withColumn("part", F.concat_ws(":", "event_type", "segment"))
    p = spectrum.dft_power(h, "part", "h", "weight", 20, 240)
    p = p.withColumn("event_type", F.substring_index("part", ":", 1))
    return p.groupBy("event_type", "bin").agg(F.round(F.avg("power"), 3).alias("power"), F.count(F.lit(1)).alias("segments"))


PEAK_SQL = ", p as (select *, lag(power) over w as a, lead(power) over w as z from spectrum window w as (partition by event_type order by bin))"


@query("peak_rates", SPECTRUM + PEAK_SQL + " select event_type, bin, round(power, 3) as power from p where power > a and power > z")
def peak_rates(spark, d):
    return spectrum.peaks(power(spark, d), "event_type", "bin", "power").select("event_type", "bin", F.round("power", 3).alias("power"))


@query("peak_rates_left_rule", SPECTRUM + PEAK_SQL + " select event_type, bin, round(power, 3) as power from p where power > a and power >= z and power > 100")
def peak_rates_left_rule(spark, d):
    return spectrum.peaks(power(spark, d), "event_type", "bin", "power", rule="floor", floor=100.0).select("event_type", "bin", F.round("power", 3).alias("power"))


@query(
    "refined_peaks",
    SPECTRUM + PEAK_SQL + " select event_type, bin, round(case when abs(a - 2 * power + z) > 1e-12 then 0.5 * (a - z) / (a - 2 * power + z) else 0 end, 4) as shift from p where power > a and power > z",
)
def refined_peaks(spark, d):
    r = spectrum.refined(power(spark, d), "event_type", "bin", "power")
    return spectrum.peaks(r, "event_type", "bin", "power").select("event_type", "bin", F.round("shift", 4).alias("shift"))


RATIO = (
    SPECTRUM
    + """, sides as (select a.event_type, a.bin, a.power, list(b.power order by abs(b.bin - a.bin)) filter (b.bin < a.bin) as l, list(b.power order by abs(b.bin - a.bin)) filter (b.bin > a.bin) as r
  from spectrum a join spectrum b on a.event_type = b.event_type and abs(a.bin - b.bin) between 3 and 15 group by 1, 2, 3),
sized as (select *, least(coalesce(len(l), 0), coalesce(len(r), 0)) as n from sides),
ratios as (select event_type, bin, power, power / greatest(list_median(list_concat(l[1:n], r[1:n])), 1e-12) as ratio from sized where n >= 4)"""
).replace("list_median(", "list_aggregate(").replace("r[1:n])), 1e-12", "r[1:n]), 'median'), 1e-12")


def ratios(spark, d):
    return spectrum.local_ratio(power(spark, d), "event_type", "bin", "power")


@query("local_ratio", RATIO + " select event_type, bin, round(ratio, 5) as ratio from ratios")
def local_ratio(spark, d):
    return ratios(spark, d).select("event_type", "bin", F.round("ratio", 5).alias("ratio"))


@query("luck", RATIO + " select event_type, max(ratio) > 5 as clear, round(least(1, 46 * pow(2.0, -max(ratio))), 6) as chance from ratios group by 1")
def luck(spark, d):
    best = ratios(spark, d).groupBy("event_type").agg(F.max("ratio").alias("r"))
    return best.select("event_type", (F.col("r") > 5).alias("clear"), F.round(spectrum.luck(F.col("r"), 46), 6).alias("chance"))


@query(
    "line_share",
    SPECTRUM + " select event_type, bin, round(sum(power) over (partition by event_type order by bin rows between 2 preceding and 2 following) / sum(power) over (partition by event_type), 6) as share from spectrum",
)
def line_share(spark, d):
    return spectrum.line_share(power(spark, d), "event_type", "bin", "power").select("event_type", "bin", F.round("share", 6).alias("share"))


BEST = RATIO + ", best as (select event_type, bin from (select *, row_number() over (partition by event_type order by ratio desc, bin) as n from ratios) where n <= 12)"


def best(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy(F.col("ratio").desc(), "bin")
    return ratios(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 12").select("event_type", "bin")


@query(
    "shared_rates",
    BEST + " select bin, round(share, 6) as share from (select bin, count(distinct event_type) / (select count(distinct event_type) from best) as share from best group by 1) where share > 0.3",
)
def shared_rates(spark, d):
    return spectrum.common_rates(best(spark, d), "event_type", "bin", 0.3).select("bin", F.round("share", 6).alias("share"))


@query(
    "rates_not_shared",
    BEST + """, shared as (select bin from (select bin, count(distinct event_type) / (select count(distinct event_type) from best) as share from best group by 1) where share > 0.5)
select event_type, bin from best where not exists (select 1 from shared where abs(shared.bin - best.bin) <= 1)""",
)
def rates_not_shared(spark, d):
    b = best(spark, d)
    return spectrum.not_near(b, spectrum.common_rates(b, "event_type", "bin", 0.5), "bin", 1.0)


BASES = [round(0.01 * k, 2) for k in range(5, 21)]


@query(
    "camera_comb",
    BEST + f""", t as (select base, bin / 60.0 as rate from (select distinct bin from best), unnest({BASES}::double[]) b(base)),
h as (select base, count(*) as multiples from t where round_even(rate / base, 0) >= 1 and abs(rate - round_even(rate / base, 0) * base) <= 0.004 group by 1 having count(*) >= 4)
select base, multiples from h order by multiples desc, base limit 1""",
)
def camera_comb(spark, d):
    rates = best(spark, d).select("bin").distinct().withColumn("rate", F.col("bin") / 60.0)
    return spectrum.comb(rates, "rate", BASES, 0.004)


@query(
    "comb_multiples",
    BEST + f""", r as (select distinct bin / 60.0 as rate from best),
t as (select base, rate from r, unnest({BASES}::double[]) b(base)),
h as (select base, count(*) as multiples from t where round_even(rate / base, 0) >= 1 and abs(rate - round_even(rate / base, 0) * base) <= 0.004 group by 1 having count(*) >= 4),
b as (select base from h order by multiples desc, base limit 1)
select round(rate, 6) as rate, min(m)::int as m from r, b, range(1, 4) t(m)
where round_even(rate * m / base, 0) >= 1 and abs(rate * m - round_even(rate * m / base, 0) * base) <= 0.004 group by 1""",
)
def comb_multiples(spark, d):
    """Which rates are multiples, halves or thirds of multiples, of the base that the rates themselves give."""
    rates = best(spark, d).select("bin").distinct().select((F.col("bin") / 60.0).alias("rate"))
    found = spectrum.multiples_of(rates, "rate", spectrum.comb(rates, "rate", BASES, 0.004), 0.004)
    return found.select(F.round("rate", 6).alias("rate"), "m")


@query(
    "sinusoid_fit",
    EV + f""", x as (select user_id, value - avg(value) over (partition by user_id) as x, sin(2 * pi() * {1 / DAY!r} * (t - 1704067200)) as s, cos(2 * pi() * {1 / DAY!r} * (t - 1704067200)) as c from ev),
m as (select user_id, sum(s * s) as ss, sum(s * c) as sc, sum(c * c) as cc, sum(x * s) as xs, sum(x * c) as xc from x group by 1)
select user_id, round(sqrt(pow((xs * cc - xc * sc) / (ss * cc - sc * sc), 2) + pow((xc * ss - xs * sc) / (ss * cc - sc * sc), 2)), 5) as amplitude from m where abs(ss * cc - sc * sc) > 1e-9""",
)
def sinusoid_fit(spark, d):
    e = events(spark, d).withColumn("t", F.col("t") - 1704067200)
    return spectrum.sine_fit(e, "user_id", "t", "value", 1 / DAY).select("user_id", F.round("amplitude", 5).alias("amplitude"))


@query("trend_db", EV + " select user_id, round(regr_slope(20 * log10(value), (t - 1704067200) / 86400), 8) as slope from ev where value > 0 group by 1")
def trend_db(spark, d):
    e = events(spark, d).where("value > 0").withColumns({"db": 20 * F.log10("value"), "day": (F.col("t") - 1704067200) / 86400})
    return e.groupBy("user_id").agg(F.round(F.regr_slope("db", "day"), 8).alias("slope"))


RATES = [k / DAY / 7 for k in range(1, 22)]


@query(
    "lomb_scargle",
    EV + f""", x as (select user_id, t - 1704067200 as t, value - avg(value) over (partition by user_id) as x from ev),
y as (select user_id, k, x, sin(2 * pi() * (k / 86400.0 / 7) * t) as s, cos(2 * pi() * (k / 86400.0 / 7) * t) as c from x, range(1, 22) r(k)),
m as (select user_id, k, sum(s * s) as ss, sum(s * c) as sc, sum(c * c) as cc, sum(x * s) as xs, sum(x * c) as xc, sum(x * x) as xx from y group by 1, 2),
h as (select *, cos(0.5 * atan2(2 * sc, cc - ss)) as co, sin(0.5 * atan2(2 * sc, cc - ss)) as si from m)
select user_id, k::int as k, round((pow(xc * co + xs * si, 2) / greatest(cc * co * co + ss * si * si + 2 * sc * co * si, 1e-12)
  + pow(xs * co - xc * si, 2) / greatest(ss * co * co + cc * si * si - 2 * sc * co * si, 1e-12)) / xx, 5) as power from h where xx > 0""",
)
def lomb_scargle(spark, d):
    e = events(spark, d).withColumn("t", F.col("t") - 1704067200)
    p = spectrum.lomb_scargle(e, "user_id", "t", "value", RATES)
    return p.select("user_id", F.bround(F.col("rate") * DAY * 7).cast("int").alias("k"), F.round("power", 5).alias("power"))


@query(
    "even_clock_interp",
    EV + """, o as (select user_id, t, arg_max(value, event_id) as value from ev group by 1, 2),
g as (select *, lead(t) over w as t1, lead(value) over w as v1 from o window w as (partition by user_id order by t)),
k as (select *, unnest(range(ceil(t / 1800)::bigint, ceil(t1 / 1800)::bigint)) as tick from g where t1 is not null)
select user_id, tick, round(value + (tick * 1800.0 - t) / (t1 - t) * (v1 - value), 5) as value from k""",
)
def even_clock_interp(spark, d):
    return series.on_even_clock(events(spark, d), "user_id", 1800.0).select("user_id", "tick", F.round("value", 5).alias("value"))


@query(
    "held_clock",
    EV + """, o as (select user_id, t, arg_max(value, event_id) as value from ev group by 1, 2),
g as (select *, lead(t) over w as t1, lead(value) over w as v1 from o window w as (partition by user_id order by t)),
e as (select user_id, min(t) as a, max(t) as b, arg_min(value, t) as va, arg_max(value, t) as vb from o group by 1),
k as (select *, unnest(range(ceil(t / 86400)::bigint, ceil(t1 / 86400)::bigint)) as tick from g where t1 is not null),
every as (select user_id, tick, value + (tick * 86400.0 - t) / (t1 - t) * (v1 - value) as value from k
  union all select user_id, unnest(range(19700, ceil(a / 86400)::bigint)), va from e union all select user_id, unnest(range(ceil(b / 86400)::bigint, 19801)), vb from e)
select user_id, tick, round(value, 5) as value from every where tick between 19700 and 19800""",
)
def held_clock(spark, d):
    """A daily clock that begins before and ends after the events."""
    return series.on_even_clock(events(spark, d), "user_id", 86400.0, held=(19700, 19800)).select("user_id", "tick", F.round("value", 5).alias("value"))


@query(
    "nearest_onset",
    EV + """, p as (select event_id, user_id, t from ev where event_type = 'purchase'), c as (select distinct user_id, t as ct from ev where event_type = 'click'),
n as (select event_id, p.user_id, t, ct, row_number() over (partition by event_id order by abs(ct - t), ct) as k from p join c on p.user_id = c.user_id and abs(ct - t) < 3600)
select event_id, user_id, round(ct - t, 6) as away from n where k = 1""",
)
def nearest_onset(spark, d):
    e = events(spark, d)
    n = series.nearest_within(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "user_id", 3600.0)
    return n.select("event_id", "user_id", F.round(F.col("nearest") - F.col("t"), 6).alias("away"))


@query(
    "dry_mix",
    HOURLY + """, m as (select a.hour, a.weight as dry, b.weight as wet from hourly a join hourly b on a.hour = b.hour and a.event_type = 'click' and b.event_type = 'purchase')
select hour, round(0.6 * dry + 0.4 * wet, 6) as mixed from m""",
)
def dry_mix(spark, d):
    h = hourly(spark, d)
    dry, wet = (h.where(F.col("event_type") == k).select("hour", F.col("weight").alias(n)) for k, n in (("click", "dry"), ("purchase", "wet")))
    return dry.join(wet, "hour").select("hour", F.round(0.6 * F.col("dry") + 0.4 * F.col("wet"), 6).alias("mixed"))


@query("layer_mix", HOURLY + " select hour, round(sum(weight) / (select count(distinct event_type) from hourly), 6) as level from hourly group by 1")
def layer_mix(spark, d):
    h = hourly(spark, d)
    layers = h.agg(F.countDistinct("event_type").alias("layers"))
    return h.groupBy("hour").agg(F.sum("weight").alias("s")).crossJoin(F.broadcast(layers)).select("hour", F.round(F.col("s") / F.col("layers"), 6).alias("level"))


@query("note_of_value", EV + f" select event_id, round(100 * ({sql_midi('110.0 + value')} - round_even({sql_midi('110.0 + value')}, 0)), 5) as cents, {sql_snap(sql_midi('110.0 + value'), 45, PENT)} as midi from ev")
def note_of_value(spark, d):
    hz = 110.0 + F.col("value")
    return events(spark, d).select("event_id", F.round(music.cents_off(hz), 5).alias("cents"), music.snap_semitone(music.hz_to_midi(hz), 45, PENT).alias("midi"))


@query(
    "printed_flips",
    DELTA + " select user_id, event_type, count(*) filter (delta > 60) as flips, count(*) as samples from deltas group by 1, 2 having count(*) filter (delta > 60) > 0",
)
def printed_flips(spark, d):
    f = moved(spark, d).groupBy("user_id", "event_type").agg(F.count(F.when(F.col("delta") > 60, 1)).alias("flips"), F.count(F.lit(1)).alias("samples"))
    return f.where("flips > 0")


@query(
    "jitter_lines",
    EV + f""", g as (select event_type, t - lag(t) over w + case when row_number() over w % 24 = 0 then 200000 else 0 end as gap, row_number() over w as n from ev window w as (partition by event_type order by t, event_id)),
j as (select event_type, n % {LENGTH} as h, gap - avg(gap) over (partition by event_type) as x from g where gap is not null),
f as (select event_type, bin::int as bin, sum(x * cos(2 * pi() * ((bin * h) % {LENGTH}) / {LENGTH})) as re, sum(x * sin(2 * pi() * ((bin * h) % {LENGTH}) / {LENGTH})) as im from j, range(1, {BINS + 1}) b(bin) group by 1, 2),
p as (select event_type, bin, re * re + im * im as power from f), m as (select event_type, median(power) as m from p group by 1)
select event_type, bin, round(power / 1e6, 1) as power from p join m using (event_type) where power > 20 * m""",
)
def jitter_lines(spark, d):
    w = Window.partitionBy("event_type").orderBy("t", "event_id")
    n = F.row_number().over(w)  # every 24th gap is long, a beat for the lines to show
    g = events(spark, d).withColumns({"gap": F.col("t") - F.lag("t").over(w) + F.when(n % 24 == 0, 200000).otherwise(0), "h": n % LENGTH}).where("gap is not null")
    p = spectrum.dft_power(g, "event_type", "h", "gap", BINS, LENGTH)
    return spectrum.strong_lines(p, "event_type", 1).select("event_type", "bin", F.round(F.col("power") / 1e6, 1).alias("power"))
