"""Transcription, the stage graph, reports, frame scans, annotated pictures and agreement between lenses."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavegrid.operators import findings, pictures, recurrence, stages, synth, transcription
from wavegrid.operators.ordering import numbered, quantiles, range_of
from wavegrid.sources import frames, png, reports, wav

SR = 8000


def test_transcription_of_known_tones(spark):
    t = np.arange(SR) / SR
    x = np.concatenate([np.sin(2 * np.pi * f * t[: SR // 2]) for f in (220.0, 220.0, 330.0)])
    df = spark.createDataFrame([("s", SR, len(x), k, k * 3000, x[k * 3000 : (k + 1) * 3000].astype(np.float32).tolist()) for k in range(4)], wav.SIGNAL)
    got = transcription.transcribe(df, SR, bpm=120, grid=8, voices=1, lo=100, hi=2000, size=2048, hop=256, semitones=range(12)).orderBy("start_beat").collect()
    assert [round(n.freq_hz) for n in got] == [220, 330] and got[0].start_beat == 0 and got[0].dur_beats == pytest.approx(2, abs=0.5)
    assert got[1].start_beat == pytest.approx(2, abs=0.5) and all(1 <= n.velocity <= 127 for n in got)
    ratio = transcription.transcribe(df, SR, voices=1, lo=100, hi=2000, size=2048, hop=256, ratios=[1, 1.5]).orderBy("start_beat").collect()
    assert [round(n.freq_hz) for n in ratio] == [220, 330]


def test_tunings_of_one_hearing(spark):
    t = np.arange(SR) / SR
    df = spark.createDataFrame([("s", SR, SR, 0, 0, np.sin(2 * np.pi * 300 * t).astype(np.float32).tolist())], wav.SIGNAL)
    loud = transcription.heard(df, 120, 8, 1, 0.2, 100, 2000, 2048, 256).cache()
    out = {r.tuning: round(r.freq_hz, 1) for r in transcription.retuned(loud, SR, {"equal": (range(12), None), "just": (None, [1, 4 / 3, 3 / 2]), "octaves": ([0], None)}).select("tuning", "freq_hz").distinct().collect()}
    assert out == {"equal": 293.7, "just": 293.3, "octaves": 220.0}


def keep(spark, tmp_path):
    def store(stage, df):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{stage}")
        return spark.read.parquet(f"{tmp_path}/{stage}")

    return store


def test_stages_errors_and_resume(spark, tmp_path):
    g = np.zeros((20, 30), np.float32)
    g[8, 3:25] = 1
    rows = [("ok", 20, 30, g.ravel().tolist()), ("blank", 20, 30, (g * 0).ravel().tolist()), ("bad", 20, 30, g.ravel()[:-1].tolist())]
    out = stages.render(spark.createDataFrame(rows, "name string, rows int, cols int, v array<float>"), keep(spark, tmp_path), SR, 20, 30, band=(100.0, 3000.0))
    errors = {r.name: r.error for r in out["encode"].collect()}
    assert errors["ok"] is None and "ValueError" in errors["bad"]
    assert {r.name for r in out["decode"].collect()} == {"ok", "blank"}
    notes = {r.name: r.notes for r in out["notate"].collect()}
    assert notes["ok"] and notes["blank"] == []
    assert {r.name for r in out["notes_decode"].where("error is null").collect()} == {"ok", "blank"}
    sounds = out["encode"].where("error is null")
    played = {r.name: r for r in stages.perform(out["notate"], sounds, sr=SR).collect()}
    length = {r.name: len(r.samples) for r in sounds.collect()}
    assert all(len(played[k].samples) == length[k] for k in length) and max(map(abs, played["blank"].samples)) == 0

    jobs = stages.jobs_of(spark.createDataFrame([("a",), ("b",)], "name string"), ["encode", "decode", "notate", "notes_decode"])
    done = spark.createDataFrame([("a", "encode"), ("a", "notate")], "name string, stage string")
    assert sorted(map(tuple, stages.ready(jobs, done).collect())) == [("a", "decode"), ("a", "notes_decode"), ("b", "encode")]
    assert {r.stage: (r.done, r.to_do) for r in stages.dry_run(jobs, done).collect()} == {"encode": (1, 1), "decode": (0, 2), "notate": (1, 1), "notes_decode": (0, 2)}


def test_recursion_and_shared_encodes(spark, tmp_path):
    g = np.random.default_rng(0).random((12, 16)).astype(np.float32)
    df = spark.createDataFrame([("p", 12, 16, g.ravel().tolist())], "name string, rows int, cols int, v array<float>")
    out = stages.recursion(df, lambda x: x, 2, keep(spark, tmp_path), 12, 16, SR, lo=100.0, hi=3000.0).collect()
    assert sorted(r.step for r in out) == [1, 2] and all(len(r.v) == 192 for r in out)
    v = spark.createDataFrame([("v001", "1.7", "a"), ("v002", "1.7", "b"), ("v003", "2", "a")], "id string, gamma string, scale string")
    assert {r.id: r.shared for r in stages.same_encodes(v, ["gamma"]).collect()} == {"v001": 2, "v002": 2, "v003": 1}


def test_reports_round_trip(spark, tmp_path):
    text = "spectral fidelity  0.612\ndistinct pitches 12 of 40\nnote density 3.5 -> 4.25 bits\npitch residual  mean 6.1 cents"
    m = spark.createDataFrame([("a", "x.png", text), ("b", "y.png", "no notes"), ("c", "z.png", "spectral fidelity 0.4")], "name string, source string, text string").select("name", "source", *reports.metrics(F.col("text")))
    r = {x.name: x for x in m.collect()}
    assert tuple(r["a"])[2:] == (0.612, 12, 40, 3.5, 4.25, 6.1) and all(v is None for v in tuple(r["b"])[2:])
    for variant in ("v001", "v002"):
        reports.write_report(m, f"{tmp_path}/{variant}/report.csv")
        reports.write_report(m, f"{tmp_path}/{variant}/report.csv")  # replaces the first
    back = reports.read_report(spark, f"{tmp_path}/v001/report.csv")
    assert back.columns == reports.REPORT_COLUMNS and back.count() == 3
    s = reports.summary(back).first()
    assert (s["rows"], s.scored, s.least_name, s.most_name) == (3, 2, "c", "a") and s["mean"] == pytest.approx(0.506)
    sweep = reports.read_sweep(spark, str(tmp_path))
    assert sorted({x.variant for x in sweep.collect()}) == ["v001", "v002"] and sweep.count() == 6
    reports.write_sweep(sweep, spark.createDataFrame([("v001", "gamma=1"), ("v002", "gamma=2")], "id string, label string"), f"{tmp_path}/sweep.csv")
    assert spark.read.csv(f"{tmp_path}/sweep.csv", header=True).columns == ["variant", "label", *reports.REPORT_COLUMNS]
    plans = spark.createDataFrame([("k1", "a.wav", 40.0, 20.0, ["a.t001", "a.t002"], [80.0, 4000.0]), ("k0", "b.wav", 5.0, 5.0, ["b"], [90.0, 900.0])], reports.PLAN_SCHEMA)
    reports.write_plans(plans, f"{tmp_path}/plans")
    assert [x.source for x in reports.read_plans(spark, f"{tmp_path}/plans", "k1").collect()] == ["a.wav"]
    reports.write_state({"encode": "x", "notate": "y"}, spark, f"{tmp_path}/state")
    assert {x.stage: x.key for x in reports.read_state(spark, f"{tmp_path}/state").collect()} == {"encode": "x", "notate": "y"}
    stale = spark.createDataFrame([("decode", "old", "new")], "stage string, stored string, wanted string")
    with pytest.raises(RuntimeError, match="decode"):
        reports.refuse_stale(stale, 2)
    reports.refuse_stale(stale, 1)
    outputs = spark.createDataFrame([("a", "decode"), ("a", "encode")], "name string, stage string")
    assert [x.stage for x in reports.without_stale(outputs, stale).collect()] == ["encode"]
    names = spark.range(1).select(*[reports.file_name(F.lit("clip.wav"), k).alias(k) for k in ("sidecar", "words", "plan")]).first()
    assert tuple(names) == ("clip.chroma.png", "clip.txt", "clip.plan.json")


def test_frame_scans(spark):
    f = np.arange(4 * 8 * 12, dtype=np.uint8).reshape(4, 8, 12)
    times = [0.0, 0.11, 0.5, 0.61]
    df = spark.createDataFrame([("c", k, t, 8, 12, 1, bytearray(f[k].tobytes())) for k, t in enumerate(times)], "clip string, frame_no int, ts double, h int, w int, ch int, data binary")
    assert tuple(frames.probe(df).first()) == ("c", 12, 8, 4, 0.61)
    even = frames.at_rate(df, 10).orderBy("frame_no").collect()
    assert [r.frame_no for r in even] == list(range(7))
    assert [bytes(r.data) for r in even] == [f[k].tobytes() for k in (0, 1, 1, 1, 1, 2, 3)]
    assert [r.ts for r in frames.within(df, 0.1, 0.45).orderBy("ts").collect()] == [0.11, 0.5]
    small = frames.sized(df.where("frame_no = 0"), 6, 4).first()
    assert (small.h, small.w, small.ch) == (4, 6, 1)
    want = f[0].astype(float).reshape(4, 2, 6, 2).mean(axis=(1, 3))
    assert np.abs(np.frombuffer(bytes(small.data), np.uint8).reshape(4, 6) - want).max() <= 0.5
    kept = frames.sized(df.where("frame_no = 0"), 6, box=(0, 0, 6, 8)).first()
    assert (kept.h, kept.w) == (8, 6) and bytes(kept.data) == f[0][:, :6].tobytes()
    assert frames.two_at_least(df).count() == 4
    with pytest.raises(Exception, match="fewer than two"):
        frames.two_at_least(df.limit(1)).collect()


def test_annotated_pictures(spark):
    g = np.linspace(0, 1, 60 * 80).reshape(60, 80)
    out = pictures.annotate(spark.createDataFrame([("p", 60, 80, g.ravel().tolist(), 4.0)], "stem string, rows int, cols int, v array<double>, seconds double"), 80, 8000).first()
    p = png.decode(bytes(out.png))[0]
    assert p.shape == (70, 80 + 2 * pictures.MARGIN, 3) and (p[:60, pictures.MARGIN : -pictures.MARGIN, 0] == (g[::-1] * 255).astype(np.uint8)).all()
    assert p[:, : pictures.MARGIN].max() == 255 and p[60:].max() == 255
    m = png.decode(pictures.motion_picture(np.zeros((20, 50)), np.arange(51) / 5, np.array([5.0])))[0]
    assert np.flatnonzero((m[:20] == (255, 40, 40)).all(axis=(0, 2))).tolist() == [pictures.MARGIN + 24]
    names, level = recurrence.recurrence_levels(spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(6)], "vec_id long, embedding array<double>"), "vec_id")
    r = png.decode(pictures.recurrence_picture(names, level))[0]
    assert r.shape == (6, 6) and (np.diag(r) >= 254).all() and r[0, 1] < r[0, 2]


def test_agreement(spark):
    rows = [("c", 0, "euler", "m1", 0.1, 0.1, 0.2, 0.2, 1.0), ("c", 1, "rhythm", "r1", 0.15, 0.1, 0.25, 0.2, 2.05), ("c", 2, "rhythm", "r2", 0.7, 0.7, 0.8, 0.9, 0.5),
            ("c", 3, "rhythm", "r3", 0.75, 0.75, 0.85, 0.9, None), ("c", 4, "euler", "m2", 0.12, 0.1, 0.2, 0.2, 9.0)]
    df = spark.createDataFrame(rows, "clip string, id int, lens string, name string, x0 double, y0 double, x1 double, y1 double, rate double")
    things = findings.agreement(df, "clip").orderBy("thing").collect()
    assert [(t.kind, t.place, t.rate, t.members) for t in things] == [
        ("seen by both", "upper left", 1.0, "euler m1, rhythm r1"), ("only rhythm saw (in pieces)", "lower right", 0.5, "rhythm r2, rhythm r3"), ("only euler saw", "upper left", 9.0, "euler m2")]
    assert findings.agreement_lines(findings.agreement(df, "clip")).where("thing = 0").first().line == "seen by both: upper left; about 1.00 swings a second (euler m1, rhythm r1)"
    fr = spark.createDataFrame([("c", t, 8, 12) for t in (0.0, 0.1, 0.2, 1.2, 1.3)], "clip string, ts double, h int, w int")
    text = findings.clip_summary(fr, spark.createDataFrame([("c", "euler", ["one", "two"])], "clip string, lens string, lines array<string>")).first().text
    assert text == "segment: 0.00 to 1.30 s, 5 frames read at 12x8; frames 0.10 to 1.00 s apart\nthe camera skipped frames at 0:00.2 (1.0 s)\n[euler]\none\ntwo"
    lines = spark.createDataFrame([("s1", "camera or light: 0.25 a second and its multiples"), ("s2", "camera or light: 0.25 a second and its multiples"), ("s2", "x")], "segment string, line string")
    assert [tuple(r) for r in findings.combs(lines).collect()] == [(0.25, 2)]


def test_exact_quantiles_and_places(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.integers(0, 40, 3000).astype(float), "b": rng.normal(size=7), "c": np.full(500, 2.0), None: np.array([3.0, 1.0])}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    out = {r.k: r.q for r in quantiles(df, "k", "v", [0.0, 0.01, 0.5, 0.77, 1.0], "q").collect()}
    assert set(out) == set(values)
    for k, x in values.items():
        assert np.allclose(out[k], np.quantile(x, [0.0, 0.01, 0.5, 0.77, 1.0]))
    n = numbered(df.where("v is not null"), "v").collect()
    assert sorted(r.place for r in n) == list(range(len(n))) and all(a.v <= b.v for a, b in zip(sorted(n, key=lambda r: r.place), sorted(n, key=lambda r: r.place)[1:]))  # noqa: B905
    names = [f"clip-{i * 37 % 900}é" for i in range(900)] + ["clip-", "clip-1"]
    placed = numbered(spark.createDataFrame([(x,) for x in names], "name string").repartition(4), "name").collect()
    assert [r.name for r in sorted(placed, key=lambda r: r.place)] == sorted(names, key=str.encode)
    bounds = [1, 4, 5, 9, 12, 30]
    got = spark.range(-2, 40).select("id", range_of(F.col("id"), bounds).alias("p")).collect()
    assert all(r.p == sum(b <= r.id for b in bounds) for r in got)


def test_robust_scores_of_hot_rows(spark):
    from wavegrid.operators import normalise

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, float(v)) for k in "ab" for v in [*rng.normal(size=40), 1.0, 1.0]], "k string, v double")
    scores = lambda hot: sorted((r.k, r.v, round(r.score, 9)) for r in normalise.robust_scores(df, "k", "v", hot=hot).collect())
    assert scores(True) == scores(False) and df.columns == [c for c in normalise.robust_scores(df, "k", "v").columns if c != "score"]


def test_pooled_vectors(spark):
    v = [[float(i), 1.0] for i in range(10)]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>").repartition(3)
    out = recurrence.pooled(df, "vec_id", size=4).orderBy("index").collect()
    groups = [[i for i in range(10) if i * 4 // 10 == p] for p in range(4)]
    assert [(r["index"], list(r.vector)) for r in out] == [(g[0], [sum(g) / len(g), 1.0]) for g in groups]


def test_notes_in_words():
    from wavegrid.operators import note_finder

    x = synth.synthesize([(0, 1, 440.0, 100), (1, 1, 660.0, 100)], 120, 22050, "vibes")
    found = note_finder.find_notes(x, 22050)
    tonal, bright = note_finder.explained(x, 22050, found)
    assert tonal > 0.5 and 0 <= bright < 0.9
    text = note_finder.in_words(found, note_finder.character(found, tonal, bright))
    assert "A4" in text and "E5" in text and ("overtones" in text or "pure" in text)
    assert math.isclose(note_finder.midi_of(440.0), 69)


def test_lenses_from_files(spark, tmp_path):
    import json

    from wavegrid.operators import lenses, motion, plugins

    (tmp_path / "halve.py").write_text("import numpy as np\nNAME = 'halve'\nDESCRIPTION = 'half as bright'\ndef lens(p, params):\n    return p / 2\n")
    (tmp_path / "count.py").write_text("from wavegrid.operators.motion import Reading\nNAME = 'count'\ndef motion_lens(f, t, params):\n    return Reading(lines=[str(len(f))])\n")
    (tmp_path / "broken.py").write_text("raise RuntimeError('no')\n")
    (tmp_path / "_draft.py").write_text("raise RuntimeError('never loaded')\n")
    try:
        with pytest.warns(UserWarning, match="broken.py left out"):
            assert plugins.discover(str(tmp_path)) == ["count", "halve"]
        listed = json.loads(plugins.listing())
        assert listed["lenses"]["halve"] == "half as bright" and "count" in listed["motion"]
        df = spark.createDataFrame([("p", 2, 2, [1.0, 0.5, 0.0, 0.2])], "stem string, rows int, cols int, v array<float>")
        assert np.allclose(lenses.apply(df, "halve").first().v, [0.5, 0.25, 0, 0.1])
    finally:
        lenses._LENSES.pop("halve", None)
        motion._LENSES.pop("count", None)


def test_command_line(spark, tmp_path, capsys):
    from wavegrid.__main__ import main, parser, work

    assert main(["queries"]) == 0 and main(["lenses"]) == 0 and main(["scales"]) == 0
    said = capsys.readouterr().out
    assert "transcribe_notes\n" in said and '"edges"' in said and "base 60: " in said
    g = (np.linspace(0, 255, 30 * 40).reshape(30, 40)).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png.encode(g))
    assert work(spark, parser().parse_args(["render", str(tmp_path / "in"), str(tmp_path / "out"), "--rows", "20", "--cols", "30", "--sr", "22050"])) == 0
    assert "notes_decode: 1 jobs, 0 failed" in capsys.readouterr().out
    x = synth.synthesize([(0, 1, 440.0, 100)], 120, 22050, "vibes")
    (tmp_path / "x.wav").write_bytes(wav.encode(x, 22050))
    assert work(spark, parser().parse_args(["notes", str(tmp_path / "x.wav")])) == 0 and "A4" in capsys.readouterr().out
    assert work(spark, parser().parse_args(["run", "nothing", "/"])) == 2
    with pytest.raises(SystemExit):
        main(["unheard-of"])


def test_voiced_tracks_and_stereo(spark):
    t = np.arange(0, 8, 0.1)
    tracks = [("a", t, np.sin(t * 2), 1.0), ("b", t, np.cos(t * 3), 1.0)]
    for mode in ("glide", "notes"):
        x, lines = synth.voiced(tracks, 0, 8, mode, sr=SR)
        assert len(x) == 8 * SR and np.abs(x).max() == pytest.approx(0.85, rel=0.01) and len(lines) == 2 and x[0] == 0
    x, lines = synth.voiced([], 0, 1, sr=SR)
    assert not x.any() and lines == ["silent, nothing to voice"]
    with pytest.raises(ValueError, match="mode"):
        synth.voiced(tracks, 0, 1, "hum")
    schema = "clip string, tracks array<struct<name:string,size:double,t:array<double>,value:array<double>>>"
    df = spark.createDataFrame([("c", [("a", 1.0, t.tolist(), np.sin(t).tolist())]), ("d", [])], schema)
    out = {r.clip: r for r in synth.voice_readings(df, sr=SR).collect()}
    assert len(out["c"].samples) == int(t[-1] * SR) and len(out["d"].samples) == 0
    r = wav.stereo(spark.createDataFrame([("s", SR, [0.5, 0.25], [-0.5, 0.25])], "stem string, sr int, left array<double>, right array<double>")).first()
    body = bytes(r.content)
    assert body[22:24] == b"\x02\x00" and np.allclose(wav.decode(body)[1], [0, 0.25], atol=1e-4)


def test_octave_copy_is_the_relational_colour(spark):
    from wavegrid.functions import music

    hz = [80.0, 100.0, 261.6, 440.0, 1000.0, 7999.0, 20000.0]
    got = spark.createDataFrame([(h,) for h in hz], "hz double").select(*[c.alias(n) for c, n in zip(music.octave_rgb(F.col("hz")), "rgb", strict=True)]).collect()
    assert np.allclose([tuple(r) for r in got], pictures.octave_light(np.array(hz)), atol=1e-9)
    p = pictures.octave_copy(np.full((5, 4), 200, np.uint8), 80, 8000)
    assert p.shape == (5, 4, 3) and (p.max(axis=2) == 200).all() and (p[:, 0] == p[:, 3]).all()


def test_run_settings_and_change_log(spark):
    from wavegrid.operators import jobs, series

    assert jobs.run_settings({"rows": 100, "cols": 300, "range": "full", "fscale": "linear"}) == {"f_lo": 40, "f_hi": 20000, "sr": 44100, "scale": "linear", "rows": 100, "cols": 300, "lens_params": {}}
    assert jobs.run_settings({"rows": 100, "cols": 300, "lens": "spectral", "range": "?"})["cols"] == 100
    log, top = series.change_log(spark.createDataFrame([("a", 0.5), ("b", 0.125), ("c", 0.5)], "name string, rms double"), "name", top=2)
    assert [r.line for r in log.orderBy("name").collect()] == ["a 0.500000", "b 0.125000", "c 0.500000"] and [r.name for r in top.collect()] == ["a", "c"]
