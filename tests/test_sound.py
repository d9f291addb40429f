"""Sound and picture kernels on inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavegrid.operators import lenses, note_finder, signal, synth
from wavegrid.sources import midi, png, wav

SR = 22050


def tone(hz, seconds=1.0, sr=SR):
    return np.sin(2 * np.pi * hz * np.arange(int(sr * seconds)) / sr)


def test_wav_round_trip_of_all_kinds():
    import struct

    x = np.round(tone(440, 0.1) * 0.5 * 32767) / 32767
    sr, y = wav.decode(wav.encode(x, SR))
    assert sr == SR and np.abs(x - y).max() < 1 / 32000
    assert np.allclose(wav.decode(wav.encode(np.stack((x, -x), axis=1), SR))[1], 0, atol=1e-4)
    raw = bytes(range(256))
    assert np.allclose(wav.decode(wav.header(8000, 1, 8, 256) + raw)[1], (np.arange(256) - 128) / 128)
    four = struct.pack("<2i", 2147483647, -2147483647)
    assert np.allclose(wav.decode(wav.header(8000, 1, 32, 8) + four)[1], [1, -1])
    fl = struct.pack("<2f", 0.25, -0.5)
    assert np.allclose(wav.decode(wav.header(8000, 1, 32, 8, True) + fl)[1], [0.25, -0.5])
    assert np.allclose(wav.decode(wav.header(8000, 1, 8, 256) + raw, "legacy")[1], np.arange(256) / 32767)
    with pytest.raises(ValueError, match="WAV"):
        wav.decode(b"nothing")


def test_wav_scan_tile_assemble_lossless(spark, tmp_path):
    before, wav.CHUNK = wav.CHUNK, 1000
    try:
        for name, n in (("a", 2500), ("b", 700)):
            (tmp_path / f"{name}.wav").write_bytes(wav.encode(np.arange(n) / 4000, 1000))
        s = wav.read(spark, str(tmp_path)).cache()
        assert {r.stem: (r.n, r.seconds) for r in wav.durations(s).collect()} == {"a": (2500, 2.5), "b": (700, 0.7)}
        cut = wav.tile(s.where("stem = 'a'"), 0.9, 0.3).orderBy("start_sample").collect()
        got = np.concatenate([r.samples for r in cut])
        assert len(got) == 300 and np.allclose(got, np.arange(900, 1200) / 4000, atol=1e-4) and cut[1].start_sample == 100
        both = wav.assemble(s, "all").orderBy("start_sample").collect()
        assert both[0].n == 3200 and both[-1].start_sample == 2500
        back = wav.write(s, str(tmp_path / "out")).where("stem = 'b'").first()
        assert len(wav.decode(bytes(back.content))[1]) == 700
    finally:
        wav.CHUNK = before
    body = bytes.fromhex("ffd8ff") + bytes(range(200))
    r = spark.createDataFrame([(bytearray(body),)], "c binary").select(wav.lossless(F.col("c")).alias("w")).select("w", wav.restored(F.col("w")).alias("r")).first()
    assert bytes(r.r.content) == body and r.r.jpeg and bytes(r.w) == wav.header(SR, 1, 8, len(body)) + body


def test_converted_tiles(spark):
    x = tone(50, 2, 1000)
    df = spark.createDataFrame([("a", 1000, 2000, k, k * 700, x[k * 700 : (k + 1) * 700].astype(np.float32).tolist()) for k in range(3)], wav.SIGNAL)
    r = wav.converted(df, 2000, 0.5, 1.0).first()
    assert (r.sr, r.n, len(r.samples)) == (2000, 2000, 2000) and np.allclose(r.samples[::2], x[500:1500], atol=1e-5)
    assert wav.tile(df, 1.5, 2.0).first().n == 500 and wav.converted(df, 1000).first().n == 2000


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (5, 7, 3)):
        p = rng.integers(0, 256, shape).astype(np.uint8)
        q, text = png.decode(png.encode(p, {"inverted": "1", "size": "7x5"}))
        assert (p == q).all() and text == {"inverted": "1", "size": "7x5"}


def test_midi():
    for n in (0, 127, 128, 16383, 16384, 2**21 - 1, 2**27):
        assert midi.read_quantity(midi.quantity(n)) == (n, len(midi.quantity(n)))
    data = midi.encode([(0, 1, 440, 100), (1, 1, 440, 90)], 120, 46)
    assert data[:4] == b"MThd" and data.index(bytes([0x80, 69])) < data.index(bytes([0x90, 69, 90]))


def test_stft_peak_and_scan(spark):
    m = signal.stft(tone(SR / 1024 * 40), 1024, 256)
    assert (m.argmax(axis=0) == 40).all() and m.shape[1] == (SR - 1024) // 256 + 1
    x = np.random.default_rng(1).standard_normal(5000)
    whole = signal.stft(x, 256, 100)
    rows = [("s", SR, 5000, k, k * 777, x[k * 777 : (k + 1) * 777].astype(np.float32).tolist()) for k in range(7)]
    out = signal.spectrogram(spark.createDataFrame(rows, wav.SIGNAL), 256, 100, 0, SR).toPandas()
    grid = out.pivot(index="bin", columns="frame", values="mag").to_numpy()
    assert grid.shape == whole.shape and np.allclose(grid, whole, atol=1e-5)


def test_resample_and_resize():
    x = tone(50, 1, 1000)
    assert np.allclose(signal.resample(x, 2000)[::2], x, atol=1e-9) and np.allclose(signal.resample(signal.resample(x, 2000), 1000), x)
    assert np.allclose(signal.resize(np.full((8, 9), 0.3), 20, 4), 0.3)


def test_fidelity_anchors():
    x = sum(tone(f) for f in (220, 330, 550)) * np.linspace(1, 0.1, SR)
    noise = np.random.default_rng(0).standard_normal(SR)
    same, half, far = (signal.fidelity(x, y, SR) for y in (x, x + noise, noise))
    assert same == pytest.approx(1, abs=1e-6) and same > half > far and abs(signal.fidelity(x, x * 0, SR)) < 1e-6


def test_picture_round_trip(spark):
    g = np.zeros((40, 60))
    g[10, 5:50] = 1
    g[30, 20:40] = 0.8
    x = signal.encode_picture(g)
    back = signal.decode_sound(x, SR, 40, 60)
    assert np.corrcoef(g.ravel(), back.ravel())[0, 1] > 0.6 and back[10].mean() > 3 * back[20].mean()
    with pytest.raises(ValueError, match="sample rate"):
        signal.encode_picture(g, hi=12000)
    df = spark.createDataFrame([("p", 40, 60, g.ravel().tolist())], "stem string, rows int, cols int, v array<double>")
    out = signal.sound_to_pictures(signal.pictures_to_sound(df), 40, 60).first()
    assert np.allclose(np.array(out.v).reshape(40, 60), back, atol=1e-3)


def test_recording_band(spark):
    x = (tone(1000, 2) + tone(300, 2)) / 2
    rows = [("s", SR, len(x), k, k * 10000, x[k * 10000 : (k + 1) * 10000].astype(np.float32).tolist()) for k in range(5)]
    r = signal.recording_bands(spark.createDataFrame(rows, wav.SIGNAL)).first()
    assert 200 < r.f_lo < 300 and 1000 < r.f_hi < 1500
    assert signal.recording_band(np.zeros(2049), SR) == (80.0, 8000.0)


def test_features_find_an_anomaly(spark):
    from wavegrid.operators.recurrence import discords

    x = np.concatenate([tone(440, 6), tone(1760, 0.5), tone(440, 6)])
    f = signal.features(spark.createDataFrame([("s", SR, len(x), 0, 0, x.astype(np.float32).tolist())], wav.SIGNAL), 100)
    top = discords(f, top=1).first()
    assert abs(top["index"] / 100 * 12.5 - 6.25) < 0.5


def test_lenses(spark):
    rng = np.random.default_rng(0)
    g = rng.random((24, 30)).astype(np.float32)
    for name in lenses.catalog():
        out = lenses.view(name, g)
        assert out.shape == g.shape and out.min() >= 0 and out.max() <= 1
    step = np.zeros((20, 20), np.float32)
    step[:, 10:] = 1
    assert lenses.view("edges", step)[:, 9:11].min() > 0.9 and lenses.view("edges", step)[:, :5].max() == 0
    assert np.allclose(lenses.view("fractal", np.full((12, 12), 0.5, np.float32)), 0.225)
    df = spark.createDataFrame([("p", 24, 30, g.ravel().tolist())], "stem string, rows int, cols int, v array<float>")
    assert np.allclose(lenses.apply(df, "reveal", {"zmax": "3"}).first().v, lenses.view("reveal", g, {"zmax": "3"}).ravel())
    with pytest.raises(ValueError, match="unknown lens"):
        lenses.apply(df, "nothing")
    with pytest.warns(UserWarning, match="left out"):
        lenses.register("bad", "", lambda g, p: g[:2])


@pytest.mark.parametrize("hz", [110.0, 220.0, 446.3])
@pytest.mark.parametrize("voice", ["harp", "lyre"])
def test_plucked_strings_are_in_tune(voice, hz):
    x = synth.one_note(voice, hz, 1.0, SR, 2.5, np.random.default_rng(0))[2000:]
    n = 1 << 18
    s = np.abs(np.fft.rfft(x * np.hanning(len(x)), n))
    lo, hi = int(hz * 0.94 * n / SR), int(hz * 1.06 * n / SR)
    found = (lo + s[lo:hi].argmax()) * SR / n
    assert abs(1200 * math.log2(found / hz)) < 3


def test_voices_sound_and_reruns_agree():
    for voice in ("vibes", "piano", "harp", "pad", "vibraphone", "lyre", "reed"):
        x = synth.synthesize([(0, 1, 330, 100), (1, 1, 440, 80)], 120, SR, voice)
        assert np.isfinite(x).all() and np.abs(x).max() == pytest.approx(0.85, rel=0.1)
        assert (x == synth.synthesize([(0, 1, 330, 100), (1, 1, 440, 80)], 120, SR, voice)).all()
    with pytest.raises(ValueError, match="unknown voice"):
        synth.synthesize([(0, 1, 330, 100)], 120, SR, "kazoo")


def test_tracks_to_sound():
    t = np.arange(0, 10, 0.1)
    still = synth.glide(t, np.zeros(100), 1.0, 220, SR, 0)
    assert np.abs(still).max() == 0
    assert np.abs(synth.glide(t, np.sin(t), 1.0, 220, SR, 0)).max() > 0.5
    notes = synth.turn_notes(t, np.sin(2 * np.pi * 0.5 * t), 1.0, 220, [1, 9 / 8, 5 / 4, 3 / 2], 0)
    assert 8 <= len(notes) <= 10 and all(50 <= n[3] <= 120 for n in notes)
    mixed = synth.dry_mix(tone(440), tone(220, 0.5), 0.5)
    assert len(mixed) == SR and np.abs(mixed).max() == pytest.approx(0.85)


def test_note_finder_hears_its_own_notes(spark):
    score = [(0, 1, 261.63, 110), (1, 1, 329.63, 100), (2, 1, 392.0, 100), (3, 1, 523.25, 110)]
    for voice in ("vibes", "harp"):
        x = synth.synthesize(score, 120, SR, voice)
        rows = spark.createDataFrame([(voice, SR, len(x), 0, 0, x.astype(np.float32).tolist())], wav.SIGNAL)
        found = note_finder.find(rows).collect()
        for start, _, hz, _ in score:
            near = [n for n in found if abs(n.t0 - start * 0.5) < 0.1 and abs(n.midi - (69 + 12 * math.log2(hz / 440))) < 0.2]
            assert near, (voice, hz, [(round(n.t0, 2), round(n.midi, 2)) for n in found])
    assert note_finder.find_notes(np.zeros(SR), SR) == [] and note_finder.character([]) == "no notes"
