"""Colour sidecars, contact sheets and rulers."""

import numpy as np

from wavegrid.operators import pictures
from wavegrid.sources import png


def test_sidecar_brings_colour_back(spark):
    y, x = np.mgrid[:60, :80]
    rgb = np.stack((x * 3, y * 4, 255 - x * 3), axis=-1).astype(np.uint8)
    assert np.abs(pictures.to_rgb(pictures.to_ycc(rgb)).astype(int) - rgb).max() <= 1
    side = pictures.sidecar(rgb, inverted=True)
    small, notes = png.decode(side)
    assert small.shape == (24, 32, 3) and notes == {"inverted": "1", "size": "80x60"}
    grey = np.rint(pictures.to_ycc(rgb)[..., 0]).astype(np.uint8)
    back = pictures.coloured(255 - grey, side)
    assert np.abs(back.astype(float) - rgb).mean() < 6
    p = spark.createDataFrame([("a", bytearray(png.encode(255 - grey))), ("b", bytearray(png.encode(grey)))], "stem string, png binary")
    s = spark.createDataFrame([("a", bytearray(side))], "stem string, sidecar binary")
    out = {r.stem: png.decode(bytes(r.png))[0] for r in pictures.recolour(p, s).collect()}
    assert (out["a"] == back).all() and (out["b"] == grey).all()


def test_contact_sheet(spark):
    rows = [("s", f"p{i}", 10, 6, bytearray(png.encode(np.full((6, 10), 50 + i, np.uint8)))) for i in range(5)]
    layout = pictures.sheet_layout(spark.createDataFrame(rows, "sheet string, stem string, w int, h int, png binary"), "sheet", 3)
    sheet = png.decode(bytes(pictures.contact_sheets(layout, "sheet").first().png))[0]
    assert sheet.shape == (18, 38) and sheet[2, 2] == 50 and sheet[10, 14] == 54 and sheet[0].max() == 0


def test_rulers():
    r = pictures.rulers(80, 8000, 4.0, 200, 400)
    assert ("hz", "100", 189) in r and ("time", "4", 399) in r and [x for x in r if x[0] == "note"][0][1] == "C3"


def test_image_scan(spark, tmp_path):
    from wavegrid.sources import images

    rng = np.random.default_rng(2)
    grey, colour = rng.integers(0, 256, (12, 16), dtype=np.uint8), rng.integers(0, 256, (12, 16, 3), dtype=np.uint8)
    (tmp_path / "g.png").write_bytes(png.encode(grey))
    (tmp_path / "c.png").write_bytes(png.encode(colour))
    (tmp_path / "no.png").write_bytes(b"nothing")
    out = {r.stem: np.array(r.v).reshape(12, 16) for r in images.grids(spark, str(tmp_path), 12, 16).collect()}
    assert set(out) == {"g", "c"} and np.allclose(out["g"][::-1] * 255, grey, atol=0.51)
    assert np.abs(out["c"][::-1] * 255 - colour @ np.array([0.299, 0.587, 0.114])).max() <= 1
    small = images.grids(spark, f"{tmp_path}/g.png", 6, 8).first()
    assert len(small.v) == 48 and 0 <= min(small.v) <= max(small.v) <= 1
