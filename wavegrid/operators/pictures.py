"""Pictures of sound: colour sidecars, palettes over whole pictures, contact sheets and rulers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.operators.signal import frequencies, resize
from wavegrid.sources import png

# The JPEG colour transform.
_TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
_SHIFT = np.array([0.0, 128.0, 128.0])


def to_ycc(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ _TO_YCC.T + _SHIFT


def to_rgb(ycc: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((ycc - _SHIFT) @ np.linalg.inv(_TO_YCC).T), 0, 255).astype(np.uint8)


def sidecar(rgb: np.ndarray, width: int = 32, inverted: bool = False) -> bytes:
    """A small PNG of a picture's colour alone, brightness put to the middle; it notes the picture's size and inversion."""
    rows, cols = rgb.shape[:2]
    height = max(1, round(rows * width / cols))
    ycc = np.stack([resize(to_ycc(rgb)[..., k], height, width) for k in range(3)], axis=-1)
    ycc[..., 0] = 128
    return png.encode(to_rgb(ycc), {"inverted": str(int(inverted)), "size": f"{cols}x{rows}"})


def coloured(grey: np.ndarray, side: bytes | None) -> np.ndarray:
    """A grey picture with a sidecar's colour and, if the encoder inverted it, its brightness turned back; grey without one."""
    if side is None:
        return grey
    colour, notes = png.decode(side)
    chroma = to_ycc(colour)
    luma = 255 - grey if notes.get("inverted") == "1" else grey
    rows, cols = grey.shape
    return to_rgb(np.stack((luma.astype(np.float64), resize(chroma[..., 1], rows, cols), resize(chroma[..., 2], rows, cols)), axis=-1))


def recolour(pictures: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(stem, png) left-joined with (stem, sidecar): stem, png with colour where a sidecar exists."""

    def run(batches):
        for pdf in batches:
            out = [png.encode(coloured(png.decode(bytes(p))[0], None if s is None else bytes(s))) for p, s in zip(pdf["png"], pdf["sidecar"], strict=True)]
            yield pd.DataFrame({"stem": pdf["stem"], "png": out})

    return pictures.join(sidecars, "stem", "left").select("stem", "png", "sidecar").mapInPandas(run, "stem string, png binary")


def sheet_layout(pictures: DataFrame, sheet: str, columns: int) -> DataFrame:
    """Place of every picture on its sheet in reading order, with the gap between: row, col, x, y, sheet width and height."""
    n = F.count(F.lit(1)).over(Window.partitionBy(sheet))
    i = F.row_number().over(Window.partitionBy(sheet).orderBy("stem")) - 1
    w, h = F.max("w").over(Window.partitionBy(sheet)), F.max("h").over(Window.partitionBy(sheet))
    placed = pictures.withColumns({"_n": n, "_i": i, "_w": w, "_h": h}).withColumn("_c", F.least(F.lit(columns), F.col("_n")))
    gap = F.greatest(F.lit(2), F.floor(F.col("_w") / 150))
    row, col = F.floor(F.col("_i") / F.col("_c")), F.col("_i") % F.col("_c")
    out = placed.withColumns({"gap": gap, "row": row, "col": col}).withColumns(
        {"x": F.col("gap") + F.col("col") * (F.col("_w") + F.col("gap")), "y": F.col("gap") + F.col("row") * (F.col("_h") + F.col("gap"))}
    )
    whole = lambda k, size: k * (F.col(size) + F.col("gap")) + F.col("gap")
    return out.withColumns({"sheet_w": whole(F.col("_c"), "_w"), "sheet_h": whole(F.ceil(F.col("_n") / F.col("_c")), "_h")}).drop("_n", "_i", "_w", "_h", "_c")


def contact_sheets(layout: DataFrame, sheet: str) -> DataFrame:
    """The sheets as PNG, one a task; ``layout`` has a column png (grey) of each picture."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        canvas = np.zeros((int(pdf["sheet_h"].iloc[0]), int(pdf["sheet_w"].iloc[0])), np.uint8)
        for p, x, y in zip(pdf["png"], pdf["x"], pdf["y"], strict=True):
            picture = png.decode(bytes(p))[0]
            canvas[int(y) : int(y) + picture.shape[0], int(x) : int(x) + picture.shape[1]] = picture
        return pd.DataFrame({"stem": [pdf[sheet].iloc[0]], "png": [png.encode(canvas)]})

    return layout.groupBy(sheet).applyInPandas(run, "stem string, png binary")


def rulers(lo: float, hi: float, seconds: float, rows: int, cols: int) -> list[tuple[str, str, int]]:
    """(axis, label, pixel) of a picture's rulers: 1-2-5 frequencies, every C, and round times. Row 0 is the highest pitch."""
    row = lambda f: round((rows - 1) * (1 - math.log(f / lo) / math.log(hi / lo)))
    out = [("hz", f"{f:g}", row(f)) for k in range(-1, 6) for m in (1, 2, 5) if lo <= (f := m * 10.0**k) <= hi]
    out += [("note", f"C{o}", row(f)) for o in range(-1, 11) if lo <= (f := 440 * 2 ** ((12 * (o + 1) - 69) / 12)) <= hi]
    raw = seconds / 10
    power = 10 ** math.floor(math.log10(raw))
    step = next(m * power for m in (1, 2, 5, 10) if m * power >= raw)
    return out + [("time", f"{k * step:g}", round((cols - 1) * k * step / seconds)) for k in range(int(seconds / step + 1e-9) + 1)]


def octave_light(hz: np.ndarray) -> np.ndarray:
    """... x 3, in [0, 1]: the colour of frequencies, hue 0 to 300 degrees over each octave of light folded down."""
    hue = np.mod(np.log2(hz / 400e12), 1.0) * 5.0
    ramp = np.clip(np.stack([np.abs(hue - 3) - 1, 2 - np.abs(hue - 2), 2 - np.abs(hue - 4)], axis=-1), 0, 1)
    return ramp


def octave_copy(grey: np.ndarray, lo: float, hi: float, scale: str = "log") -> np.ndarray:
    """RGB of a grey decoded picture (the highest pitch in row 0), each row in its pitch's colour."""
    hz = frequencies(lo, hi, len(grey), scale)[::-1]
    return np.clip(grey[..., None] * octave_light(hz)[:, None, :], 0, 255).astype(np.uint8)


# --- annotated pictures ------------------------------------------------------------------------------

#: A 3 x 5 face for rulers, a row of three bits to a digit.
FACE = {
    "0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71122", "8": "75757", "9": "75717",
    ".": "00002", "-": "00700", ":": "02020", "A": "25755", "B": "65656", "C": "74447", "D": "65556", "E": "74647", "F": "74644", "G": "74557",
    "#": "57575", "s": "03626", "k": "45655", " ": "00000",
}
MARGIN = 26


def write_text(canvas: np.ndarray, text: str, y: int, x: int, level: int = 255) -> None:
    """Draws into a grey canvas; what falls outside is cut, unknown letters are blanks."""
    for k, letter in enumerate(text):
        bits = np.array([[int(row) >> (2 - c) & 1 for c in range(3)] for row in FACE.get(letter, FACE[" "])], bool)
        ys, xs = np.nonzero(bits)
        ys, xs = ys + y, xs + x + 4 * k
        inside = (ys >= 0) & (ys < canvas.shape[0]) & (xs >= 0) & (xs < canvas.shape[1])
        canvas[ys[inside], xs[inside]] = level


def annotated(grey: np.ndarray, ticks: list[tuple[str, str, int]], marks: list[int] | None = None) -> np.ndarray:
    """RGB of a grey picture between rulers: frequencies on the left, notes on the right, times below; columns in ``marks`` get a red line."""
    rows, cols = grey.shape
    canvas = np.zeros((rows + 10, cols + 2 * MARGIN), np.uint8)
    canvas[:rows, MARGIN : MARGIN + cols] = grey
    for axis, label, at in ticks:
        if axis == "time":
            canvas[rows : rows + 3, MARGIN + at] = 255
            write_text(canvas, label, rows + 4, MARGIN + at - 2 * len(label))
        else:
            x = MARGIN - 3 if axis == "hz" else MARGIN + cols
            canvas[at, x : x + 3] = 255
            write_text(canvas, label, at - 2, x - 1 - 4 * len(label) if axis == "hz" else x + 4)
    out = np.repeat(canvas[..., None], 3, axis=2)
    for at in marks or []:
        out[:rows, MARGIN + at] = (255, 40, 40)
    return out


def annotate(grids: DataFrame, lo: float, hi: float) -> DataFrame:
    """stem, png of pictures of sound (stem, rows, cols, v in [0, 1] with the lowest pitch first, seconds) with their rulers."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                grey = (np.asarray(r.v, float).reshape(r.rows, r.cols)[::-1] * 255).astype(np.uint8)
                out.append((r.stem, png.encode(annotated(grey, rulers(lo, hi, r.seconds, r.rows, r.cols)))))
            yield pd.DataFrame(out, columns=["stem", "png"])

    return grids.select("stem", "rows", "cols", "v", "seconds").mapInPandas(run, "stem string, png binary")


def motion_picture(strip: np.ndarray, times: np.ndarray, skips: np.ndarray) -> bytes:
    """PNG of a motion profile (rows x steps, the top row last) with a time ruler and a red line at each skip."""
    grey = (strip[::-1] * 255).astype(np.uint8)
    at = lambda t: int(round((t - times[0]) / max(times[-1] - times[0], 1e-9) * (grey.shape[1] - 1)))
    ticks = [t for t in rulers(80, 8000, max(float(times[-1] - times[0]), 1e-3), *grey.shape) if t[0] == "time"]
    return png.encode(annotated(grey, ticks, [at(t) for t in skips]))


def recurrence_picture(names: np.ndarray, level: np.ndarray, invert: bool = False) -> bytes:
    """PNG of a matrix of levels in [0, 1], as recurrence_levels or a threshold gives them."""
    v = 1 - level if invert else level
    return png.encode((np.clip(v, 0, 1) * 255).astype(np.uint8), {"size": f"{len(names)}x{len(names)}"})
