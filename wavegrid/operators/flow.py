"""Movement between frames: flow of tiles, turns about a pivot, and the pivot that explains a flow best."""

from __future__ import annotations

import numpy as np

from wavegrid.operators.lenses import blur


def sample(pictures: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at real positions of one picture (h x w), or of each of a stack; the border is held."""
    stack = pictures.reshape(-1, *pictures.shape[-2:])
    n, h, w = stack.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    top, left = np.minimum(np.floor(y), max(h - 2, 0)).astype(np.intp), np.minimum(np.floor(x), max(w - 2, 0)).astype(np.intp)
    down, right = min(1, h - 1) * w, min(1, w - 1)
    shape = np.broadcast_shapes(y.shape, x.shape, (n,) + (1,) * (pictures.ndim - 1) if pictures.ndim == 3 else ())
    base = top * w + left + (np.arange(n).reshape(-1, 1, 1) * h * w if pictures.ndim == 3 else 0)
    flat, fy, fx = stack.ravel(), y - top, x - left
    upper = flat[base] + fx * (flat[base + right] - flat[base])
    lower = flat[base + down] + fx * (flat[base + down + right] - flat[base + down])
    return np.broadcast_to(upper + fy * (lower - upper), shape)


def flow(frames: np.ndarray, tile: int = 16, levels: int = 3, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(moves, confidence), (n - 1) x tile rows x tile columns each: every tile's move to the next frame as across + down * i.

    All tiles of all pairs are one stack of two-by-two least-squares problems (Lucas and Kanade's), solved from
    coarse to fine. A frame's smoothed, thinned copies serve both pairs that it is in. The confidence is the smaller
    eigenvalue of a tile's normal matrix a pixel.
    """
    rows, cols = frames.shape[1] // tile, frames.shape[2] // tile
    frames = frames[:, : rows * tile, : cols * tile].astype(np.float64)
    moves = np.zeros((len(frames) - 1, rows, cols, 2))
    confidence = np.zeros(moves.shape[:3])
    for level in reversed(range(levels)):
        scale = 2**level
        thin = blur(frames, 0.7 * scale, axes=(1, 2))[:, ::scale, ::scale]
        side = tile // scale
        by_tile = lambda planes: planes.reshape(*planes.shape[:-2], rows, side, cols, side).mean(axis=(-3, -1))  # noqa: B023, E731
        here, there = thin[:-1], thin[1:]
        slope = np.stack(np.gradient(here, axis=(2, 1)))
        normal = np.moveaxis(by_tile(slope[:, None] * slope[None]), (0, 1), (-2, -1))
        confidence = np.linalg.eigvalsh(normal)[..., 0]
        solid = np.linalg.det(normal) * side**4 > 1e-6
        inverse = np.linalg.inv(np.where(solid[..., None, None], normal, np.eye(2))) * solid[..., None, None]
        y, x = np.mgrid[: thin.shape[1], : thin.shape[2]]
        for _ in range(rounds):
            spread = np.repeat(np.repeat(moves / scale, side, axis=1), side, axis=2)
            error = sample(there, y + spread[..., 1], x + spread[..., 0]) - here
            step = np.einsum("...ij,j...->...i", inverse, by_tile(slope * error))
            moves -= scale * np.clip(step, -2, 2)
    return moves[..., 0] + 1j * moves[..., 1], confidence


def tile_flow(a: np.ndarray, b: np.ndarray, tile: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(across, down, confidence) of every tile's move from a to b."""
    moves, confidence = flow(np.stack((a, b)), tile)
    return moves[0].real, moves[0].imag, confidence[0]


ANGLES = 720


def turns(frames: np.ndarray, pivot: tuple[float, float], area: np.ndarray, most: float = 0.25, rounds: int = 4) -> np.ndarray:
    """Angle in radians by which each frame turns into the next about a pivot (x, y).

    On polar copies of the frames about the pivot a turn is a shift along one axis. The best whole shift up to
    ``most`` radians is searched, then refined by least squares along that axis. Pixels count by how much they
    changed, and only those of the area.
    """
    y, x = np.nonzero(area)
    far = float(np.hypot(y - pivot[1], x - pivot[0]).max()) if len(y) else 0.0
    radius = np.arange(2.0, max(far, 3.0))
    step = 2 * np.pi / ANGLES
    angle = np.arange(ANGLES) * step
    py, px = pivot[1] + radius[:, None] * np.sin(angle), pivot[0] + radius[:, None] * np.cos(angle)
    inside = (py >= 0) & (py <= area.shape[0] - 1) & (px >= 0) & (px <= area.shape[1] - 1)
    counts = sample(area.astype(float), py, px) * inside * radius[:, None]  # a polar cell far out stands for more pixels
    used = np.flatnonzero(counts.any(axis=1))
    if not len(used):
        return np.zeros(len(frames) - 1)
    counts, py, px = counts[used], py[used], px[used]
    reach = int(most / step)
    out = np.zeros(len(frames) - 1)
    before = None
    for k, frame in enumerate(frames):
        now = sample(blur(frame.astype(float), 1.0), py, px)
        if before is not None:
            weight = counts * blur(np.abs(now - before), 2.0)
            if weight.sum() > 0:
                wide = np.concatenate((now[:, -reach:], now, now[:, :reach]), axis=1)
                cost = [(weight * (wide[:, reach + s : reach + s + ANGLES] - before) ** 2).sum() for s in range(-reach, reach + 1)]
                shift = float(np.argmin(cost) - reach)
                slope = (np.roll(before, -1, axis=1) - np.roll(before, 1, axis=1)) / 2
                power = (weight * slope**2).sum()
                for _ in range(rounds if power > 0 else 0):
                    low = int(np.floor(shift))
                    moved = np.roll(now, -low, axis=1)
                    moved = moved + (shift - low) * (np.roll(moved, -1, axis=1) - moved)
                    shift -= float(np.clip((weight * slope * (moved - before)).sum() / power, -2, 2))
                out[k - 1] = shift * step
        before = now
    return out


def turn_step(a: np.ndarray, b: np.ndarray, pivot: tuple[float, float], area: np.ndarray) -> float:
    return float(turns(np.stack((a, b)), pivot, area)[0])


def fit_pivot(at: np.ndarray, v: np.ndarray, extent: tuple[tuple[float, float], tuple[float, float]], rounds: int = 200) -> tuple[complex, np.ndarray, float, float]:
    """(pivot, turn per step, share of motion a turn explains, share a slide explains) for velocities v[t, k] at complex places.

    The model v = i * turn * (place - pivot) is linear in the turns for a known pivot, and in the pivot for known turns.
    The least squares of both alternate, from the turns of the freely moving rigid body that fits best.
    """
    centre, drift = at.mean(), v.mean(axis=1)
    power = float((np.abs(v) ** 2).sum())
    clamp = lambda p: complex(np.clip(p.real, *extent[0]), np.clip(p.imag, *extent[1]))
    turn_about = lambda p: (np.conj(at - p) * v).imag.sum(axis=1) / max(float((np.abs(at - p) ** 2).sum()), 1e-12)
    turn = (np.conj(at - centre) * (v - drift[:, None])).imag.sum(axis=1) / max(float((np.abs(at - centre) ** 2).sum()), 1e-12)
    pivot = centre
    for _ in range(rounds):
        last, spin = pivot, float((turn**2).sum())
        pivot = clamp(centre + 1j * (turn * drift).sum() / spin) if spin > 1e-18 else clamp(centre)
        turn = turn_about(pivot)
        if abs(pivot - last) < 1e-4:
            break
    if power <= 0:
        return pivot, turn, 0.0, 0.0
    explained = lambda model: 1 - float((np.abs(v - model) ** 2).sum()) / power
    return pivot, turn, explained(1j * turn[:, None] * (at - pivot)), explained(drift[:, None])
