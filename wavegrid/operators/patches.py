"""Grids of patches over frames: means by averaging matrices, the six channels of a patch, and printed clocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from wavegrid.operators.lenses import blur

#: Rows: luma, blue less luma, red less luma, from red, green and blue.
COLOUR = np.array([[0.299, 0.587, 0.114], [-0.299, -0.587, 0.886], [0.701, -0.587, -0.114]])
BLOCK = 128


class Grid:
    """Square patches of a picture: a grid, and the grid shifted by half a patch, row by row.

    A patch's mean is a product with one averaging matrix on either side, for any stack of planes at once.
    """

    def __init__(self, h: int, w: int, tile: int, shifted: bool = True) -> None:
        self.tile = tile
        self._sides: list[tuple[np.ndarray, np.ndarray]] = []
        places = []
        for offset in (0, tile // 2)[: 1 + shifted]:
            y, x = (np.arange(offset, n - tile + 1, tile) for n in (h, w))
            average = lambda starts, n: ((np.arange(n) >= starts[:, None]) & (np.arange(n) < starts[:, None] + tile)) / tile
            self._sides.append((average(y, h), average(x, w).T))
            places.append(np.stack(np.meshgrid(y, x, indexing="ij"), axis=-1).reshape(-1, 2))
        #: Upper left corners.
        self.corners = np.concatenate(places).astype(int).reshape(-1, 2)

    def means(self, planes: np.ndarray) -> np.ndarray:
        """... x h x w -> ... x patches."""
        planes = planes.astype(np.float64)
        return np.concatenate([(left @ planes @ right).reshape(*planes.shape[:-2], -1) for left, right in self._sides], axis=-1)


def corners(h: int, w: int, tile: int, shifted: bool = True) -> np.ndarray:
    return Grid(h, w, tile, shifted).corners


def colour_planes(frames: np.ndarray) -> np.ndarray:
    """1 or 3 x n x h x w: luma, and two colour differences where there is colour."""
    if frames.ndim == 3:
        return frames[None].astype(np.float64)
    return np.moveaxis(frames.astype(np.float64) @ COLOUR.T, -1, 0)


def is_night(frames: np.ndarray, looks: int = 20) -> bool:
    """No colour in any of some frames spread over the clip."""
    planes = colour_planes(frames[:: max(1, len(frames) // looks)])
    return len(planes) == 1 or bool((np.abs(planes[1:]).mean(axis=(1, 2, 3)) < 1).all())


def _overlapping(n: int, block: int) -> Iterator[tuple[int, int, int]]:
    """(first frame needed, first frame owned, end) of blocks; each but the first needs the frame before its own."""
    for a in range(0, n, block):
        yield max(a - 1, 0), a, min(a + block, n)


def small_steps(luma: np.ndarray, grid: Grid) -> np.ndarray:
    """2 x (n - 1) x patches: (across, down) of each patch's move from frame to frame, by one least-squares step.

    The normal equations of all patches are solved together; patches without texture in two directions stand still.
    """
    soft = blur(luma, 1.0, axes=(1, 2))
    slope = np.stack(np.gradient(soft, axis=(2, 1)))  # across, down
    slope = (slope[:, 1:] + slope[:, :-1]) / 2
    change = np.diff(soft, axis=0)
    normal = np.moveaxis(grid.means(slope[:, None] * slope[None]), (0, 1), (-2, -1))
    aim = -np.moveaxis(grid.means(slope * change), 0, -1)[..., None]
    trace = normal[..., 0, 0] + normal[..., 1, 1]
    solid = np.linalg.det(normal) > 1e-3 * np.maximum(trace, 1e-6) ** 2
    steps = np.linalg.solve(np.where(solid[..., None, None], normal, np.eye(2)), np.where(solid[..., None, None], aim, 0))
    return np.moveaxis(steps[..., 0], -1, 0)


def channels(frames: np.ndarray, tile: int = 16, shifted: bool = True, block: int = BLOCK) -> tuple[dict[str, np.ndarray], np.ndarray, bool]:
    """(channel -> n x patches, corners, night): brightness, texture, two colours unless it is night, and two summed shifts.

    Blocks of frames overlap by one frame, so their size changes nothing.
    """
    grid = Grid(*frames.shape[1:3], tile, shifted)
    night = is_night(frames)
    parts: dict[str, list[np.ndarray]] = {}
    for needed, own, end in _overlapping(len(frames), block):
        planes = colour_planes(frames[needed:end])
        luma = planes[0, own - needed :]
        mean, square = grid.means(np.stack((luma, luma * luma)))
        found = {"brightness": mean, "texture": np.sqrt(np.maximum(square - mean**2, 0))}
        if not night:
            found |= dict(zip(("blue-yellow", "red-green"), grid.means(planes[1:, own - needed :]), strict=True))
        steps = small_steps(planes[0], grid) if planes.shape[1] > 1 else np.zeros((2, 0, len(grid.corners)))
        if own == needed:  # the clip's first frame has none before it
            steps = np.concatenate((np.zeros((2, 1, len(grid.corners))), steps), axis=1)
        found |= dict(zip(("shift-across", "shift-up-down"), steps, strict=True))
        for name, values in found.items():
            parts.setdefault(name, []).append(values)
    series = {name: np.concatenate(values) for name, values in parts.items()}
    for name in ("shift-across", "shift-up-down"):
        series[name] = series[name].cumsum(axis=0)
    return series, grid.corners, night


def _jumps(frames: np.ndarray, grid: Grid, jump: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(frame, patch) of every patch with a pixel that jumps from the frame before, less frames in which many do, and their number."""
    at, where = [], []
    for needed, own, end in _overlapping(len(frames), BLOCK):
        grey = frames[needed:end].astype(np.float64)
        grey = grey if grey.ndim == 3 else np.floor(grey.mean(axis=3))
        hit = grid.means(np.abs(np.diff(grey, axis=0)) >= jump) > 1e-9
        hit[hit.mean(axis=1) > 0.05] = False
        k, p = np.nonzero(hit)
        at.append(k + needed + 1), where.append(p)
    return np.concatenate(at), np.concatenate(where), len(grid.corners)


def printed_clock(frames: np.ndarray, times: np.ndarray, tile: int = 16, shifted: bool = True, jump: int = 60) -> np.ndarray | None:
    """Which patches hold a printed time: single pixels there jump once a second at one moment of the second, and alone.

    Seeds jump at least every other second at one phase. They take in the patches that jump near the
    seeds' common moment and are connected to them by touch.
    """
    grid = Grid(*frames.shape[1:3], tile, shifted)
    frame, patch, n = _jumps(frames, grid, jump)
    turn = np.exp(2j * np.pi * times[frame])
    count = np.bincount(patch, minlength=n)
    total = np.bincount(patch, turn.real, n) + 1j * np.bincount(patch, turn.imag, n)
    seed = (count >= 0.5 * (times[-1] - times[0])) & (np.abs(total) >= 0.7 * count) & (count > 0)
    if not seed.any() or seed.mean() > 0.15:
        return None
    on_time = (turn * np.conj(total[seed].sum())).real >= 0  # within a quarter of a second of the seeds' moment
    member = seed | ((count >= 3) & (np.bincount(patch, on_time, n) >= 0.8 * count))
    index = np.flatnonzero(member)
    place = grid.corners[index]
    reach = np.abs(place[:, None] - place).max(axis=2) <= tile
    while True:  # paths of one, two, four ... touches
        further = reach.astype(np.float32) @ reach > 0
        if (further == reach).all():
            break
        reach = further
    out = np.zeros(n, bool)
    out[index[reach[:, seed[index]].any(axis=1)]] = True
    return out if out.mean() <= 0.15 else None
