"""MIDI files, format 0, from notes."""

from __future__ import annotations

import math
import struct

TICKS = 480


def quantity(n: int) -> bytes:
    """Variable-length quantity."""
    out = [n & 127]
    while n := n >> 7:
        out.append((n & 127) | 128)
    return bytes(reversed(out))


def read_quantity(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, place after it)."""
    n = 0
    while True:
        n = (n << 7) | (data[at] & 127)
        at += 1
        if data[at - 1] < 128:
            return n, at


def encode(notes: list[tuple[float, float, float, int]], bpm: float, program: int = 0) -> bytes:
    """One track of (start beat, beats, Hz, velocity): tempo, program, then events by tick, off before on."""
    events = []
    for start, beats, hz, velocity in notes:
        midi = min(127, max(0, round(69 + 12 * math.log2(hz / 440))))
        events += [(int(start * TICKS), 1, bytes([0x90, midi, velocity])), (int((start + beats) * TICKS), 0, bytes([0x80, midi, 0]))]
    track = b"\0\xff\x51\x03" + struct.pack(">I", round(60e6 / bpm))[1:] + bytes([0, 0xC0, program])
    now = 0
    for tick, _, message in sorted(events):
        track += quantity(tick - now) + message
        now = tick
    track += b"\0\xff\x2f\0"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, TICKS) + b"MTrk" + struct.pack(">I", len(track)) + track
