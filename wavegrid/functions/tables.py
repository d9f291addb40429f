"""Fixed reference data: scales, tunings, palettes, notations. All of it is stated, none computed."""

from __future__ import annotations

# Semitone offsets from the root, equal-tempered.
SCALES = {
    "minor_pent": [0, 3, 5, 7, 10],
    "major_pent": [0, 2, 4, 7, 9],
    "major": [0, 2, 4, 5, 7, 9, 11],
    "minor": [0, 2, 3, 5, 7, 8, 10],
    "dorian": [0, 2, 3, 5, 7, 9, 10],
    "phrygian": [0, 1, 3, 5, 7, 8, 10],
    "lydian": [0, 2, 4, 6, 7, 9, 11],
    "whole_tone": [0, 2, 4, 6, 8, 10],
    "chromatic": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11],
    "octatonic": [0, 2, 3, 5, 6, 8, 9, 11],
    "hirajoshi": [0, 2, 3, 7, 8],
    "in_sen": [0, 1, 5, 7, 10],
}

# Frequency ratios to the root.
RATIO_SCALES = {
    "babylonian": [1 / 1, 9 / 8, 81 / 64, 4 / 3, 3 / 2, 27 / 16, 243 / 128],
    "babylonian_pent": [1 / 1, 9 / 8, 4 / 3, 3 / 2, 27 / 16],
    "just_major": [1 / 1, 9 / 8, 5 / 4, 4 / 3, 3 / 2, 5 / 3, 15 / 8],
    "just_minor": [1 / 1, 9 / 8, 6 / 5, 4 / 3, 3 / 2, 8 / 5, 9 / 5],
    "just_pent": [1 / 1, 9 / 8, 5 / 4, 3 / 2, 5 / 3],
    "just_minor_pent": [1 / 1, 6 / 5, 4 / 3, 3 / 2, 9 / 5],
    "harmonic": [1 / 1, 9 / 8, 5 / 4, 11 / 8, 3 / 2, 13 / 8, 7 / 4, 15 / 8],
}

# Strings 1 to 7 of the seven lyre tunings.
TUNINGS = {
    "isartum": "E F G A B C D",
    "kitmum": "E F# G A B C D",
    "embubum": "E F# G A B C# D",
    "pitum": "E F# G# A B C# D",
    "nid_qablim": "E F# G# A B C# D#",
    "nis_gabari": "E F# G# A# B C# D#",
    "qablitum": "E# F# G# A# B C# D#",
}

# Place of each note on the chain of fifths.
FIFTHS = {"F": -1, "C": 0, "G": 1, "D": 2, "A": 3, "E": 4, "B": 5, "F#": 6, "C#": 7, "G#": 8, "D#": 9, "A#": 10, "E#": 11}

# Names of the twelve semitones.
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]

# General MIDI programs of the voices.
VOICE_PROGRAMS = {"vibes": 11, "piano": 0, "harp": 46, "pad": 89, "vibraphone": 11, "lyre": 107, "reed": 111}

# Ten stops of each palette.
PALETTES = {
    "viridis": ["#440154", "#482878", "#3e4989", "#31688e", "#26828e", "#1f9e89", "#35b779", "#6ece58", "#b5de2b", "#fde725"],
    "magma": ["#000004", "#180f3d", "#440f76", "#721f81", "#9e2f7f", "#cd4071", "#f1605d", "#fd9668", "#feca8d", "#fcfdbf"],
    "inferno": ["#000004", "#1b0c41", "#4a0c6b", "#781c6d", "#a52c60", "#cf4446", "#ed6925", "#fb9b06", "#f7d13d", "#fcffa4"],
}

# String pairs of the tablet's terms, and the first two lines of its notation.
STRING_PAIRS = {
    "qablite": (5, 2), "irbute": (2, 7), "šaḫri": (7, 5), "išarte": (2, 6), "titimišarte": (3, 5), "zirte": (4, 6), "šaššate": (1, 6),
    "nīš tuḫrim": (1, 5), "embūbum": (3, 7), "nīd qablim": (4, 1), "isqum": (1, 3), "titur qablītim": (2, 4), "kitmum": (6, 3), "pītum": (7, 4),
}
NOTATION = [
    ("qablite", 3), ("irbute", 1), ("qablite", 3), ("šaḫri", 1), ("išarte", 10),
    ("titimišarte", 2), ("zirte", 1), ("šaḫri", 2), ("šaššate", 2), ("irbute", 2),
]

# Letters of the vocal notation as ratios to A4, and the song as syllables of (letter, units).
LETTERS = {"Z": 3 / 2, "I": 4 / 3, "K": 81 / 64, "O": 9 / 8, "C": 1 / 1, "Φ": 8 / 9, "X": 27 / 32, "Γ": 3 / 4}
SONG = [
    ("Ho", [("C", 1)]), ("son", [("Z", 2)]), ("zēs", [("Z", 3)]), ("phai", [("K", 1), ("I", 1)]), ("nou", [("Z", 1), ("I", 3)]),
    ("mē", [("K", 2)]), ("den", [("I", 1)]), ("ho", [("Z", 1)]), ("lōs", [("I", 1), ("K", 1)]), ("sy", [("O", 1)]), ("ly", [("C", 2)]), ("pou", [("O", 1), ("Φ", 2)]),
    ("pros", [("C", 1)]), ("o", [("K", 1)]), ("li", [("Z", 1)]), ("gon", [("I", 1)]), ("es", [("K", 1), ("I", 1)]), ("ti", [("K", 1)]), ("to", [("C", 2)]), ("zēn", [("O", 1), ("Φ", 2)]),
    ("to", [("C", 1)]), ("te", [("K", 1)]), ("los", [("O", 1)]), ("ho", [("I", 1)]), ("chro", [("Z", 1)]), ("nos", [("K", 1)]), ("ap", [("C", 1)]), ("ai", [("C", 2)]),
    ("tei", [("C", 1), ("X", 1), ("Γ", 1)]),
]

# Pitches of glide voices.
GLIDE_CENTRES = [220.0, 329.63, 146.83, 440.0, 110.0, 293.66]

# Units, and the sizes below which a rhythm cannot be seen or is dropped, of the patch channels.
CHANNELS = {
    "brightness": ("levels", 1.5, 0.03), "blue-yellow": ("levels", 1.5, 0.03), "red-green": ("levels", 1.5, 0.03),
    "shift-across": ("px", 0.2, 0.003), "shift-up-down": ("px", 0.2, 0.003), "texture": ("levels", 1.5, 0.03),
}

# Sections of a recipe and the keys that each allows.
RECIPE_KEYS = {
    "source": ["frames", "audio"],
    "audio": ["sr", "rows", "cols", "f_lo", "f_hi", "tile", "sheet_columns"],
    "output": ["dir"],
    "encode": ["sr", "rows", "cols", "f_lo", "f_hi", "col_sec", "gamma", "threshold", "auto_prep", "no_normalize", "color", "color_width", "lens", "lens_params"],
    "decode": ["enabled", "lens", "lens_params", "palette"],
    "notate": ["enabled", "base", "scale", "root", "bpm", "grid", "voices", "f_lo", "f_hi", "peak_rel", "decay", "program", "dry_mix", "transcribe_opts", "midi", "verify"],
    "notes_decode": ["enabled", "color", "trim"],
    "assemble": ["enabled", "from", "output"],
}
# Defaults of audio sources, and the files of each stage, the completion marker last.
AUDIO_DEFAULTS = {"sr": 22050, "rows": 300, "cols": 600, "f_lo": "auto", "f_hi": "auto", "tile": 30, "sheet_columns": 4}
STAGE_OUTPUTS = {
    "encode": ["{n}.chroma.png", "{n}.wav"],
    "decode": ["{n}.png"],
    "notate": ["{n}.notes.mid", "{n}.verify.json", "{n}.notes.wav"],
    "notes_decode": ["{n}.notes.png"],
}

# Formants of the reed voice, as centre (Hz), width and height.
REED_FORMANTS = [(1150, 600, 1.0), (2700, 900, 0.45), (550, 400, 0.4)]

# Centres in Hz of the gliding voices, in the order in which tracks take them.
GLIDE_CENTRES = [220.0, 329.63, 146.83, 440.0, 110.0, 293.66]

# Frequency ranges and sample rates by name.
RANGES = {
    "standard": {"f_lo": 80, "f_hi": 8000, "sr": 22050},
    "low": {"f_lo": 40, "f_hi": 4000, "sr": 22050},
    "full": {"f_lo": 40, "f_hi": 20000, "sr": 44100},
}
