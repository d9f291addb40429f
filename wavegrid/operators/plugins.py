"""Lenses from files: every Python file of a folder that names itself adds an image lens or a motion lens.

A file sets NAME, may set DESCRIPTION, and defines ``lens(picture, params)`` or ``motion_lens(frames, times,
params)``. Files and names that begin with _ are skipped; a file that cannot be loaded is left out with a
warning. The files' functions travel to the executors by value.
"""

from __future__ import annotations

import importlib.util
import json
import os
import warnings
from types import ModuleType

from wavegrid.operators import lenses, motion


def load(path: str) -> ModuleType:
    """The module of a file, not listed among the importable ones."""
    spec = importlib.util.spec_from_file_location(f"lens_{os.path.splitext(os.path.basename(path))[0]}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def discover(folder: str) -> list[str]:
    """Registers the lenses of a folder and returns their names, in order."""
    found = []
    for file in sorted(f for f in os.listdir(folder) if f.endswith(".py") and not f.startswith("_")):
        try:
            module = load(os.path.join(folder, file))
            name = module.NAME
        except Exception as e:
            warnings.warn(f"{file} left out: {type(e).__name__}: {e}", stacklevel=2)
            continue
        if hasattr(module, "lens"):
            lenses.register(name, getattr(module, "DESCRIPTION", ""), module.lens)
        if hasattr(module, "motion_lens"):
            motion.register(name, module.motion_lens)
        if name in lenses.catalog() or name in motion._LENSES:
            found.append(name)
    return found


def listing() -> str:
    """All image lenses with their descriptions, and the names of the motion lenses, as JSON."""
    return json.dumps({"lenses": lenses.catalog(), "motion": sorted(motion._LENSES)}, sort_keys=True)
