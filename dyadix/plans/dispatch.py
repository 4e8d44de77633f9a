"""Which plan an input of a given size gets, and the calibration that decides it: thresholds from a table, a JSON cache."""

from __future__ import annotations

import json
import os
import sys
import warnings
from math import inf, log2
from pathlib import Path

from pyspark.sql import DataFrame

# Default thresholds in points, serial.
DEFAULTS = {"approx": 142_167.0, "exact": 95_924.0}
DEFAULT_DEPTH, DEFAULT_DIV = 6, 4
MODES = ("approx", "exact")
_calibrated: dict[str, dict] = {}


def _name(mode: str, parallel: bool) -> str:
    return f"{mode}_parallel" if parallel else mode


def work(mode: str, n_series: int, length: int) -> float:
    return n_series * length * (1.0 if mode == "approx" else log2(length) - 2.5)


def threshold(mode: str, parallel: bool = False) -> float:
    """The calibrated threshold, the serial one where there is no parallel one, else the default."""
    for name in ([_name(mode, True)] if parallel else []) + [mode]:
        if name in _calibrated:
            return _calibrated[name]["value"]
    return DEFAULTS[mode]


def blocks_pay(mode: str, n_series: int, length: int, parallel: bool = False) -> bool:
    return work(mode, n_series, length) > threshold(mode, parallel)


def mismatch(mode: str, depth: int, div: int, parallel: bool = False) -> list[str]:
    own = _calibrated.get(_name(mode, parallel), {"depth": DEFAULT_DEPTH, "div": DEFAULT_DIV})
    same = own.get("depth") in (None, depth) and own.get("div") in (None, div)
    return [] if same else [f"the threshold of {mode} was calibrated for depth {own['depth']} and div {own['div']}"]


def known_size(df: DataFrame) -> int | None:
    """Rows of a local relation or range without running a job; None otherwise (large inputs go by blocks)."""
    stats = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
    return int(stats.get().toString()) if stats.isDefined() else None


def cache_path() -> Path:
    base = os.environ.get("XDG_CACHE_HOME") or (os.environ.get("LOCALAPPDATA") if sys.platform == "win32" else None)
    home = Path.home()
    root = Path(base) if base else home / ("Library/Caches" if sys.platform == "darwin" else ".cache")
    return root / "dyadix" / "dispatch_thresholds.json"


def _read(path: Path) -> dict:
    return json.loads(path.read_text()) if path.exists() else {}


def calibrate(table: DataFrame, modes: tuple[str, ...] = MODES, parallel: bool = False, strict: bool = True, save: bool = True, path: Path | None = None) -> dict[str, float]:
    """Take thresholds from a table with (mode, depth, div, kappa, delta, nl_threshold): one row per mode.

    A slope difference of zero or less means that blocks never pay."""
    unknown = set(modes) - set(MODES)
    if unknown:
        raise ValueError(f"unknown modes {sorted(unknown)}")
    rows: dict[str, list] = {}
    held = table.where(table.mode.isin(list(modes))).limit(101).collect()
    if len(held) > 100:  # never judged by a part of its rows
        raise ValueError("over a hundred rows; a table of thresholds has one for each mode")
    for r in held:
        rows.setdefault(r["mode"], []).append(r.asDict())
    out = {}
    for mode in modes:
        if len(rows.get(mode, [])) != 1:
            if strict:
                raise ValueError(f"{len(rows.get(mode, []))} rows for mode {mode}, not one")
            warnings.warn(f"no single row for mode {mode}", stacklevel=2)
            continue
        r = rows[mode][0]
        out[mode] = inf if r["delta"] <= 0 else float(r["nl_threshold"])
        _calibrated[_name(mode, parallel)] = {"value": out[mode], "depth": r.get("depth"), "div": r.get("div")}
    if save and out:
        path = Path(path or cache_path())
        path.parent.mkdir(parents=True, exist_ok=True)
        held = _read(path) | {_name(m, parallel): {**_calibrated[_name(m, parallel)], "value": -1.0 if v == inf else v} for m, v in out.items()}
        path.write_text(json.dumps(held, indent=1))
    return out


def load_cached(path: Path | None = None, modes: tuple[str, ...] = MODES) -> dict[str, float]:
    """Read the cache; an entry may be a bare number (the older form); a negative value means never."""
    out = {}
    for name, entry in _read(Path(path or cache_path())).items():
        if name.removesuffix("_parallel") not in modes:
            continue
        entry = entry if isinstance(entry, dict) else {"value": entry, "depth": None, "div": None}
        if entry["value"] < 0:
            warnings.warn(f"{name}: blocks were never faster when this was calibrated", stacklevel=2)
        _calibrated[name] = entry | {"value": inf if entry["value"] < 0 else float(entry["value"])}
        out[name] = _calibrated[name]["value"]
    return out


def reset(modes: tuple[str, ...] = MODES, parallel: bool | None = None, delete_cache: bool = False, path: Path | None = None) -> None:
    names = [_name(m, p) for m in modes for p in ((False, True) if parallel is None else (parallel,))]
    for n in names:
        _calibrated.pop(n, None)
    path = Path(path or cache_path())
    if delete_cache and path.exists():
        left = {k: v for k, v in _read(path).items() if k not in names}
        path.write_text(json.dumps(left, indent=1)) if left else path.unlink()
