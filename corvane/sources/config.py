"""Settings as a TOML file over defaults."""

from __future__ import annotations

import tomllib
from copy import deepcopy
from pathlib import Path

from corvane.functions.scoring import QUALITY_WEIGHTS
from corvane.functions.templates import TEMPLATES
from corvane.sources.files import MAX_DEPTH, MIN_BYTES, SKIPPED_FOLDERS, SKIPPED_PARTS

# Settings that hold where a file names none.
DEFAULTS = {
    "scan": {"max_depth": MAX_DEPTH, "min_bytes": MIN_BYTES, "skipped_folders": SKIPPED_FOLDERS, "skipped_parts": SKIPPED_PARTS, "follow_links": False, "noise_words": []},
    "lookup": {"chain": ["local", "tmdb", "musicbrainz", "ai", "guess"], "concurrency": 3},
    "dedup": {"keep_strategy": "HighestQuality", "action": "Trash", "move_target": ""},
    "rename": {"templates": dict(TEMPLATES), "season_offset": 0, "rename_subtitles": True, "preserve_media_suffix": False},
    "organize": {"mode": "archive", "link": "none", "root": "", "with_sidecars": False, "with_images": False, "cleanup_empty_folders": False},
    "quality": {"weights": dict(QUALITY_WEIGHTS)},
    "cache": {"days": 90},
}


def merged(base: dict, over: dict) -> dict:
    """Settings of `over` in place of those of `base`, tables within tables; tables and settings that base doesn't know are kept."""
    out = deepcopy(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else deepcopy(value)
    return out


def load(path: str | Path) -> dict:
    """The settings of a file over the defaults; the defaults if there is no such file.  A file that isn't TOML is an error."""
    try:
        with open(path, "rb") as f:
            return merged(DEFAULTS, tomllib.load(f))
    except FileNotFoundError:
        return deepcopy(DEFAULTS)


def _toml(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml, value)) + "]"
    text = str(value).replace("\\", "\\\\").replace('"', '\\"')
    return '"' + "".join(c if c >= " " and c != "\x7f" else f"\\u{ord(c):04x}" for c in text) + '"'


def _key(name: str) -> str:
    return name if name and all(c.isascii() and (c.isalnum() or c in "-_") for c in name) else _toml(name)


def dumps(settings: dict, at: str = "") -> str:
    lines = [f"{_key(k)} = {_toml(v)}" for k, v in settings.items() if not isinstance(v, dict)]
    for k, v in settings.items():
        if isinstance(v, dict):
            name = f"{at}.{_key(k)}" if at else _key(k)
            lines += [f"\n[{name}]", dumps(v, name)]
    return "\n".join(lines)


def save(settings: dict, path: str | Path) -> None:
    """Writes settings, so that load() reads the same; the folder is made if need be."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(dumps(settings) + "\n", encoding="utf-8")
