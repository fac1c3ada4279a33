"""Settings from TOML files and the environment; later ones win key by key."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any

from ..functions.patterns import EXCLUDE_DIRS, INCLUDE_DIRS, INCLUDE_PATTERNS


class SettingsError(ValueError):
    """A setting that is missing, misspelt or of the wrong type."""


@dataclass(frozen=True)
class Settings:
    """``None`` for a list of exclusions means unset, which refuses; an empty list excludes nothing."""

    scan_root: str = ""
    include_patterns: tuple[str, ...] = INCLUDE_PATTERNS
    include_dirs: tuple[str, ...] = INCLUDE_DIRS
    exclude_dirs: tuple[str, ...] = EXCLUDE_DIRS
    exclude_paths: tuple[str, ...] = ()
    exclude_projects: tuple[str, ...] | None = None
    git_enabled: bool = False
    author_emails: tuple[str, ...] = ()
    author_names: tuple[str, ...] = ()
    diff_excerpt_chars: int = 800
    thin_message_chars: int = 200
    service_exclude_projects: tuple[str, ...] | None = None
    max_searches: int = 50


#: Table and key in a file, for each setting.
KEYS = {
    "discovery": {k: k for k in ("include_patterns", "include_dirs", "exclude_dirs", "exclude_paths", "exclude_projects")},
    "git": {"enabled": "git_enabled", **{k: k for k in ("author_emails", "author_names", "diff_excerpt_chars", "thin_message_chars")}},
    "mcp": {"exclude_projects": "service_exclude_projects", "max_searches": "max_searches"},
}


def _checked(name: str, value: Any) -> Any:
    default = getattr(Settings, name)
    if isinstance(default, bool):
        fits = isinstance(value, bool)
    elif isinstance(default, int):
        fits = isinstance(value, int) and not isinstance(value, bool) and value > 0
    else:
        fits = isinstance(value, list) and all(isinstance(v, str) for v in value)
        value = tuple(value) if fits else value
    if not fits:
        raise SettingsError(f"{name} has a value of the wrong type: {value!r}")
    return value


def parse(text: str, name: str = "settings") -> dict[str, Any]:
    try:
        said = tomllib.loads(text)
    except tomllib.TOMLDecodeError as problem:
        raise SettingsError(f"{name}: {problem}") from problem
    out: dict[str, Any] = {}
    for table, entries in said.items():
        if table == "scan":
            continue  # the leak scan reads its own
        if table not in KEYS or not isinstance(entries, dict):
            raise SettingsError(f"{name}: unknown table {table!r}")
        for key, value in entries.items():
            if key not in KEYS[table]:
                raise SettingsError(f"{name}: unknown key {table}.{key}")
            out[KEYS[table][key]] = _checked(KEYS[table][key], value)
    return out


def load(paths: list[Path], environment: Mapping[str, str] = os.environ) -> Settings:
    """Defaults, then each file that is there, then the environment's scan root."""
    found = Settings()
    for path in paths:
        if path.exists():
            found = replace(found, **parse(path.read_text(encoding="utf-8"), path.name))
    root = environment.get("LOREKEEP_SCAN_ROOT", "").strip()
    if not root:
        raise SettingsError("LOREKEEP_SCAN_ROOT is not set")
    if not Path(root).is_dir():
        raise SettingsError(f"the scan root is no folder: {root}")
    return replace(found, scan_root=str(Path(root).resolve()))


def required_exclusions(value: tuple[str, ...] | None, name: str) -> tuple[str, ...]:
    if value is None:
        raise SettingsError(f"{name} is not set; set it to [] to exclude nothing")
    return value


@dataclass(frozen=True)
class Accepted:
    file: str
    match: str
    count: int
    note: str


@dataclass(frozen=True)
class ScanSettings:
    terms: tuple[str, ...]
    accepted: tuple[Accepted, ...]
    #: Private values that the other tables hold: authors and projects that are left out.
    config_terms: tuple[str, ...] = ()

    @property
    def all_terms(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.terms, *self.config_terms]))


#: Settings whose values must not be published.
PRIVATE = ("author_emails", "author_names", "exclude_projects", "service_exclude_projects")


def scan_settings(path: Path) -> ScanSettings:
    """Private terms and accepted hits from the local file; whatever is odd refuses, by position."""
    try:
        whole = path.read_text(encoding="utf-8")
        said = tomllib.loads(whole).get("scan")
    except (OSError, tomllib.TOMLDecodeError) as problem:
        raise SettingsError(f"{path.name} cannot be read") from problem
    if not isinstance(said, dict) or set(said) - {"private_terms", "accepted"} or "private_terms" not in said:
        raise SettingsError("[scan] needs private_terms, and may have accepted")
    terms = said["private_terms"]
    if not isinstance(terms, list) or not all(isinstance(t, str) and t.strip() for t in terms):
        raise SettingsError("private_terms must be a list of texts")
    names = [f.name for f in fields(Accepted)]
    out = []
    for position, entry in enumerate(said.get("accepted", []), 1):
        fits = isinstance(entry, dict) and set(entry) == set(names)
        fits = fits and all(isinstance(entry[n], str) and entry[n].strip() for n in names if n != "count")
        if not fits or not isinstance(entry["count"], int) or isinstance(entry["count"], bool) or entry["count"] < 1:
            raise SettingsError(f"accepted entry #{position} is not usable")
        out.append(Accepted(**entry))
    own = parse(whole, path.name)
    held = [value for name in PRIVATE for value in own.get(name) or () if value.strip()]
    return ScanSettings(tuple(terms), tuple(out), tuple(dict.fromkeys(held)))
