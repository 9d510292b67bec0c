"""Configuration: a TOML file with shared settings and a section for each mode."""

from __future__ import annotations

import glob
import os
import tomllib
from dataclasses import dataclass, field, fields

from .errors import ConfigError
from .operators.mapping import mapping_paths
from .operators.movie import resolve_priority
from .plans.output import STRATEGIES

MODES = ("name", "file", "dir", "watch")
DEFAULT_FILE = "pagequarry.toml"


@dataclass
class Settings:
    """Settings of a mode, after those of the call, its section, the shared part and the defaults."""

    sources: list[str] = field(default_factory=list)
    input_name_rules: list[str] = field(default_factory=list)
    node_mapping: list[str] = field(default_factory=list)
    output: str = "{title}/{title}"
    multi_folder: str = "first"
    multi_source: bool = False
    multi_source_max_sources: int = 2
    priority_details: list[str] = field(default_factory=list)
    priority_images: list[str] = field(default_factory=list)
    save_images: bool = False
    max_depth: int = -1
    fetch_threads: int = 1
    throttle: bool = False  # pause between runs of one source
    throttle_ms: int = 1000
    translate: list[str] = field(default_factory=list)
    target_lang: str = ""
    endpoint: str = ""


_KINDS = {f.name: type(f.default if f.default_factory is not list else []) for f in fields(Settings)}


def _checked(section: dict, where: str) -> dict:
    out = {}
    for k, v in section.items():
        name = k.replace("-", "_")
        if name not in _KINDS:
            raise ConfigError(f"{where}: unknown key {k!r}")
        v = [v] if _KINDS[name] is list and isinstance(v, str) else v  # one or many
        if not isinstance(v, _KINDS[name]) or _KINDS[name] is int and isinstance(v, bool) or isinstance(v, list) and not all(isinstance(x, str) for x in v):
            raise ConfigError(f"{where}: {k} must be {_KINDS[name].__name__}")
        out[name] = v
    if out.get("multi_folder", "first") not in STRATEGIES:
        raise ConfigError(f"{where}: unknown strategy {out['multi_folder']!r}")
    if out.get("max_depth", -1) < -1 or out.get("fetch_threads", 0) < 0:
        raise ConfigError(f"{where}: number out of range")
    return out


def load(path: str | None = None) -> dict:
    """The file at path, else the default file if there is one, else nothing; checked."""
    if path is None and not os.path.exists(DEFAULT_FILE):
        return {}
    try:
        with open(path or DEFAULT_FILE, "rb") as f:
            data = tomllib.load(f)
    except OSError as e:
        raise ConfigError(str(e)) from None
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path or DEFAULT_FILE}: {e}") from None
    shared = {k: v for k, v in data.items() if not isinstance(v, dict)}
    for k, v in data.items():
        if isinstance(v, dict) and k not in MODES:
            raise ConfigError(f"unknown section {k!r}")
    return {"": _checked(shared, "shared")} | {m: _checked(data[m], m) for m in MODES if m in data}


def resolve(config: dict, mode: str, call: dict | None = None) -> Settings:
    """Each setting from the call, else the mode's section, else the shared part, else its default."""
    own, shared, call = config.get(mode, {}), config.get("", {}), {k: v for k, v in (call or {}).items() if v is not None}
    out = Settings(**(shared | own | _checked(call, "call")))
    out.node_mapping = mapping_paths(call.get("node_mapping", []), own.get("node_mapping", []), shared.get("node_mapping", []))
    for group in ("priority_details", "priority_images"):
        setattr(out, group, resolve_priority(call.get(group) or own.get(group), shared.get(group)))
    return out


def all_sources(config: dict) -> list[str]:
    """Source paths of all sections, globbed, each once."""
    return expand([p for section in ("", *MODES) for p in config.get(section, {}).get("sources", [])])


def expand(patterns: list[str]) -> list[str]:
    """Paths that patterns match, sorted; * and ? stay in a component, ** crosses them; an unmatched pattern stays."""
    out: list[str] = []
    for p in patterns:
        out += sorted(glob.glob(p, recursive=True)) or [p]
    return list(dict.fromkeys(out))
