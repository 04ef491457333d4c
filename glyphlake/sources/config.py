"""Configuration: discovery, strict reading, and the options it stands for."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from glyphlake.sources.files import Files

TOOL = "glyphlake"
NAMES = (f".{TOOL}.toml", f"{TOOL}.toml")


class ConfigError(ValueError):
    pass


@dataclass
class Lint:
    preset: str = "default"
    select: list[str] | None = None
    extend_select: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    info_strings: list[str] = field(default_factory=list)
    renderer: str = "mathjax-v3"
    packages: list[str] = field(default_factory=list)
    macros: dict[str, int] = field(default_factory=dict)


@dataclass
class Fmt:
    """Formatting options; the defaults change nothing but tables and line ends."""

    profile: str = "preserve"
    wrap: str | int = "keep"  # keep, no, or a width
    wrap_strategy: str = "stable"  # balanced
    italic: str = "preserve"  # asterisk, underscore
    strong: str = "preserve"
    list_marker: str = "preserve"  # dash, asterisk, plus
    ordered_list: str = "preserve"  # one, consistent
    thematic_break: str = "preserve"  # dash, asterisk, underscore, underscore-70
    trailing_newline: str = "preserve"  # strip, ensure
    end_of_line: str = "lf"  # crlf, keep
    heading_attrs: str = "preserve"  # canonicalise
    blank_line_before_heading: str = "preserve"  # one
    blank_line_after_heading: str = "preserve"
    refs_style: str = "preserve"  # bare, angle
    tables_style: str = "compact"  # align, preserve
    continuation_indent: str = "marker-width"  # four-space
    frontmatter_preserve: bool = True
    math_normalise: bool = False
    math_render: str = "none"  # dollar, commonmark-katex
    exclude: list[str] = field(default_factory=list)


@dataclass
class Config:
    lint: Lint = field(default_factory=Lint)
    fmt: Fmt = field(default_factory=Fmt)
    math_delimiters: str = "tex"
    autolinks: str = "urls-and-emails"
    render_profile: str = "default"


_CHOICES = {
    ("lint", "preset"): {"default", "all", "none"}, ("fmt", "wrap_strategy"): {"stable", "balanced"}, ("fmt", "italic"): {"preserve", "asterisk", "underscore"},
    ("fmt", "strong"): {"preserve", "asterisk", "underscore"}, ("fmt", "list_marker"): {"preserve", "dash", "asterisk", "plus"}, ("fmt", "ordered_list"): {"preserve", "one", "consistent"},
    ("fmt", "thematic_break"): {"preserve", "dash", "asterisk", "underscore", "underscore-70"}, ("fmt", "trailing_newline"): {"preserve", "strip", "ensure"},
    ("fmt", "end_of_line"): {"lf", "crlf", "keep"}, ("fmt", "tables_style"): {"compact", "align", "preserve"}, ("fmt", "refs_style"): {"preserve", "bare", "angle"},
}


def discover(start: str, files: Files) -> str | None:
    """The nearest configuration above a path; the search ends at a repository's root."""
    folder = files.absolute(start)
    folder = folder.rsplit("/", 1)[0] if files.is_file(folder) else folder
    while True:
        for name in NAMES:
            if files.is_file(path := f"{folder}/{name}"):
                return path
        path = f"{folder}/pyproject.toml"
        if files.is_file(path) and TOOL in tomllib.loads(files.read(path)).get("tool", {}):
            return path
        above = folder.rsplit("/", 1)[0]
        if files.exists(f"{folder}/.git") or above == folder or above.endswith((":", "/")) or "/" not in above:
            return None
        folder = above


def _fill(target: object, values: dict, where: str) -> None:
    known = {f.name for f in fields(target)}
    for key, value in values.items():
        name = key.replace("-", "_")
        if isinstance(value, dict) and name not in known:
            _fill(target, {f"{name}_{k}" if f"{name}_{k.replace('-', '_')}" in known else k: v for k, v in value.items()}, f"{where}.{key}")
            continue
        if name not in known:
            raise ConfigError(f"unknown key {where}.{key}")
        if (allowed := _CHOICES.get((where.split(".")[0], name))) and value not in allowed:
            raise ConfigError(f"{where}.{key} must be one of {', '.join(sorted(allowed))}")
        setattr(target, name, value)


def load(text: str) -> Config:
    raw = tomllib.loads(text)
    raw = raw.get("tool", {}).get(TOOL, raw) if "tool" in raw else raw
    config = Config()
    for key, value in raw.items():
        if key in ("lint", "fmt"):
            _fill(getattr(config, key), value, key)
        elif key == "parse":
            config.math_delimiters = value.get("math", {}).get("delimiters", "tex")
            config.autolinks = value.get("extensions", {}).get("gfm", {}).get("autolinks", config.autolinks)
        elif key == "render":
            config.render_profile = value.get("profile", config.render_profile)
        else:
            raise ConfigError(f"unknown key {key}")
    return config


def resolve(files: Files, start: str | None = None, explicit: str | None = None) -> Config:
    path = explicit or (discover(start, files) if start else None)
    return Config() if path is None else load(files.read(path))


def default_toml() -> str:
    """A configuration that spells all defaults."""

    def value(v: object) -> str:
        return "true" if v is True else "false" if v is False else f'"{v}"' if isinstance(v, str) else "{}" if v == {} else str(v)

    out = []
    for name in ("lint", "fmt"):
        part = getattr(Config(), name)
        out.append(f"[{name}]")
        out += [f"{f.name.replace('_', '-')} = {value(getattr(part, f.name))}" for f in fields(part) if getattr(part, f.name) is not None]
    return "\n".join(out) + "\n"
