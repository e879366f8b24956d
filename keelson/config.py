"""Layers, ordered patterns, extern groups, naming and flow of a project."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path


@dataclass(frozen=True)
class Pattern:
    """One rule of the classifier: where a symbol lies and what it looks like."""

    id: str
    layer: str
    path: str | None = None
    kinds: tuple[str, ...] = ()
    name: str | None = None
    has_field: str | None = None
    not_has_field: str | None = None
    derives: tuple[str, ...] = ()
    returns: str | None = None
    implements_port: bool = False
    externs: tuple[str, ...] = ()
    group: str | None = None


@dataclass(frozen=True)
class Layer:
    id: str
    title: str = ""
    sub: str = ""


@dataclass(frozen=True)
class Config:
    layers: tuple[Layer, ...] = ()
    patterns: tuple[Pattern, ...] = ()
    externs: dict[str, tuple[str, ...]] = field(default_factory=dict)
    forbid_in_domain: tuple[str, ...] = ()
    flow: tuple[str, ...] = ()
    crate_graph: str = "A"
    root: str = "src"

    def group(self, name: str) -> tuple[str, ...]:
        return self.externs.get(name, ())

    def layer_dirs(self) -> list[tuple[str, str]]:
        """(directory prefix, layer), longest first, of patterns placed by prefix."""
        found = dict.fromkeys((p.path, p.layer) for p in self.patterns if p.path is not None and not p.path.startswith("^"))
        return sorted(found, key=lambda x: -len(x[0]))


def valid_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


#: Fixed values of the built-in profile: flow, layers, patterns in order, extern groups, naming.
PROFILE = Config(
    flow=("command-handler", "service", "use-case", "port", "store"),
    layers=(
        Layer("application", "Application"),
        Layer("domain", "Domain"),
        Layer("infrastructure", "Infrastructure"),
        Layer("composition-root", "Composition Root"),
        Layer("test", "Test"),
    ),
    patterns=(
        Pattern("port", "domain", "domain/ports/", ("trait",)),
        Pattern("use-case", "domain", "domain/use_cases/", ("fn",), name="^(start|stop|add|create|delete|update|list|find|scan|register|import|export|move|rename|open|close|record)_"),
        Pattern("service", "domain", "domain/services/", ("fn", "struct")),
        Pattern("validator", "domain", "domain/", ("fn",), name="^validate_"),
        Pattern("converter", "domain", "domain/", ("fn",), name="^(to_|from_)|_to_"),
        Pattern("projection", "domain", "domain/", ("struct", "enum"), name="Projection$"),
        Pattern("entity", "domain", "domain/", ("struct",), has_field="id"),
        Pattern("value-object", "domain", "domain/", ("struct", "enum"), derives=("PartialEq",), not_has_field="id"),
        Pattern("store", "infrastructure", "infra/", ("struct",), implements_port=True, group="infra-impl", externs=("rusqlite", "sled", "sqlx", "diesel", "redis", "toml", "serde_json")),
        Pattern("adapter", "infrastructure", "infra/", ("struct",), implements_port=True, group="infra-impl", externs=("std::fs", "std::process", "std::net", "reqwest", "arboard", "ureq")),
        Pattern("command-handler", "application", "application/", ("fn",), name="^(cmd_|handle_|run_)"),
        Pattern("renderer", "application", "application/", ("fn",), name="^(render_|draw_|view_)"),
        Pattern("view-model", "application", "application/", ("struct", "enum"), name="(Row|Panel|View|Command|Args|Cli)$"),
        Pattern("composition-root", "composition-root", "^(main\\.rs|application/tui/run\\.rs)$", ("fn",), name="^(main|run)$"),
    ),
    externs={
        "io": ("std::fs", "std::process", "std::net", "std::env", "rusqlite", "reqwest"),
        "render": ("ratatui", "crossterm", "termion"),
        "time": ("std::time::SystemTime::now", "chrono::Local::now", "std::time::Instant::now"),
    },
    forbid_in_domain=("Dto", "DTO"),
)


def _pattern(t: dict) -> Pattern:
    shape = t.get("symbol", {})
    kinds = shape.get("kind", ())
    return Pattern(
        t["id"], t.get("layer", ""), t.get("path"), (kinds,) if isinstance(kinds, str) else tuple(kinds), shape.get("name"), shape.get("has_field"), shape.get("not_has_field"),
        tuple(shape.get("derives", ())), shape.get("returns"), bool(shape.get("implements_port")), tuple(t.get("externs", ())), t.get("group"),
    )


def parse(text: str) -> Config:
    """A configuration from TOML.

    With `extends`, each section that is missing or empty is taken from the profile, and
    `add_pattern` entries go before the patterns.
    """
    t = tomllib.loads(text)
    naming = t.get("naming", {})
    own = Config(
        tuple(Layer(x["id"], x.get("title", x["id"]), x.get("sub", "")) for x in t.get("layer", ())),
        tuple(map(_pattern, t.get("pattern", ()))),
        {k: tuple(v) for k, v in t.get("externs", {}).items()},
        tuple(naming.get("forbid_in_domain", ())),
        tuple(t.get("flow", ())),
        t.get("crate_graph", "A"),
        t.get("root", "src"),
    )
    if t.get("extends"):
        for section in ("layers", "patterns", "externs", "forbid_in_domain", "flow"):
            if not getattr(own, section):
                own = replace(own, **{section: getattr(PROFILE, section)})
    return replace(own, patterns=tuple(map(_pattern, t.get("add_pattern", ()))) + own.patterns)


def load(path: str | Path) -> Config:
    """The configuration file, or the profile where there is none."""
    path = Path(path)
    return parse(path.read_text()) if path.exists() else PROFILE
