"""What a crate's manifest says, as far as scanning cares."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass


@dataclass(frozen=True)
class Manifest:
    project: str = "unknown"
    externs: tuple[str, ...] = ()
    bins: tuple[tuple[str, str | None], ...] = ()
    tests: tuple[tuple[str, str | None], ...] = ()
    others: tuple[str, ...] = ()  # examples and benches: compiled, but no architecture
    members: tuple[str, ...] = ()


def parse(text: str) -> Manifest:
    t = tomllib.loads(text)
    named = lambda key: tuple((x["name"], x.get("path")) for x in t.get(key, ()) if isinstance(x.get("name"), str))
    externs = {k.replace("-", "_") for table in ("dependencies", "dev-dependencies", "build-dependencies") for k in t.get(table, {})}
    others = tuple(f"{key} `{name}`" for key in ("example", "bench") for name, _ in named(key))
    return Manifest(t.get("package", {}).get("name", "unknown"), tuple(sorted(externs)), named("bin"), named("test"), others, tuple(t.get("workspace", {}).get("members", ())))
