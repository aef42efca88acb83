"""Namespaces: a name, the tags it declares, and a handler from a DataFrame to named DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tagloom.tags import TableTags


@dataclass(frozen=True)
class TagSpec:
    """What a tag may stand on ("table", "column") and how many arguments it takes."""

    targets: tuple[str, ...] = ("table", "column")
    least: int = 0
    most: int = 8


@dataclass(frozen=True)
class Context:
    """What a handler gets besides the DataFrame: the table's name and tags, the key columns, and any tables it refers to."""

    table: str
    tags: TableTags
    key: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    role: str | None = None
    options: dict = field(default_factory=dict)


Handler = Callable[[DataFrame, Context], dict[str, DataFrame]]
_namespaces: dict[str, tuple[dict[str, TagSpec], Handler]] = {}


def namespace(name: str, tags: dict[str, TagSpec] | None = None) -> Callable[[Handler], Handler]:
    """Registers a handler: its results are called {table}_{suffix}."""

    def register(handler: Handler) -> Handler:
        _namespaces[name] = (tags or {}, handler)
        return handler

    return register


def names() -> list[str]:
    return sorted(_namespaces)


def diagnostics(tags: TableTags) -> list[tuple[str, str]]:
    """(severity, message) for unknown namespaces and tags, wrong targets and wrong numbers of arguments."""
    found = []
    for t in tags.tags:
        full = f"@{t.namespace}" + (f".{t.name}" if t.name else "")
        if t.namespace not in _namespaces:
            found.append(("error", f"{full}: no such namespace"))
            continue
        specs = _namespaces[t.namespace][0]
        spec = specs.get(t.name or "")
        if spec is None:
            found.append(("error", f"{full}: the namespace has no such tag"))
            continue
        target = "column" if t.column else "table"
        if target not in spec.targets:
            found.append(("error", f"{full}: can't stand on a {target}"))
        if not spec.least <= len(t.args) + len(t.named) <= spec.most:
            found.append(("error", f"{full}: takes {spec.least} to {spec.most} arguments"))
    return found


def compile_tags(df: DataFrame, context: Context) -> dict[str, DataFrame]:
    """All DataFrames that the tags of a table stand for, lazily; errors are raised together."""
    if errors := [m for s, m in diagnostics(context.tags) if s == "error"]:
        raise ValueError("; ".join(errors))
    out: dict[str, DataFrame] = {}
    for name in dict.fromkeys(t.namespace for t in context.tags.tags):
        out |= {f"{context.table}_{suffix}": made for suffix, made in _namespaces[name][1](df, context).items()}
    return out
