"""Tags: `@namespace.tag(args)` annotations, in SQL comments or put on DataFrames, kept in column metadata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tag:
    """A tag's full dotted name, positional and named arguments, and what it stands on (column None: the table)."""

    namespace: str
    name: str | None = None
    args: tuple = ()
    named: tuple[tuple[str, object], ...] = ()
    table: str | None = None
    column: str | None = None

    @property
    def options(self) -> dict:
        return dict(self.named)


@dataclass
class TableTags:
    table: str
    tags: list[Tag] = field(default_factory=list)

    def of(self, namespace: str, name: str | None = None, column: str | None = None) -> list[Tag]:
        return [t for t in self.tags if t.namespace == namespace and (name is None or t.name == name) and (column is None or t.column == column)]


_TAG = re.compile(r"@([A-Za-z_][\w-]*)((?:\.[A-Za-z_][\w-]*)*)")
_TOKEN = re.compile(r"""\s*(?:(?P<name>[A-Za-z_]\w*)\s*[:=]\s*)?(?P<value>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\[|[^,\[\]]+)""")


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_args(text: str) -> tuple[tuple, dict]:
    """Positional and named arguments: strings, numbers (signed, decimal), booleans, bare words and [lists]."""
    positional, named, at = [], {}, 0
    while at < len(text) and (m := _TOKEN.match(text, at)):
        at = m.end()
        if m["value"] == "[":
            end = text.index("]", at)
            value = list(parse_args(text[at:end])[0])
            at = end + 1
        else:
            value = _scalar(m["value"])
        if m["name"]:
            named[m["name"]] = value
        else:
            positional.append(value)
        comma = re.compile(r"\s*,").match(text, at)
        at = comma.end() if comma else len(text)
    return tuple(positional), named


def _closing(text: str, at: int) -> int:
    """Where the bracket at `at` closes, strings skipped; the end of text if it doesn't."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return i
    return len(text)


def parse_comment(text: str, table: str | None = None, column: str | None = None) -> list[Tag]:
    """The tags in a comment. A dotted name is read whole: `@pg.omit.all` is namespace pg, tag omit.all."""
    found, at = [], 0
    while m := _TAG.search(text, at):
        at, args, named = m.end(), (), {}
        if text[at : at + 1] == "(":
            end = _closing(text, at)
            args, named = parse_args(text[at + 1 : end])
            at = end + 1
        found.append(Tag(m[1], m[2][1:] or None, args, tuple(named.items()), table, column))
    return found


_CREATE = re.compile(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s*\(", re.I)


def parse_ddl(sql: str) -> dict[str, TableTags]:
    """Tags of the tables and columns of annotated DDL.

    Comments right before CREATE TABLE are the table's; inside it, a comment at the end of a line is that line's
    column's, and comments on lines of their own are the next column's.
    """
    out: dict[str, TableTags] = {}
    waiting: list[str] = []
    table = None
    for line in sql.splitlines():
        code, _, comment = line.partition("--")
        if m := _CREATE.search(code):
            table = m[1].strip('"`')
            out[table] = TableTags(table, [t for c in [*waiting, comment] for t in parse_comment(c, table)])
            waiting = []
        elif table and (m := re.match(r"\s*[\"`]?(\w+)[\"`]?\s+\w", code)) and m[1].lower() not in ("constraint", "primary", "unique", "foreign", "check"):
            out[table].tags += [t for c in [*waiting, comment] for t in parse_comment(c, table, m[1])]
            waiting = []
        elif comment and not code.strip():
            waiting.append(comment)
        if ");" in code or code.strip() == ")":
            table = None
    return out


def tag(df: DataFrame, column: str, name: str, *args, **named) -> DataFrame:
    """df with a tag in a column's metadata; the plan is a projection, and the metadata goes along with it."""
    old = next(f.metadata for f in df.schema.fields if f.name == column)
    tags = [*old.get("tags", []), {"name": name, "args": [str(a) for a in args], "named": {k: str(v) for k, v in named.items()}}]
    return df.withColumn(column, F.col(column).alias(column, metadata={**old, "tags": tags}))


def tags_of(df: DataFrame, table: str = "") -> TableTags:
    """The tags that tag() has put on df's columns."""
    found = TableTags(table)
    for f in df.schema.fields:
        for t in f.metadata.get("tags", []) if f.metadata else []:
            namespace, _, name = t["name"].partition(".")
            found.tags.append(Tag(namespace, name or None, tuple(_scalar(a) for a in t["args"]), tuple((k, _scalar(v)) for k, v in t["named"].items()), table, f.name))
    return found
