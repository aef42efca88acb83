"""What a schema is written out as: JSON Schema, Python classes, a Mermaid diagram, Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

_JSON = {T.StringType: "string", T.BooleanType: "boolean", T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer", T.FloatType: "number", T.DoubleType: "number", T.DecimalType: "number"}
_FORMATS = {T.DateType: "date", T.TimestampType: "date-time", T.TimestampNTZType: "date-time"}
_PYTHON = {T.StringType: "str", T.BooleanType: "bool", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "float", T.DoubleType: "float", T.DecimalType: "Decimal", T.DateType: "date", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.BinaryType: "bytes"}


def json_schema(name: str, schema: T.StructType) -> dict:
    def of(kind: T.DataType, nullable: bool) -> dict:
        if isinstance(kind, T.ArrayType):
            out: dict = {"type": "array", "items": of(kind.elementType, kind.containsNull)}
        elif isinstance(kind, T.StructType):
            out = {"type": "object", "properties": {f.name: of(f.dataType, f.nullable) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable]}
        elif isinstance(kind, T.MapType):
            out = {"type": "object", "additionalProperties": of(kind.valueType, kind.valueContainsNull)}
        elif type(kind) in _FORMATS:
            out = {"type": "string", "format": _FORMATS[type(kind)]}
        else:
            out = {"type": _JSON.get(type(kind), "string")}
        return out | {"type": [out["type"], "null"]} if nullable else out

    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name} | of(schema, False)


def python_type(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"list[{python_type(kind.elementType)}]"
    if isinstance(kind, T.MapType):
        return f"dict[{python_type(kind.keyType)}, {python_type(kind.valueType)}]"
    return "dict" if isinstance(kind, T.StructType) else _PYTHON.get(type(kind), "object")


def python_class(name: str, schema: T.StructType, style: str = "dataclass") -> str:
    """A dataclass or a pydantic model with a field per column; nullable ones default to None."""
    head = f"@dataclass\nclass {class_name(name)}:" if style == "dataclass" else f"class {class_name(name)}(BaseModel):"
    fields = sorted(schema.fields, key=lambda f: f.nullable)
    return head + "\n" + "".join(f"    {f.name}: {python_type(f.dataType)}{' | None = None' if f.nullable else ''}\n" for f in fields)


def class_name(table: str) -> str:
    return "".join(p.capitalize() for p in table.replace(".", "_").split("_"))


def mermaid(tables: dict[str, T.StructType], foreign: Sequence[tuple[str, str, str]]) -> str:
    """An entity-relationship diagram; foreign: (child, parent, label)."""
    lines = ["erDiagram"]
    for name, schema in tables.items():
        lines += [f"  {name} {{", *(f"    {f.dataType.typeName()} {f.name}" for f in schema.fields), "  }"]
    return "\n".join([*lines, *(f"  {p} ||--o{{ {c} : {label}" for c, p, label in foreign)]) + "\n"


def markdown(name: str, schema: T.StructType) -> str:
    rows = [f"| {f.name} | {f.dataType.simpleString()} | {'yes' if f.nullable else 'no'} | {', '.join('@' + t['name'] for t in (f.metadata or {}).get('tags', []))} |" for f in schema.fields]
    return "\n".join([f"## {name}", "", "| column | type | null | tags |", "| --- | --- | --- | --- |", *rows]) + "\n"
