"""Field paths with modifiers, resolved to Columns.

A path is dotted (`contact.email`, `tags.0`, `tags.#` for the length), followed by any number of `|@modifier` or
`|@modifier:argument` steps. Struct fields, maps and array places are read as they are typed; a string column that is
followed by more of a path is read as JSON text, and VARIANT columns by their own paths. JSON values come out
as text, numbers or booleans according to what is asked of them (see docmill.operators.predicates).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.errors import Validation


@dataclass(frozen=True)
class Resolved:
    col: Column
    kind: T.DataType  # VariantType: a value whose type only the row knows


INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def family(kind: T.DataType) -> str:
    for name, types in (("number", NUMBERS), ("text", (T.StringType, T.CharType, T.VarcharType)), ("bool", (T.BooleanType,)), ("time", (T.TimestampType, T.TimestampNTZType, T.DateType)), ("list", (T.ArrayType,)), ("variant", (T.VariantType,))):
        if isinstance(kind, types):
            return name
    return "object"


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def resolve(schema: T.StructType, path: str, prefix: str = "") -> Resolved | None:
    """The column of a path in a frame with this schema, or None where the path can't exist. prefix: a struct column to look in."""
    field, *steps = path.split("|")
    out = _walk(schema, field, prefix)
    for step in steps:
        if out is None:
            return None
        if not step.startswith("@"):
            out = _descend(out, step.split("."))
            continue
        name, _, argument = step[1:].partition(":")
        out = modify(out, name, argument)
    return out


def _walk(schema: T.StructType, field: str, prefix: str) -> Resolved | None:
    names = {f.name: f for f in schema.fields}
    if field in names and "." in field:  # a flat column with dots in its name
        return Resolved(F.col(prefix + _quote(field)), names[field].dataType)
    head, _, rest = field.partition(".")
    if head not in names:
        if "_extra" in names and isinstance(names["_extra"].dataType, T.VariantType):
            return Resolved(F.try_variant_get(F.col(prefix + "_extra"), _json_path(field), "variant"), T.VariantType())
        return None
    out = Resolved(F.col(prefix + _quote(head)), names[head].dataType)
    return _descend(out, rest.split(".")) if rest else out


def _json_path(field: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in field.split("."))


def _descend(at: Resolved, parts: list[str]) -> Resolved | None:
    for i, part in enumerate(parts):
        kind = at.kind
        if isinstance(kind, T.StructType):
            inner = {f.name: f.dataType for f in kind.fields}
            if part not in inner:
                return None
            at = Resolved(at.col.getField(part), inner[part])
        elif isinstance(kind, T.ArrayType):
            if part == "#":
                if i + 1 < len(parts):  # a.#.b: b of every element
                    each = parts[i + 1 :]
                    got = _descend(Resolved(F.lit(None).cast(kind.elementType), kind.elementType), each)
                    return None if got is None else Resolved(F.transform(at.col, lambda x: _descend(Resolved(x, kind.elementType), each).col), T.ArrayType(got.kind))
                at = Resolved(F.size(at.col).cast("long"), T.LongType())
            elif part.isdigit():
                at = Resolved(F.get(at.col, F.lit(int(part))), kind.elementType)
            else:
                return None
        elif isinstance(kind, T.MapType):
            at = Resolved(F.try_element_at(at.col, F.lit(part)), kind.valueType)
        elif isinstance(kind, (T.StringType, T.VariantType)):
            value = F.try_parse_json(at.col) if isinstance(kind, T.StringType) else at.col
            return Resolved(F.try_variant_get(value, _json_path(".".join(parts[i:])), "variant"), T.VariantType())
        else:
            return None
    return at


def text(at: Resolved) -> Column:
    """The value as text; null is empty."""
    return F.coalesce(raw_text(at), F.lit(""))


def raw_text(at: Resolved) -> Column:
    kind = family(at.kind)
    if kind == "variant":
        return F.try_variant_get(at.col, "$", "string")
    if kind in ("object", "list"):
        return F.to_json(at.col)
    return at.col.cast("string")


def number(at: Resolved) -> Column:
    """The value as a number; what is none, is 0."""
    kind = family(at.kind)
    if kind == "variant":
        return F.coalesce(F.try_variant_get(at.col, "$", "double"), F.lit(0.0))
    if kind == "number":
        return F.coalesce(at.col.cast("double"), F.lit(0.0))
    if kind == "bool":
        return F.coalesce(at.col.cast("int").cast("double"), F.lit(0.0))
    if kind == "text":
        return F.coalesce(at.col.try_cast("double"), F.lit(0.0))
    return F.lit(0.0)


def _time(at: Resolved) -> Column:
    return at.col.cast("timestamp") if family(at.kind) == "time" else F.try_to_timestamp(raw_text(at))


def snake(c: Column, mark: str = "_", other: str = r"[-\s]+") -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", f"$1{mark}$2"), other, mark))


def kebab(c: Column) -> Column:
    return snake(c, "-", r"[_\s]+")


def camel(c: Column) -> Column:
    word = lambda w, i: F.when(i == 0, F.concat(F.lower(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))).otherwise(F.initcap(F.lower(w)))
    return F.array_join(F.transform(F.split(c, r"[_\-\s]+"), word), "")


def modify(at: Resolved, name: str, argument: str = "") -> Resolved:
    """One modifier. Texts out of times keep the text forms `2006-01-02 15:04:05 +0000 UTC` and plain digits."""
    plain = {
        "snakeCase": snake, "camelCase": camel, "kebabCase": kebab, "upper": F.upper, "lower": F.lower,
        "trim": lambda c: F.replace(c, F.lit(" "), F.lit("")),
    }
    if name in plain:
        return Resolved(plain[name](raw_text(at)), T.StringType())
    if name == "replaceAll":
        options = json.loads(argument)
        return Resolved(F.replace(raw_text(at), F.lit(options["old"]), F.lit(options["new"])), T.StringType())
    if name == "dateTrunc":
        if argument not in ("day", "month", "year"):
            return Resolved(raw_text(at), T.StringType())
        if family(at.kind) == "time":
            return Resolved(F.date_format(F.date_trunc(argument, _time(at)), "yyyy-MM-dd HH:mm:ss '+0000 UTC'"), T.StringType())
        own = F.regexp_extract(raw_text(at), r"^\s*(\d{4}-\d{2}-\d{2})", 1)  # the date that the text itself has, whatever its zone
        kept = {"day": own, "month": F.concat(F.left(own, F.lit(7)), F.lit("-01")), "year": F.concat(F.left(own, F.lit(4)), F.lit("-01-01"))}[argument]
        return Resolved(F.when(_time(at).isNotNull(), F.concat(kept, F.lit(" 00:00:00 +0000 UTC"))), T.StringType())
    if name == "unix":
        return Resolved(F.unix_seconds(_time(at)).cast("string"), T.StringType())
    if name == "unixMilli":
        return Resolved(F.unix_millis(_time(at)).cast("string"), T.StringType())
    if name == "unixNano":
        return Resolved((F.unix_micros(_time(at)) * 1000).cast("string"), T.StringType())
    if name == "reverse":
        return Resolved(F.reverse(at.col), at.kind) if family(at.kind) == "list" else at
    if name == "flatten":
        nested = isinstance(at.kind, T.ArrayType) and isinstance(at.kind.elementType, T.ArrayType)
        return Resolved(F.flatten(at.col), at.kind.elementType) if nested else at
    if name == "keys":
        return Resolved(F.json_object_keys(F.to_json(at.col)) if family(at.kind) == "object" else F.json_object_keys(raw_text(at)), T.ArrayType(T.StringType()))
    if name == "values":
        if isinstance(at.kind, T.MapType):
            return Resolved(F.map_values(at.col), T.ArrayType(at.kind.valueType))
        return Resolved(F.map_values(F.from_json(_json(at), "map<string,string>")), T.ArrayType(T.StringType()))
    if name in ("tostr", "ugly", "pretty"):
        return Resolved(_json(at), T.StringType())
    if name == "fromstr":
        return Resolved(F.try_parse_json(raw_text(at)), T.VariantType())
    if name == "valid":
        return Resolved(F.when(F.try_parse_json(raw_text(at)).isNotNull(), raw_text(at)), T.StringType())
    if name == "join" and family(at.kind) == "list":
        return Resolved(F.map_from_entries(F.flatten(F.transform(at.col, lambda x: F.map_entries(F.from_json(F.to_json(x), "map<string,string>"))))), T.MapType(T.StringType(), T.StringType()))
    if name in ("this", "join"):
        return at
    raise Validation(f"unknown modifier @{name}")


def _json(at: Resolved) -> Column:
    kind = family(at.kind)
    if kind in ("object", "list", "variant"):
        return F.to_json(at.col)
    if kind == "text":
        quoted = F.to_json(F.struct(at.col.alias("v")))
        return F.when(at.col.isNotNull(), F.regexp_replace(quoted, r'^\{"v":|\}$', ""))
    return at.col.cast("string")


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of all leaves; arrays and maps are leaves."""
    out: list[str] = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += leaf_paths(f.dataType, f"{prefix}{f.name}.")
        else:
            out.append(prefix + f.name)
    return out
