"""The script builtins as Column functions, so that computed fields and expressions stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.paths import camel, kebab, snake

TRUE_TEXTS = ("1", "t", "T", "TRUE", "true", "True")


def to_str(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def to_int(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def to_float(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def to_bool(c: Column) -> Column:
    return F.coalesce(c.cast("string").isin(*TRUE_TEXTS), F.lit(False))


def to_time(c: Column) -> Column:
    return F.try_to_timestamp(c.cast("string"))


def chunk(a: Column, n: int) -> Column:
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i, n))


def find(a: Column, predicate) -> Column:
    return F.try_element_at(F.filter(a, predicate), F.lit(1))


def _json_of(c: Column) -> Column:
    """The value of any type as JSON, null for a null."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def contains(c: Column, value) -> Column:
    """Of a list: the element; of a text: the part."""
    listed = F.array_contains(F.from_json(_json_of(c), "array<string>"), F.lit(str(value)))
    return F.coalesce(F.when(F.typeof(c).startswith("array"), listed).otherwise(c.cast("string").contains(str(value))), F.lit(False))


def is_zero(c: Column) -> Column:
    """Null, 0, false and the empty text."""
    return _json_of(c).isin("", "0", "0.0", "false", '""')


def empty(c: Column) -> Column:
    """What is zero, and lists and objects without members."""
    return is_zero(c) | _json_of(c).isin("[]", "{}")


def length(c: Column) -> Column:
    """Of a list; 0 for anything else."""
    return F.coalesce(F.when(F.typeof(c).startswith("array"), F.json_array_length(_json_of(c))), F.lit(0))


def to_slice(c: Column) -> Column:
    """A list as it is, as variants; empty for anything else."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(_json_of(c)), "$", "array<variant>"), F.array().cast("array<variant>"))


_UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


def to_duration(c: Column) -> Column:
    """Nanoseconds of texts like 1h30m or 2.5s, or of a number; 0 for anything else."""
    text = c.cast("string")
    parts = F.regexp_extract_all(text, F.lit(r"([0-9.]+)(h|ms|m|s|us|ns)"), F.lit(0))
    unit = F.create_map(*[F.lit(x) for pair in _UNITS.items() for x in pair])
    nanos = F.aggregate(parts, F.lit(0).cast("bigint"), lambda sum_, p: sum_ + F.round(F.regexp_extract(p, "^[0-9.]+", 0).try_cast("double") * unit[F.regexp_extract(p, "[a-z]+$", 0)]).cast("bigint"))
    signed = F.when(text.startswith("-"), -nanos).otherwise(nanos)
    return F.when(text.rlike(r"^[-+]?([0-9.]+(h|ms|m|s|us|ns))+$"), signed).otherwise(F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint")))


def drop(a: Column, n: int) -> Column:
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def difference(a: Column, b: Column) -> Column:
    return F.struct(F.array_except(a, b).alias("left"), F.array_except(b, a).alias("right"))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + F.coalesce(y.cast("double"), F.lit(0.0)))


def index_of(a: Column, value) -> Column:
    return F.array_position(a, value) - 1


def split(c: Column, mark: str) -> Column:
    """By a literal mark."""
    return F.split(c, "\\Q" + mark + "\\E") if mark else F.split(c, "")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def trim_left(c: Column, cutset: str) -> Column:
    return F.ltrim(c, F.lit(cutset))


def trim_right(c: Column, cutset: str) -> Column:
    return F.rtrim(c, F.lit(cutset))


def trim_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def trim_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.left(c, F.length(c) - len(suffix))).otherwise(c)


def quote(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$', "")


def unquote(c: Column) -> Column:
    return F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string").getField("v")


#: Functions under their script names, by what they take: columns and plain arguments.
BUILTINS = {
    "toStr": to_str, "toInt": to_int, "toFloat": to_float, "toBool": to_bool, "toTime": to_time,
    "now": F.current_timestamp, "uuid": F.uuid,
    "ksuid": lambda: F.concat(F.lpad(F.lower(F.hex(F.unix_micros(F.current_timestamp()))), 16, "0"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)),
    "chunk": chunk, "map": F.transform, "filter": F.filter, "find": find, "contains": contains,
    "equal": lambda a, b: a.eqNullSafe(b), "deepEqual": lambda a, b: F.to_json(a).eqNullSafe(F.to_json(b)),
    "keys": F.map_keys, "values": F.map_values, "flatten": F.flatten, "uniq": F.array_distinct, "drop": drop, "last": last,
    "empty": empty, "notEmpty": lambda c: ~empty(c), "difference": difference, "isZero": is_zero,
    "sum": array_sum, "set": lambda c, k, v: c.withField(k, v), "getOr": F.coalesce, "len": length,
    "toMap": lambda c: F.from_json(c, "map<string,string>"), "asDoc": lambda c: F.parse_json(F.to_json(c)),
    "indexOf": index_of, "join": F.array_join, "split": split, "replace": lambda c, a, b: F.replace(c, F.lit(a), F.lit(b)),
    "lower": F.lower, "upper": F.upper, "trim": trim, "trimLeft": trim_left, "trimRight": trim_right, "trimPrefix": trim_prefix, "trimSuffix": trim_suffix,
    "startsWith": lambda c, x: c.startswith(x), "endsWith": lambda c, x: c.endswith(x), "camelCase": camel, "snakeCase": snake, "kebabCase": kebab,
    "quote": quote, "unquote": unquote, "parseTime": lambda c, fmt: F.try_to_timestamp(c, F.lit(fmt)),
    "since": lambda t: F.current_timestamp() - t, "until": lambda t: t - F.current_timestamp(),
    "unixMicro": F.timestamp_micros, "unixMilli": F.timestamp_millis, "unix": F.timestamp_seconds, "date": F.make_timestamp,
    "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "md5": F.md5,
    "base64Encode": lambda c: F.base64(c.cast("binary")), "base64Decode": lambda c: F.unbase64(c).cast("string"),
    "jsonEncode": F.to_json, "jsonDecode": F.parse_json, "newDocumentFrom": F.parse_json, "toSlice": to_slice, "toDuration": to_duration, "newDocument": lambda: F.parse_json(F.lit("{}")), "prune": lambda c, *names: F.struct(*[c.getField(n).alias(n) for n in names]),
}
