"""The projection language: a configuration compiled to one select and one filter."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions.normalize import NORMALIZERS
from kinfold.plans.config import ConfigError, checked
from kinfold.schema import PROFILE

# Fixed value: the grammar of an indexed path segment.
INDEXED = re.compile(r"^([A-Za-z_][A-Za-z0-9_]*)\[(\d*)\]$")
Typed = tuple[Column, T.DataType] | None  # None: the path leads nowhere in the schema


def _member(value: Column, kind: T.DataType, name: str) -> Typed:
    if isinstance(kind, T.StructType) and name in kind.names:
        return value[name], kind[name].dataType
    return None


def _getter(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def resolve(path: str, schema: T.StructType = PROFILE) -> Typed:
    """The value at a dotted path: k[i] an element, k[] a list, a name after a list that member of each element."""
    now: Typed = None
    for i, part in enumerate(path.split(".")):
        match = INDEXED.match(part)
        name = match[1] if match else part
        if i == 0:
            found: Typed = (F.col(name), schema[name].dataType) if name in schema.names else None
        elif now is None:
            return None
        elif isinstance(now[1], T.ArrayType) and not match:
            inner = now[1].elementType
            if not (isinstance(inner, T.StructType) and name in inner.names):
                now = F.array().cast("array<string>"), T.ArrayType(T.StringType())
                continue
            now = F.transform(now[0], _getter(name)), T.ArrayType(inner[name].dataType)
            continue
        else:
            found = _member(*now, name)
        if found is None:
            return None
        if match:
            if not isinstance(found[1], T.ArrayType):
                return None
            found = found if match[2] == "" else (F.get(found[0], F.lit(int(match[2]))), found[1].elementType)
        now = found
    return now


def normalized(value: Column, kind: T.DataType, name: str | None) -> Column:
    """Strings, and strings in a list, normalised; other values as they are."""
    fn = NORMALIZERS.get(name or "")
    if fn is None:
        return value
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), fn(value))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.transform(value, lambda x: F.when(x.isNotNull(), fn(x)))
    return value


def coerced(value: Column, kind: T.DataType, to: str) -> tuple[Column, T.DataType]:
    """A list gives its first element to a scalar type; a scalar becomes a list of one; objects as text are JSON."""
    if to in ("any", "object"):
        return value, kind
    if to == "string[]":
        return (value, kind) if isinstance(kind, T.ArrayType) else (F.when(value.isNotNull(), F.array(value)), T.ArrayType(kind))
    if isinstance(kind, T.ArrayType):
        value, kind = F.get(value, F.lit(0)), kind.elementType
    nested = isinstance(kind, T.StructType | T.ArrayType)
    if to == "string":
        text = F.to_json(value, {"ignoreNullFields": "false"}) if nested else value.cast("string")
        return (value, kind) if isinstance(kind, T.StringType) else (text, T.StringType())
    if to == "number":
        if nested:
            return F.lit(None).cast("double"), T.DoubleType()
        guarded = F.when(value.cast("string").rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), value.try_cast("double"))
        return guarded, T.DoubleType()
    truth = F.lit(True) if nested else (value != "") if isinstance(kind, T.StringType) else (value != 0)
    return F.when(value.isNotNull(), truth), T.BooleanType()


def is_missing(value: Column, kind: T.DataType) -> Column:
    """Null, or an empty list or text; zero and false are there."""
    if isinstance(kind, T.StringType):
        return value.isNull() | (value == "")
    if isinstance(kind, T.ArrayType):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull()


def _nest(tree: dict, path: str, value: Column) -> None:
    *parents, leaf = path.split(".")
    for p in parents:
        tree = tree.setdefault(p, {})
        if not isinstance(tree, dict):
            raise ConfigError(f"path '{path}' runs through a field that has a value of its own")
    if leaf in tree:
        raise ConfigError(f"path '{path}' is also the parent of another field")
    tree[leaf] = value


def _columns(tree: dict) -> list[Column]:
    return [(F.struct(*_columns(v)) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()]


def _tree(config: dict, schema: T.StructType) -> tuple[dict, Column, set[str]]:
    """Output values by nested name, why a record is left out (null if it has all that it must have), and the paths of numbers."""
    checked(config)
    tree: dict = {}
    numbers = {e["path"] for e in config["fields"] if e.get("type") == "number"}
    reasons = []
    for entry in config["fields"]:
        found = resolve(entry.get("from", entry["path"]), schema)
        value, kind = found if found is not None else (F.lit(None).cast("string"), T.StringType())
        value, kind = coerced(normalized(value, kind, entry.get("normalize")), kind, entry.get("type", "any"))
        missing = F.lit(True) if found is None else is_missing(value, kind)
        if entry.get("required"):
            reasons.append(F.when(missing, f"required field '{entry['path']}' is missing"))
        elif config.get("on_missing", "null") == "error":
            reasons.append(F.when(missing, f"field '{entry['path']}' is missing"))
        _nest(tree, entry["path"], F.when(~missing, value))
    if config.get("include_confidence"):
        tree["overall_confidence"] = F.col("overall_confidence")
    if config.get("include_provenance"):
        tree["provenance"] = F.col("provenance")
    return tree, F.coalesce(*reasons, F.lit(None).cast("string")), numbers


def compile_config(config: dict, schema: T.StructType = PROFILE) -> tuple[list[Column], Column]:
    """Output columns, and the condition under which a record has all that it must have."""
    tree, why, _ = _tree(config, schema)
    return _columns(tree), why.isNull()


def rejected(canonical: DataFrame, config: dict) -> DataFrame:
    """ord, candidate_id and reason of the records that project() leaves out: the first field, in the configuration's order, that one must have and has not."""
    why = _tree(config, PROFILE)[1]
    return canonical.select("ord", "candidate_id", why.alias("reason")).filter("reason IS NOT NULL")


def _json(value: Column, whole: bool) -> Column:
    """The JSON text of a value, null where it is null; whole numbers without a fraction if asked for."""
    text = F.regexp_extract(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
    if whole:
        text = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(text)
    return F.when(value.isNotNull(), text)


def json_rows(canonical: DataFrame, config: dict) -> DataFrame:
    """ord and json, the text of each record in the shape of the configuration; keys of missing values are left out under "omit"."""
    tree, why, numbers = _tree(config, PROFILE)
    omit = config.get("on_missing") == "omit"
    configured = {e["path"] for e in config["fields"]}

    def rendered(part: dict, path: str) -> Column:
        members = []
        for name, value in part.items():
            here = f"{path}.{name}" if path else name
            text = rendered(value, here) if isinstance(value, dict) else _json(value, here in numbers)
            always = not omit or not (isinstance(value, dict) or here in configured)
            members.append(F.concat(F.lit(json.dumps(name) + ": "), F.coalesce(text, F.lit("null")) if always else text))
        inner = F.concat_ws(", ", *members)
        return F.when((inner != "") | F.lit(not omit or not path), F.concat(F.lit("{"), inner, F.lit("}")))

    return canonical.filter(why.isNull()).select("ord", rendered(tree, "").alias("json"))


def records(canonical: DataFrame, config: dict) -> DataFrame:
    """ord and record, a VARIANT object in the shape of the configuration, whose keys are left out where values are missing under "omit".

    Unlike the columns of project(), objects can differ in their keys from record to record.
    """
    return json_rows(canonical, config).select("ord", F.parse_json("json").alias("record"))


def indented(value: Column, kind: T.DataType, depth: int, whole: bool = False) -> Column:
    """JSON text of a value over several lines, two spaces a level, as Python's json writes it; null as the word."""
    pad, end = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    if isinstance(kind, T.StructType):
        members = [F.concat(F.lit(json.dumps(f.name) + ": "), indented(value[f.name], f.dataType, depth + 1)) for f in kind.fields]
        text = F.concat(F.lit("{" + pad), F.concat_ws("," + pad, *members), F.lit(end + "}"))
    elif isinstance(kind, T.ArrayType):
        inner = F.array_join(F.transform(value, lambda x: indented(x, kind.elementType, depth + 1)), "," + pad)
        text = F.when(F.size(value) == 0, "[]").otherwise(F.concat(F.lit("[" + pad), inner, F.lit(end + "]")))
    else:
        text = _json(value, whole)
    return F.when(value.isNull(), "null").otherwise(text)


def indented_rows(canonical: DataFrame, config: dict, depth: int = 1) -> DataFrame:
    """ord and json, the text of each record over several lines, as an element of an array; keys as in json_rows()."""
    tree, why, numbers = _tree(config, PROFILE)
    omit = config.get("on_missing") == "omit"
    configured = {e["path"] for e in config["fields"]}
    kept = canonical.filter(why.isNull())

    def types_of(part: dict, path: str) -> dict[str, T.DataType]:
        found = {}
        for name, value in part.items():
            here = f"{path}.{name}" if path else name
            found |= types_of(value, here) if isinstance(value, dict) else {here: value}
        return found

    leaves = types_of(tree, "")
    values = kept.select("ord", *(c.alias(f"__{i}") for i, c in enumerate(leaves.values())))
    kinds = {path: values.schema[f"__{i}"].dataType for i, path in enumerate(leaves)}
    places = {path: F.col(f"__{i}") for i, path in enumerate(leaves)}

    def rendered(part: dict, path: str, level: int) -> Column:
        pad, end, members = "\n" + "  " * (level + 1), "\n" + "  " * level, []
        for name, value in part.items():
            here = f"{path}.{name}" if path else name
            text = rendered(value, here, level + 1) if isinstance(value, dict) else indented(places[here], kinds[here], level + 1, here in numbers)
            gone = omit and not isinstance(value, dict) and here in configured
            members.append(F.concat(F.lit(json.dumps(name) + ": "), F.when(places[here].isNotNull(), text) if gone else text))
        inner = F.concat_ws("," + pad, *members)
        text = F.concat(F.lit("{" + pad), inner, F.lit(end + "}"))
        return F.when(inner != "", text).otherwise(None if omit and path else F.lit("{}"))

    return values.select("ord", rendered(tree, "", depth).alias("json"))


def project(canonical: DataFrame, config: dict) -> DataFrame:
    """Records in the shape of the configuration; those without a required field are left out.

    With on_missing "omit" a missing value is null here; the JSON sink leaves the key out.
    """
    columns, keep = compile_config(config)
    return canonical.filter(keep).select("ord", *columns)
