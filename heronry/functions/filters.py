"""Metadata filters: a small expression tree, its text form, and its translation into predicates.

Equality compares the JSON text of the value: strings as they are, anything else as written (2021.0 is not 2021, null
is "null"). Ranges hold numbers only, lower bound included, upper bound not. A field is a top-level key of the
metadata, dots and all; missing fields and metadata that is no object match nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidInput

#: Beyond so many distinct keys a field is reported as degraded (it is filtered all the same).
MAX_KEYS = 1024


@dataclass(frozen=True)
class Eq:
    field: str
    value: str


@dataclass(frozen=True)
class Range:
    field: str
    gte: float | None = None
    lt: float | None = None


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


Filter = Eq | Range | And | Or


def namespace(value: str) -> Eq:
    return Eq("namespace", value)


def _path(field: str) -> str:
    return "$['" + field.replace("'", "\\'") + "']"


def json_text(metadata: Column, field: str) -> Column:
    """The value's JSON text, strings without quotes; null where the field is missing."""
    raw = F.get_json_object(metadata, _path(field))
    there = F.array_contains(F.json_object_keys(metadata), field)
    return F.when(there, F.coalesce(raw, F.lit("null")))


def json_number(metadata: Column, field: str) -> Column:
    """The value as a double if JSON has it as a number."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(metadata), _path(field), "variant"))
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(number, F.get_json_object(metadata, _path(field)).cast("double"))


def predicate(where: Filter, metadata: Column | None = None, columns: dict[str, Column] | None = None) -> Column:
    """`where` as a boolean column; null, of a missing field, is as good as false in a filter and in And and Or.

    Fields in `columns` are typed columns, whose predicates reach the Parquet scan; others are looked up in the JSON
    text. An And without parts is true, an Or without parts false; a range whose bounds cross matches nothing.
    """
    columns = columns or {}
    match where:
        case Eq(field, value):
            found = columns[field].cast("string") if field in columns else json_text(metadata, field)
            return found == value
        case Range(field, gte, lt):
            found = columns[field] if field in columns else json_number(metadata, field)
            tests = [found.isNotNull()]
            tests += [found >= gte] if gte is not None else []
            tests += [found < lt] if lt is not None else []
            return reduce(lambda a, b: a & b, tests)
        case And(parts):
            return reduce(lambda a, b: a & b, (predicate(p, metadata, columns) for p in parts), F.lit(True))
        case Or(parts):
            return reduce(lambda a, b: a | b, (predicate(p, metadata, columns) for p in parts), F.lit(False))
    raise InvalidInput(f"not a filter: {where!r}")


_CLAUSE = re.compile(r"\s*([^=<>]+?)\s*(>=|<=|<|>|=)\s*(.*?)\s*")


def parse(texts: str | list[str]) -> Filter:
    """`a=v`, `a>=x` and `a<y`, joined by commas or given one by one; all must hold. <= and > are refused."""
    parts: list[Filter] = []
    for text in [texts] if isinstance(texts, str) else texts:
        for clause in filter(str.strip, text.split(",")):
            m = _CLAUSE.fullmatch(clause)
            if not m or m[2] in ("<=", ">"):
                raise InvalidInput(f"a filter is field=value, field>=number or field<number, not {clause!r}")
            if m[2] == "=":
                parts.append(Eq(m[1], m[3]))
                continue
            try:
                bound = float(m[3])
            except ValueError as e:
                raise InvalidInput(f"{m[3]!r} is not a number") from e
            parts.append(Range(m[1], gte=bound) if m[2] == ">=" else Range(m[1], lt=bound))
    if not parts:
        raise InvalidInput("an empty filter")
    return parts[0] if len(parts) == 1 else And(tuple(parts))
