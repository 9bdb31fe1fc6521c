"""The compact parameter notation ("sum:price", "gt:qty=5", "split:text").

Everything is parsed when a plan is compiled, so a malformed parameter fails before any
job starts, also for an empty input. Parsers return small dataclasses; the operators turn
those into columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


class NotationError(ValueError):
    """A parameter that the notation does not allow."""


# The names that the notation knows.
MAP_FUNCTIONS = ("identity", "uppercase", "lowercase", "double")
FIELD_REDUCERS = ("sum", "min", "max")


@dataclass(frozen=True)
class Predicate:
    kind: str
    field: str | None = None
    text: str | None = None
    number: float | None = None


@dataclass(frozen=True)
class Reducer:
    kind: str
    field: str | None = None

    @property
    def output(self) -> str:
        return self.kind if self.field is None else f"{self.kind}_{self.field}"


@dataclass(frozen=True)
class FlatFunction:
    kind: str
    field: str | None = None


def parse_map(script: str) -> str:
    if script not in MAP_FUNCTIONS:
        raise NotationError(f"unknown map function '{script}'")
    return script


def _comparison(predicate: str, body: str) -> tuple[str, str]:
    field, mark, value = body.partition("=")
    if not mark or not field:
        raise NotationError(f"invalid predicate '{predicate}'")
    return field, value


def parse_predicate(predicate: str) -> Predicate:
    if predicate in ("always_true", "always_false", "non_empty"):
        return Predicate(predicate)
    head, mark, body = predicate.partition(":")
    if not mark or head not in ("has_field", "equals", "gt", "lt"):
        raise NotationError(f"unknown predicate '{predicate}'")
    if head == "has_field":
        return Predicate("has_field", field=body)
    field, value = _comparison(predicate, body)
    if head == "equals":
        return Predicate("equals", field=field, text=value)
    try:
        # float() also takes blanks around a number and underscores within
        number = float("x" if value != value.strip() or "_" in value else value)
    except ValueError:
        raise NotationError(f"invalid predicate '{predicate}'") from None
    return Predicate(head, field=field, number=number)


def parse_reducer(reducer: str) -> Reducer:
    if reducer in ("count", "collect", *FIELD_REDUCERS):
        return Reducer(reducer)
    head, mark, field = reducer.partition(":")
    if not mark or head not in FIELD_REDUCERS:
        raise NotationError(f"unknown reducer '{reducer}'")
    return Reducer(head, field)


def parse_flat(func: str) -> FlatFunction:
    if func in ("identity", "json_expand"):
        return FlatFunction(func)
    head, mark, field = func.partition(":")
    if not mark or head not in ("split", "explode_array"):
        raise NotationError(f"unknown operation '{func}'")
    return FlatFunction(head, field)


def integral_bound(kind: str, number: float) -> int | None:
    """The whole number that gt/lt compare with on an integral column, None if not finite.

    ``x > 5.5`` is ``x > 5`` and ``x < 5.5`` is ``x < 6`` for whole x; unlike a fractional
    literal, such a comparison reaches the Parquet scan.
    """
    if not math.isfinite(number):
        return None
    return math.floor(number) if kind == "gt" else math.ceil(number)
