"""Validation rules.

An *each* rule judges one value at a time and is a pair of column expressions:
does the value pass, and the text to report when it does not.  A *set* rule
judges all values of one asset and is a grouped aggregate; see
`assetry.operators.set_rules`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from assetry.functions.naming import (
    COORDINATE_PADDING,
    FRAME_PADDING,
    TOKENS,
    VERSION_PADDING,
)

Predicate = Callable[[Column], Column]

# Fixed value: a descriptor must not claim to be the last word.
_FORBIDDEN_DESCRIPTOR = "^(master|final|last)"
_END = r"\z"


@dataclass(frozen=True)
class Rule:
    """Rule on single values.  Rules of equal name with equal arguments of equal
    types are one rule; rules of the user's own also need the same functions."""

    name: str
    args: tuple = ()
    passes: Predicate = field(compare=False, default=None)
    report: Predicate = field(compare=False, default=None)
    own: tuple = ()
    raw: bool = field(compare=False, default=False)  # judges a user trait's text, not its typed value
    kinds: tuple = field(init=False, default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "kinds", tuple(type(a).__name__ for a in self.args))

    def fails(self, value: Column) -> Column:
        """True where the value is present and does not pass; never null."""
        return value.isNotNull() & ~F.coalesce(self.passes(value), F.lit(False))

    def message(self, value: Column) -> Column:
        """Report text where the value fails, else null."""
        return F.when(self.fails(value), self.report(value))


# What a set rule can ask for of the values of one asset: a column by name, see
# operators.set_rules.MEASURES.
Measures = Callable[[str], Column]


@dataclass(frozen=True)
class SetRule:
    """Rule on all values of one asset: does it fail, and the text to report then, from
    measures of the values.  `names` says what the report goes on with: `values` or `points`
    that are missing, `rare` points, or nothing.  Rules are told apart as each rules are."""

    name: str
    args: tuple = ()
    fails: Callable[[Measures], Column] = field(compare=False, default=None)
    report: Callable[[Measures], Column] = field(compare=False, default=None)
    names: str | None = field(compare=False, default=None)
    own: tuple = ()


def as_text(value: Column) -> Column:
    """Value as it is printed in messages; arrays as ``[1, 2]``."""
    return value.cast("string")


def each(name: str, passes: Predicate, report: Predicate, args: Sequence = ()) -> Rule:
    """Make a rule of your own from two column functions."""
    return Rule(name, tuple(args), passes, report, (passes, report))


def each_python(name: str, passes: Callable[[Any], bool], text: str = "{} is not valid.") -> Rule:
    """Make a rule of your own from a Python predicate on single values.

    Values are Python's (lists for coordinates).  A predicate that raises does not pass.  All such
    rules of a registry are run by Spark in one pass of Arrow batches; the text has the
    value for `{}`.
    """

    @F.arrow_udf(BooleanType())
    def judge(values: pa.Array) -> pa.Array:
        return pa.array([v is not None and _holds(passes, v) for v in values.to_pylist()], pa.bool_())

    before, _, after = text.partition("{}")
    return Rule(
        name, (), judge, lambda v: F.concat(F.lit(before), as_text(v), F.lit(after)), (passes, text)
    )


def _holds(passes: Callable[[Any], bool], value: Any) -> bool:
    try:
        return bool(passes(value))
    except Exception:  # a value that a predicate can't judge is not valid
        return False


def _quoted(what: str) -> Predicate:
    return lambda v: F.concat(F.lit('"'), v, F.lit(f'" is not a valid {what}.'))


def _range(what: str, bounds: str) -> Predicate:
    return lambda v: F.concat(
        as_text(v), F.lit(f" is not a valid {what}. {bounds}.")
    )


def is_project() -> Rule:
    regex = f"^{TOKENS['project']}{_END}"
    return Rule("project", (), lambda v: v.rlike(regex), _quoted("project name"))


def is_descriptor() -> Rule:
    regex = f"^{TOKENS['descriptor']}{_END}"
    return Rule(
        "descriptor",
        (),
        lambda v: v.rlike(regex) & ~v.rlike(_FORBIDDEN_DESCRIPTOR),
        _quoted("descriptor"),
    )


def is_version() -> Rule:
    top = 10**VERSION_PADDING
    return Rule(
        "version",
        (),
        lambda v: (v > 0) & (v < top),
        _range("version", f"0 < version < {top}"),
    )


def is_frame() -> Rule:
    top = 10**FRAME_PADDING
    return Rule(
        "frame",
        (),
        lambda v: (v >= 0) & (v < top),
        _range("frame", f"-1 < frame < {top}"),
    )


def is_coordinate() -> Rule:
    top = 10**COORDINATE_PADDING
    return Rule(
        "coordinate",
        (),
        lambda v: F.size(v).between(1, 3)
        & F.forall(v, lambda c: c.isNotNull() & (c >= 0) & (c < top)),
        _range("coordinate", f"-1 < coordinate < {top}"),
    )


def is_extension() -> Rule:
    regex = f"^[a-z0-9]+{_END}"
    return Rule("extension", (), lambda v: v.rlike(regex), _quoted("extension"))


def _reads(value: Column, other: Any) -> tuple[Column, Column | None]:
    """The value as what it is compared with; null where it cannot be read so, which no rule
    passes.  Beside an integer it is read twice: as a double, and as a long for values that
    no double tells apart.  A text trait never ends the job over a number."""
    if isinstance(other, bool):
        return value.try_cast("boolean"), None
    if isinstance(other, int) and abs(other) < 1 << 63:
        return value.try_cast("double"), value.try_cast("bigint")
    if isinstance(other, (int, float)):
        return value.try_cast("double"), None
    if isinstance(other, str):
        return value.cast("string"), None
    return value, None


def _equal(value: Column, other: Any) -> Column:
    read, whole = _reads(value, other)
    if whole is None:
        return read == F.lit(other)
    return (read == float(other)) & F.coalesce(whole == F.lit(other).cast("bigint"), F.lit(True))


def _less(value: Column, other: Any) -> Column:
    read, whole = _reads(value, other)
    if whole is None:
        return read < F.lit(other)
    return (read < float(other)) | ((read == float(other)) & (whole < F.lit(other).cast("bigint")))


def _greater(value: Column, other: Any) -> Column:
    read, whole = _reads(value, other)
    if whole is None:
        return read > F.lit(other)
    return (read > float(other)) | ((read == float(other)) & (whole > F.lit(other).cast("bigint")))


def _compare(name: str, sign: str, other: Any, passes: Predicate) -> Rule:
    return Rule(name, (other,), passes, lambda v: F.concat(as_text(v), F.lit(f" {sign} {other}.")))


def is_eq(other: Any) -> Rule:
    return _compare("eq", "!=", other, lambda v: _equal(v, other))


def is_lt(other: Any) -> Rule:
    return _compare("lt", "!<", other, lambda v: _less(v, other))


def is_gt(other: Any) -> Rule:
    return _compare("gt", "!>", other, lambda v: _greater(v, other))


def is_lte(other: Any) -> Rule:
    return _compare("lte", "!<=", other, lambda v: _less(v, other) | _equal(v, other))


def is_gte(other: Any) -> Rule:
    return _compare("gte", "!>=", other, lambda v: _greater(v, other) | _equal(v, other))


def is_in(options: Sequence) -> Rule:
    options = tuple(options)
    return Rule(
        "in",
        options,
        lambda v: reduce(or_, (F.coalesce(_equal(v, o), F.lit(False)) for o in options), F.lit(False)),
        lambda v: F.concat(as_text(v), F.lit(f" is not in {list(options)}.")),
    )


def is_int() -> Rule:
    """Text that can be read as an integer."""
    return Rule(
        "int",
        (),
        lambda v: v.try_cast("int").isNotNull(),
        lambda v: F.concat(F.lit("Value '"), as_text(v), F.lit("' is not int.")),
    )


def each_set(
    name: str,
    fails: Callable[[Measures], Column],
    report: Callable[[Measures], Column],
    args: Sequence = (),
) -> SetRule:
    """Make a set rule of your own from two functions of the measures."""
    return SetRule(name, tuple(args), fails, report, None, (fails, report))


def read_typed(text: Column, dtype: str) -> Column:
    """The text of a user trait as a value of a type; null where it is none."""
    if dtype == "string":
        return text
    return F.try_variant_get(F.try_parse_json(text), "$", dtype)


def reads_as(dtype: str) -> Rule:
    """The text of a user trait can be read as a type."""
    return Rule(
        "reads_as",
        (dtype,),
        lambda v: read_typed(v, dtype).isNotNull(),
        lambda v: F.concat(F.lit("Value '"), v, F.lit(f"' is not {dtype}.")),
        raw=True,
    )


def is_homogenous() -> SetRule:
    def text(m: Measures) -> Column:
        low = F.coalesce(m("low_text"), as_text(m("low")), as_text(m("low_point")))
        high = F.coalesce(m("high_text"), as_text(m("high")), as_text(m("high_point")))
        low, high = F.coalesce(low, F.lit("null")), F.coalesce(high, F.lit("null"))
        return F.concat(F.lit("values from "), low, F.lit(" to "), high, F.lit(" are not homogenous."))

    def fails(m: Measures) -> Column:
        return (m("n_values") > 1) & ((m("n_distinct") > 1) | (m("n_nulls") > 0))

    return SetRule("homogenous", (), fails, text)


def has_no_missing_values() -> SetRule:
    def fails(m: Measures) -> Column:
        span = m("high") - m("low") + 1
        return ~F.coalesce((m("n_values") == span) & (m("n_distinct") == span), F.lit(False))

    return SetRule("not_missing", (), fails, lambda m: F.lit("Missing values: "), "values")


def has_uniform_coordinate_count() -> SetRule:
    return SetRule(
        "uniform_coordinates",
        (),
        lambda m: m("lowest_count") < m("highest_count"),
        lambda m: F.lit("Non-uniform coordinate count. Missing coordinates: "),
        "rare",
    )


def has_dense_coordinates() -> SetRule:
    return SetRule(
        "dense_coordinates",
        (),
        lambda m: m("n_distinct") != m("volume"),
        lambda m: F.lit("Non-dense coordinates. Missing coordinates: "),
        "points",
    )


def coordinates_begin_at(origin: Sequence[int]) -> SetRule:
    return SetRule(
        "begin_at",
        tuple(origin),
        lambda m: ~m("low_point").eqNullSafe(F.array(*[F.lit(int(o)) for o in origin])),
        lambda m: F.lit(f"Coordinates do not begin at {list(origin)}."),
    )
