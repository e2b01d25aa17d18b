"""Naming grammar as Spark column expressions.

A name is a list of fields joined by ``_`` with an optional extension after a
dot.  Each field is an indicator followed by a token.  A specification fixes
which fields appear and in which order.

A field list compiles to one regex of nested optional steps (separator,
indicator, token, ...), which matches any text as far as it is legal.  The match
is rewritten into slots separated by ``/``, which no file name holds, and split:
one regex pass gives the field texts, the asset name and the first illegal step.
No token class holds a separator, so giving characters back never helps a match
and the first empty step is the part that failed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grammar: field, indicator, token pattern.
FIELDS = (
    "project",
    "specification",
    "descriptor",
    "version",
    "coordinate",
    "frame",
    "extension",
)
INDICATORS = {
    "project": "p-",
    "specification": "s-",
    "descriptor": "d-",
    "version": "v",
    "coordinate": "c",
    "frame": "f",
    "extension": ".",
}
TOKENS = {
    "project": "[a-z]{3,10}[0-9]{1,4}",
    "specification": "[a-z]{3,4}[0-9]{3}",
    "descriptor": "[a-z0-9][a-z0-9-]*",
    "version": "[0-9]{3}",
    "coordinate": "[0-9]{4}(?:-[0-9]{4}){0,2}",
    "frame": "[0-9]{4}",
    "extension": "[a-zA-Z0-9]+",
}
FIELD_SEPARATOR = "_"
TOKEN_SEPARATOR = "-"
VERSION_PADDING = 3
COORDINATE_PADDING = 4
FRAME_PADDING = 4

_SLOT = "/"
_END = r"\z"
_EXTENSION_ONLY = r"(?s)^(?:.*\.)?([a-zA-Z0-9]+)\z"
# Slots of a split name: the seven fields, the asset name, text left over, steps.
_ASSET_NAME = len(FIELDS)
_REST = _ASSET_NAME + 1
_STEPS = _REST + 1

NAME_TYPE = (
    "struct<project:string,specification:string,descriptor:string,version:int,"
    "coordinate:array<int>,frame:int,extension:string>"
)


def check_fields(fields: Sequence[str]) -> tuple[str, ...]:
    """Return the fields as a tuple, or raise ValueError if they are illegal."""
    fields = tuple(fields)
    if not fields:
        raise ValueError("A name needs at least one field.")
    if len(set(fields)) != len(fields):
        raise ValueError("A field is given twice.")
    illegal = [f for f in fields if f not in FIELDS]
    if illegal:
        raise ValueError(
            f"Unknown fields: {', '.join(map(str, illegal))} (known: {', '.join(FIELDS)})."
        )
    if "extension" in fields[:-1]:
        raise ValueError(
            "The extension stands at the end of a name."
        )
    return fields


def _escape(text: str) -> str:
    return text.replace(".", r"\.")


@dataclass(frozen=True)
class Step:
    """One part of a name, its regex and the text reported when it is illegal."""

    regex: str
    error: str
    field: str | None = None


def name_steps(fields: Sequence[str]) -> list[Step]:
    fields = check_fields(fields)
    if fields == ("extension",):
        return [Step(TOKENS["extension"], "Illegal extension field token", "extension")]
    steps = []
    for i, field in enumerate(fields):
        if i and field != "extension":
            steps.append(Step(FIELD_SEPARATOR, f"Expected '{FIELD_SEPARATOR}'"))
        steps.append(Step(_escape(INDICATORS[field]), f"Illegal {field} field indicator"))
        steps.append(Step(TOKENS[field], f"Illegal {field} field token", field))
    return steps


def name_regex(fields: Sequence[str]) -> str:
    """Anchored regex of a legal name, one group per field in field order."""
    if tuple(fields) == ("extension",):
        return _EXTENSION_ONLY
    body = "".join(
        f"({s.regex})" if s.field else s.regex for s in name_steps(fields)
    )
    return f"^{body}{_END}"


def _split_regex(fields: Sequence[str]) -> str:
    steps = name_steps(fields)
    lead = r"(?:.*\.)?" if len(steps) == 1 else ""
    nested = "".join(f"(?:({s.regex})" for s in steps) + ")?" * len(steps)
    return f"(?s)^{lead}{nested}(.*)"


def _split_layout(fields: Sequence[str], asset_name_fields: Sequence[str]) -> str:
    steps = name_steps(fields)
    group = {s.field: f"${i + 1}" for i, s in enumerate(steps) if s.field}
    stem = FIELD_SEPARATOR.join(
        INDICATORS[f] + group[f]
        for f in asset_name_fields
        if f in group and f != "extension"
    )
    if "extension" in asset_name_fields and "extension" in group:
        stem += INDICATORS["extension"] + group["extension"]
    slots = [group.get(f, "") for f in FIELDS]
    slots += [stem, f"${len(steps) + 1}"]
    slots += [f"${i + 1}" for i in range(len(steps))]
    return _SLOT.join(slots)


def rewrite_name(
    name: Column, fields: Sequence[str], asset_name_fields: Sequence[str] = ()
) -> Column:
    """Text of the slots of a name, for `split_slots`."""
    return F.regexp_replace(
        name,
        F.lit(_split_regex(fields)),
        F.lit(_split_layout(fields, asset_name_fields)),
    )


def split_slots(name: Column, slots: Column) -> Column:
    """Slots of a rewritten name as an array of texts (see `slot_*`), whether
    the name is legal or not; null for a name that holds ``/``."""
    return F.when(F.instr(name, _SLOT) == 0, F.split(slots, _SLOT))


def split_name(name: Column, fields: Sequence[str]) -> Column:
    return split_slots(name, rewrite_name(name, fields))


def failed_step(slots: Column) -> Column:
    """Number of the first illegal step, from 1; 0 for a legal name.  Text left
    over after the last step counts as one step more."""
    steps = F.slice(slots, F.lit(_STEPS + 1), F.size(slots))
    first = F.array_position(steps, F.lit("")).cast("int")
    return (
        F.when(first > 0, first)
        .when(slots[_REST] != "", F.size(slots) - _STEPS + 1)
        .otherwise(F.lit(0))
    )


def step_texts(fields: Sequence[str]) -> Column:
    """Error texts of the steps of a name, in order, as a constant array."""
    steps = name_steps(fields)
    texts = [s.error for s in steps]
    texts.append(steps[-1].error if steps[-1].field == "extension" else "Expected end of text")
    return F.split(F.lit("/".join(texts)), "/")


def step_error(name: Column, step: Column, texts: Column) -> Column:
    """Error text of a failed step; null for step 0."""
    return F.when(
        step > 0, F.concat(F.get(texts, step - 1), F.lit(' in "'), name, F.lit('".'))
    )


def slot_asset_name(slots: Column) -> Column:
    return slots[_ASSET_NAME]


def slot_fields(slots: Column) -> list[Column]:
    """The seven typed field values of the slots of a legal name."""

    def text(i: int) -> Column:
        return F.when(slots[i] != "", slots[i])

    coordinate = F.split(text(4), TOKEN_SEPARATOR).try_cast("array<int>")
    return [
        text(0).alias("project"),
        text(1).alias("specification"),
        text(2).alias("descriptor"),
        slots[3].try_cast("int").alias("version"),
        coordinate.alias("coordinate"),
        slots[5].try_cast("int").alias("frame"),
        text(6).alias("extension"),
    ]


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_name(name: Column, fields: Sequence[str]) -> Column:
    """Struct of typed field values; null when the name does not parse."""
    return _once(
        split_name(name, fields),
        lambda slots: F.when(failed_step(slots) == 0, F.struct(*slot_fields(slots))),
    )


def name_error(name: Column, fields: Sequence[str]) -> Column:
    """Text for the first part of the name that fails; null for a legal name."""
    step = _once(split_name(name, fields), failed_step)
    return _once(
        F.coalesce(step, F.lit(1)), lambda s: step_error(name, s, step_texts(fields))
    )


def padded(value: Column, width: int) -> Column:
    """Zero-padded integer; longer numbers keep all their digits."""
    return F.format_string(f"%0{width}d", value)


def coordinate_text(coordinate: Column) -> Column:
    return F.array_join(
        F.transform(coordinate, lambda c: padded(c, COORDINATE_PADDING)),
        TOKEN_SEPARATOR,
    )


def _field_text(field: str, value: Column) -> Column:
    if field == "version":
        token = padded(value, VERSION_PADDING)
    elif field == "frame":
        token = padded(value, FRAME_PADDING)
    elif field == "coordinate":
        token = coordinate_text(value)
    else:
        token = value
    return F.when(
        value.isNotNull(), F.concat(F.lit(INDICATORS[field]), token)
    )


def format_name(traits: Mapping[str, Column], fields: Sequence[str]) -> Column:
    """Text of a name, the inverse of `parse_name`; null or absent fields are
    left out, except that a null extension gives a null name."""
    fields = check_fields(fields)
    stems = [
        _field_text(f, traits[f]) for f in fields if f != "extension" and f in traits
    ]
    text = F.concat_ws(FIELD_SEPARATOR, *stems)
    if fields[-1] == "extension":
        text = F.concat(text, F.lit(INDICATORS["extension"]), traits["extension"])
    return text


def specification_token(name: Column) -> Column:
    """Specification token after the first ``s-`` anywhere in the text, if it is
    followed by the end or a non-digit; '' otherwise."""
    rest = F.substring_index(name, INDICATORS["specification"], 1)
    start = F.length(rest) + 1 + len(INDICATORS["specification"])
    tail = F.substring(name, start, F.length(name))
    return F.regexp_extract(tail, f"^({TOKENS['specification']})(?:{_END}|[^0-9])", 1)


def find_specification(name: Column) -> Column:
    """As `specification_token`, with null where there is none."""
    return _once(specification_token(name), lambda t: F.when(t != "", t))


def parse_extension(name: Column) -> Column:
    """Text after the last dot (the whole text if there is none)."""
    return F.nullif(F.regexp_extract(name, _EXTENSION_ONLY, 1), F.lit(""))
