"""Path and text helpers as Spark column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: bytes of the URL namespace of RFC 4122 name-based ids.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
# Fixed value: keys whose values are hidden in displayed settings.
REDACT_REGEX = "(_key|_id|_token|url)$"
REDACTED = "REDACTED"
# Fixed value: file-safe time text.
TIME_FORMAT = "yyyy-MM-dd'T'-HH-mm-ss"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Directory of a path; '/' for a path directly under the root."""
    cut = F.length(path) - F.length(file_name(path)) - 1
    return F.when(cut <= 0, F.lit("/")).otherwise(F.substring(path, F.lit(1), cut))


def file_extension(name: Column) -> Column:
    """Last suffix without its dot; '' when there is none (``.profile`` has none)."""
    return F.regexp_extract(name, r"(?s)^.+\.([^.]+)\z", 1)


def _directory_prefix(root: str) -> str:
    return root.rstrip("/") + "/"


def relative_path(path: Column, root: str) -> Column:
    """Path without the root directory; other paths stay as they are."""
    prefix = _directory_prefix(root)
    return F.when(
        F.startswith(path, F.lit(prefix)),
        F.substring(path, F.lit(len(prefix) + 1), F.length(path)),
    ).otherwise(path)


def move_root(path: Column, source: str, target: str) -> Column:
    """Path with its source root replaced by the target root."""
    prefix = _directory_prefix(source)
    return F.when(
        F.startswith(path, F.lit(prefix)),
        F.concat(
            F.lit(_directory_prefix(target)),
            F.substring(path, F.lit(len(prefix) + 1), F.length(path)),
        ),
    ).otherwise(path)


def ancestors(path: Column) -> Column:
    """Array of the directories above an absolute path, nearest the root first,
    without the root itself."""
    steps = F.split(path, "/")
    return F.when(
        F.size(steps) > 2,
        F.transform(
            F.sequence(F.lit(2), F.size(steps) - 1),
            lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def url_uuid(text: Column) -> Column:
    """Name-based UUID (version 3, URL namespace) of a text."""
    digest = F.md5(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(text, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab"), nibble % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-3"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def str_to_bool(text: Column) -> Column:
    """True for 'true' in any case, else false."""
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def time_string(ts: Column) -> Column:
    """Time as text that is safe in a file name."""
    return F.date_format(ts, TIME_FORMAT)


def error_text(kind: Column | str, *messages: Column) -> Column:
    """``Kind( message )`` for one message, one message per line for several;
    null messages are left out, and no message at all gives null."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    found = F.array_compact(F.array(*messages))
    one = F.concat(kind, F.lit("( "), F.get(found, F.lit(0)), F.lit(" )"))
    many = F.concat(kind, F.lit("(\n"), F.array_join(found, "\n"), F.lit("\n)"))
    return F.when(F.size(found) == 1, one).when(F.size(found) > 1, many)


def coordinate_axes(coordinate: Column) -> list[Column]:
    """coordinate_x, coordinate_y and coordinate_z; null where an axis is absent."""
    return [
        F.get(coordinate, F.lit(i)).alias(f"coordinate_{axis}")
        for i, axis in enumerate("xyz")
    ]


def progress_ratio(step: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(1.0)).otherwise(step / total)


def progress_message(step: Column, total: Column, message: Column) -> Column:
    """``Progress: 50.00% (1 of 2) - message``."""
    return F.format_string(
        "Progress: %.2f%% (%d of %d) - %s",
        progress_ratio(step, total) * 100,
        step,
        total,
        message,
    )


def redact(
    df: DataFrame, pattern: str = REDACT_REGEX, hashed: bool = False
) -> DataFrame:
    """Hide the values of all columns, struct fields and map entries whose name
    matches, at any depth, also within arrays.  Values of maps keep one type: where
    it is not text, the map becomes one of JSON texts."""
    regex = re.compile(pattern)

    def hidden(value: Column) -> Column:
        if hashed:
            return F.concat(F.lit("hash-"), F.sha2(value.cast("string"), 256))
        return F.lit(REDACTED)

    def visit(value: Column, name: str, dtype: T.DataType) -> Column:
        if name and regex.search(name):
            if hashed and isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
                value = F.to_json(value)
            return hidden(value)
        if isinstance(dtype, T.StructType):
            fields = [
                visit(value.getField(f.name), f.name, f.dataType).alias(f.name)
                for f in dtype.fields
            ]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(dtype, T.ArrayType):
            return F.transform(value, lambda v: visit(v, "", dtype.elementType))
        if isinstance(dtype, T.MapType):
            inner = dtype.valueType

            def entry(key: Column, v: Column) -> Column:
                shown = visit(v, "", inner)
                if isinstance(inner, (T.StructType, T.ArrayType, T.MapType)):
                    shown = v_text = F.to_json(shown)
                else:
                    shown = v_text = shown.cast("string")
                secret = hidden(v_text) if hashed else hidden(v)
                return F.when(key.cast("string").rlike(pattern), secret).otherwise(shown)

            return F.transform_values(value, entry)
        return value

    return df.select(
        *[visit(F.col(f"`{f.name}`"), f.name, f.dataType).alias(f.name) for f in df.schema]
    )
