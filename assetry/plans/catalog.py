"""The user operations on a catalog: update, read and search."""

from __future__ import annotations

import re
import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetry.functions.paths import coordinate_axes
from assetry.functions.rules import read_typed
from assetry.operators.assets import asset_table, validate_assets
from assetry.operators.files import cleanup, file_rows
from assetry.sources.tables import materialized
from assetry.specs import Registry

# Columns that a read shows first, in this order.
HEAD_COLUMNS = (
    "project",
    "specification",
    "descriptor",
    "version",
    "coordinate_x",
    "coordinate_y",
    "coordinate_z",
    "frame",
    "extension",
    "filename",
    "filepath",
    "file_error",
    "asset_name",
    "asset_path",
    "asset_type",
    "asset_error",
    "asset_valid",
)
_SCALARS = (T.StringType, T.BooleanType, T.NumericType)
_READ_ONLY = re.compile(r"^\s*\(*\s*(select|with|values)\b", re.IGNORECASE)
_naming = threading.Lock()
_WRITES = re.compile(r"\binsert\s+(into|overwrite)\b", re.IGNORECASE)


def update(listing: DataFrame, specs: Registry, root: str) -> DataFrame:
    """Listing to catalog: one row per file, named, parsed and validated.

    Names are parsed once and the file rows written to the shared folder; the
    rule aggregate and the join of its result then read only their columns.
    """
    files = materialized(file_rows(listing, specs, root), "files")
    return cleanup(validate_assets(files, specs)).drop("asset_traits")


def assets_of(listing: DataFrame, specs: Registry, root: str) -> DataFrame:
    """Listing to asset table: one row per asset with its error."""
    files = materialized(file_rows(listing, specs, root), "files")
    return asset_table(files, specs)


def _ordered(df: DataFrame) -> DataFrame:
    head = [c for c in HEAD_COLUMNS if c in df.columns]
    return df.select(*head, *sorted(c for c in df.columns if c not in head))


def scalar_columns(df: DataFrame) -> DataFrame:
    """Only the columns of text, number and truth type."""
    return df.select(*[f.name for f in df.schema if isinstance(f.dataType, _SCALARS)])


def read_files(catalog: DataFrame) -> DataFrame:
    """One row per file with scalar columns only: coordinate axes and traits
    become columns, and a trait replaces the column of its name where present."""
    traits = F.col("file_traits")
    flat: dict[str, Column] = {}
    for field in catalog.schema["file_traits"].dataType.fields:
        if field.name == "coordinate":
            axes = coordinate_axes(traits["coordinate"])
            for axis_name, axis in zip(("coordinate_x", "coordinate_y", "coordinate_z"), axes):
                flat[axis_name] = axis
        elif isinstance(field.dataType, _SCALARS):
            value = traits.getField(field.name)
            if field.name in catalog.columns:
                value = F.coalesce(value, F.col(field.name))
            flat[field.name] = value
    kept = [c for c in catalog.columns if c not in flat and c != "file_traits"]
    df = catalog.select(*kept, *[v.alias(k) for k, v in flat.items()])
    return _ordered(scalar_columns(df))


def read_user_traits(catalog: DataFrame, names: dict[str, str]) -> DataFrame:
    """`read_files` plus user traits as typed columns: name to type.  Lists and structs are no
    columns of a read, so they come as JSON."""
    user = F.col("file_traits.user")

    def typed(name: str, dtype: str) -> Column:
        text = F.try_element_at(user, F.lit(name))
        value = read_typed(text, dtype)
        scalar = not dtype.startswith(("array", "struct", "map"))
        return F.coalesce(value, text.try_cast(dtype)) if scalar else F.to_json(value)

    extra = catalog.select("*", *[typed(n, t).alias(n) for n, t in names.items()])
    return read_files(extra)


def read_assets(catalog: DataFrame) -> DataFrame:
    """One row per asset: first non-null value, by file path, of each column.

    Traits are lists here, and a list is no scalar, so columns that share a
    trait's name (specification, extension, ...) are left out.
    """
    listed = {f.name for f in catalog.schema["file_traits"].dataType.fields}
    names = [
        f.name
        for f in catalog.schema
        if isinstance(f.dataType, _SCALARS)
        and f.name not in listed
        and f.name != "asset_path"
    ]
    # Columns that are never null inside an asset come from its first file.
    whole = [n for n in names if n in ("filename", "filepath", "asset_type", "asset_valid",
                                       "asset_path_relative", "filepath_relative")]
    partial = [n for n in names if n not in whole]

    def first(value: Column, present: Column) -> Column:
        return F.min_by(value, F.when(present, F.col("filepath")))

    rows = catalog.where(F.col("asset_path").isNotNull())
    grouped = rows.groupBy("asset_path").agg(
        F.min_by(F.struct(*whole), F.col("filepath")).alias("_first"),
        *[first(F.col(n), F.col(n).isNotNull()).alias(n) for n in partial],
    )
    df = grouped.select(
        "asset_path", *[F.col("_first")[n].alias(n) for n in whole], *partial
    )
    return _ordered(df)


def search(data: DataFrame, query: str) -> DataFrame:
    """Run a query against a read catalog, named `data` in the query.

    Only reading statements are accepted.
    """
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", query, flags=re.DOTALL)
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", "''", text)
    if not _READ_ONLY.match(bare) or _WRITES.search(bare):
        raise ValueError("Only SELECT, WITH and VALUES statements can be searched.")
    spark = data.sparkSession
    # a query is bound to its tables when it is made, so the name is taken only that long
    with _naming:
        known = spark.catalog.tableExists("data") and spark.catalog.getTable("data").isTemporary
        own = spark.table("data") if known else None  # a view of the caller's is put back
        data.createOrReplaceTempView("data")
        try:
            return spark.sql(query)
        finally:
            spark.catalog.dropTempView("data")
            if own is not None:
                own.createOrReplaceTempView("data")
