"""Column builders on file rows: listing -> specification, traits, asset.

Every function here is a projection: no shuffle, no Python.  `file_rows` runs
them all and matches each file name against its regex once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetry.functions import naming, paths
from assetry.specs import IMAGE_TRAITS, Registry, by_spec

SPEC_UNKNOWN = "KeyError( Specification not found. )"

# The catalog columns in their fixed order.
CATALOG_COLUMNS = {
    "specification": "string",
    "extension": "string",
    "filename": "string",
    "filepath": "string",
    "file_error": "string",
    "file_traits": None,
    "asset_name": "string",
    "asset_path": "string",
    "asset_type": "string",
    "asset_traits": None,
    "asset_error": "string",
    "asset_valid": "boolean",
}

FILE_TRAITS_TYPE = (
    "struct<project:string,specification:string,descriptor:string,version:int,"
    "coordinate:array<int>,frame:int,extension:string,width:int,height:int,"
    "channels:int,filename_error:string,errors:map<string,string>,"
    "user:map<string,string>>"
)
ASSET_TRAITS_TYPE = (
    "struct<project:array<string>,specification:array<string>,"
    "descriptor:array<string>,version:array<int>,coordinate:array<array<int>>,"
    "frame:array<int>,extension:array<string>,width:array<int>,"
    "height:array<int>,channels:array<int>>"
)


def when_else(df: DataFrame, name: str, test: Column, yes: Column, no: Column) -> DataFrame:
    """Add a column that is `yes` where the test holds and `no` elsewhere."""
    return df.withColumn(name, F.when(test, yes).otherwise(no))


def is_registered(specification: Column, specs: Registry) -> Column:
    return F.coalesce(specification.isin(list(specs)), F.lit(False))


def specification_error(filename: Column, specification: Column, specs: Registry) -> Column:
    return F.when(
        specification.isNull(),
        F.concat(F.lit('Specification not found in "'), filename, F.lit('".')),
    ).when(~is_registered(specification, specs), F.lit(SPEC_UNKNOWN))


def add_specification(df: DataFrame, specs: Registry) -> DataFrame:
    """Add `specification` from the file name and the first `file_error`; a row with a
    `listing_error` has that and no specification."""
    token = F.col("_token")
    unlisted = F.col("listing_error") if "listing_error" in df.columns else F.lit(None).cast("string")
    return (
        df.withColumn("_token", naming.specification_token(F.col("filename")))
        .withColumn("specification", F.when((token != "") & unlisted.isNull(), token))
        .withColumn(
            "file_error",
            F.coalesce(unlisted, specification_error(F.col("filename"), F.col("specification"), specs)),
        )
        .drop("_token")
    )


def add_name_slots(df: DataFrame, specs: Registry) -> DataFrame:
    """Add `_slots`, the split file name, and `_step`, its first illegal step
    (0 for a legal name); both null without a registered specification."""
    filename = F.col("filename")
    slots = by_spec(
        F.col("specification"),
        specs,
        lambda s: naming.rewrite_name(filename, s.filename_fields, s.asset_name_fields),
    )
    df = df.withColumn("_slots", naming.split_slots(filename, slots.cast("string")))
    return df.withColumn("_step", naming.failed_step(F.col("_slots")))


def is_parsed() -> Column:
    return F.coalesce(F.col("_step") == 0, F.lit(False))


def add_filename_error(df: DataFrame, specs: Registry) -> DataFrame:
    """Add `filename_error`, the parse error of the name (needs `_step`)."""
    texts = by_spec(
        F.col("specification"), specs, lambda s: naming.step_texts(s.filename_fields)
    ).cast("array<string>")
    step = F.coalesce("_step", F.lit(1))
    return df.withColumn(
        "filename_error", naming.step_error(F.col("filename"), step, texts)
    )


def expected_asset_name() -> Column:
    """Asset name rebuilt from the file name, null where that did not parse."""
    return F.when(is_parsed(), naming.slot_asset_name(F.col("_slots")))


def directory_error(specs: Registry) -> Column:
    """Error of the asset directory's name; `file` assets have no directory.

    A directory that is as expected needs no parsing, so the grammar is only
    asked about the others.
    """
    actual, expected = paths.file_name(F.col("asset_path")), expected_asset_name()
    mismatch = F.concat(
        F.lit("Invalid asset directory name. Expecting: "),
        expected,
        F.lit(". Found: "),
        actual,
        F.lit(" in "),
        F.col("filepath"),
        F.lit("."),
    )
    layouts: dict[tuple[str, ...], list[str]] = {}
    for name, spec in specs.items():
        if spec.asset_type != "file":
            layouts.setdefault(tuple(spec.asset_name_fields), []).append(name)
    error = F.lit(None).cast("string")
    for fields, names in layouts.items():
        error = F.when(
            F.col("specification").isin(names) & (actual != expected),
            F.coalesce(naming.name_error(actual, fields), mismatch),
        ).otherwise(error)
    return error


def validate_filepath(df: DataFrame, specs: Registry) -> DataFrame:
    """Add path errors to `file_error` on rows that have none yet.

    Needs `specification`, `file_error`, `asset_path` and the name slots.
    """
    found = F.coalesce(F.col("filename_error"), directory_error(specs))
    text = F.concat(F.lit("ValidationError( "), found, F.lit(" )"))
    return df.withColumn("file_error", F.coalesce(F.col("file_error"), text))


def add_asset_path(df: DataFrame, specs: Registry) -> DataFrame:
    return df.withColumn(
        "asset_path",
        by_spec(
            F.col("specification"), specs, lambda s: s.path_of_asset(F.col("filepath"))
        ).cast("string"),
    )


def add_asset_type(df: DataFrame, specs: Registry) -> DataFrame:
    return df.withColumn(
        "asset_type",
        by_spec(F.col("specification"), specs, lambda s: F.lit(s.asset_type)).cast(
            "string"
        ),
    )


def add_asset_name(df: DataFrame) -> DataFrame:
    """Add `asset_name` on rows without an error (needs the name slots)."""
    return df.withColumn(
        "asset_name", F.when(F.col("file_error").isNull(), expected_asset_name())
    )


def add_asset_id(df: DataFrame) -> DataFrame:
    """Add the name-based id of the asset on rows without an error."""
    return df.withColumn(
        "asset_id",
        F.when(F.col("file_error").isNull(), paths.url_uuid(F.col("asset_path"))),
    )


def add_relative_path(df: DataFrame, column: str, root: str) -> DataFrame:
    return df.withColumn(f"{column}_relative", paths.relative_path(F.col(column), root))


def add_file_traits(df: DataFrame, specs: Registry) -> DataFrame:
    """Add `file_traits` for every file of a registered specification.

    Byte traits come from columns of the listing: `width`, `height`, `channels`,
    and the maps `user_traits` and `trait_errors`, each where present.  A user
    trait replaces the name field or image trait of the same name.  Needs the name slots.
    """
    spec = F.col("specification")
    has_user = "user_traits" in df.columns
    has_errors = "trait_errors" in df.columns

    def name_field(field: str, value: Column) -> Column:
        value = F.when(is_parsed(), value)
        if has_user and field != "coordinate":
            dtype = "int" if field in ("version", "frame") else "string"
            user = F.try_element_at(F.col("user_traits"), F.lit(field))
            value = F.coalesce(user.try_cast(dtype), value)
        return value.alias(field)

    def image(field: str) -> Column:
        carriers = [n for n, s in specs.items() if field in s.image_traits]
        value = F.lit(None).cast("int")
        if field in df.columns and carriers:
            value = F.when(spec.isin(carriers), F.col(field).cast("int"))
        if has_user:
            user = F.try_element_at(F.col("user_traits"), F.lit(field))
            value = F.coalesce(user.try_cast("int"), value)
        return value.alias(field)

    def optional_map(present: bool, column: str, alias: str) -> Column:
        value = F.col(column) if present else F.lit(None)
        return value.cast("map<string,string>").alias(alias)

    traits = F.struct(
        *[
            name_field(f, v)
            for f, v in zip(naming.FIELDS, naming.slot_fields(F.col("_slots")))
        ],
        *[image(t) for t in IMAGE_TRAITS],
        F.col("filename_error"),
        optional_map(has_errors, "trait_errors", "errors"),
        optional_map(has_user, "user_traits", "user"),
    )
    return df.withColumn("file_traits", F.when(is_registered(spec, specs), traits))


def with_name(listing: DataFrame, specs: Registry) -> DataFrame:
    """Listing with specification, name slots and name error."""
    df = add_specification(listing, specs)
    df = add_name_slots(df, specs)
    return add_filename_error(df, specs)


def file_rows(listing: DataFrame, specs: Registry, root: str) -> DataFrame:
    """All per-file columns of the catalog, plus the listing's key columns."""
    extra = [
        c
        for c in listing.columns
        if c not in ("filepath", "filename", "extension", *IMAGE_TRAITS)
        and c not in ("user_traits", "trait_errors", "listing_error")
    ]
    df = with_name(listing, specs)
    df = add_asset_path(df, specs)
    df = validate_filepath(df, specs)
    df = add_file_traits(df, specs)
    df = add_asset_name(df)
    df = add_asset_type(df, specs)
    df = add_relative_path(df, "filepath", root)
    df = add_relative_path(df, "asset_path", root)
    return df.select(
        "specification",
        "extension",
        "filename",
        "filepath",
        "file_error",
        "file_traits",
        "asset_name",
        "asset_path",
        "asset_type",
        "asset_path_relative",
        "filepath_relative",
        *extra,
    )


def cleanup(df: DataFrame) -> DataFrame:
    """Catalog columns first in fixed order, absent ones added as null, the
    others after them by name."""
    types = {"file_traits": FILE_TRAITS_TYPE, "asset_traits": ASSET_TRAITS_TYPE}
    head = [
        F.col(c) if c in df.columns else F.lit(None).cast(t or types[c]).alias(c)
        for c, t in CATALOG_COLUMNS.items()
    ]
    tail = sorted(c for c in df.columns if c not in CATALOG_COLUMNS)
    return df.select(*head, *tail)
