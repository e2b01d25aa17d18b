"""Publishing tables: what is copied where, and the metadata documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetry.functions import paths
from assetry.functions.naming import format_name
from assetry.operators.grouping import PART_SIZE, null_if_empty, part_lists

# Kinds of metadata and the directories of a staging tree.
METADATA_TYPES = ("asset", "file", "asset-chunk", "file-chunk")
STAGING_DIRECTORIES = (
    "content",
    "metadata",
    "metadata/asset",
    "metadata/file",
    "metadata/asset-chunk",
    "metadata/file-chunk",
)
TRAIT_LISTS = (
    "project",
    "specification",
    "descriptor",
    "version",
    "coordinate",
    "frame",
    "extension",
    "width",
    "height",
    "channels",
)
FILE_DOCUMENT = (
    "asset_id",
    "asset_path",
    "asset_path_relative",
    "asset_name",
    "asset_type",
    "file_id",
    "file_traits",
    "filename",
    "filepath",
    "filepath_relative",
)
ASSET_DOCUMENT = (
    "asset_id",
    "asset_path",
    "asset_path_relative",
    "asset_name",
    "asset_traits",
    "asset_type",
    "file_ids",
    "filenames",
    "filepaths",
    "filepaths_relative",
    "part",
    "n_parts",
)


def valid_files(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("asset_valid"))


def with_ids(catalog: DataFrame) -> DataFrame:
    """Add `asset_id` and `file_id`, name-based so that a retry gives the same."""
    return catalog.withColumn(
        "asset_id", paths.url_uuid(F.col("asset_path"))
    ).withColumn("file_id", paths.url_uuid(F.col("filepath")))


def _content(relative: Column, staging: str) -> Column:
    return F.concat(F.lit(f"{staging.rstrip('/')}/content/"), relative)


def copy_plan(catalog: DataFrame, root: str, staging: str) -> DataFrame:
    """Source and target of every valid file."""
    return valid_files(catalog).select(
        F.col("filepath").alias("source"),
        paths.move_root(F.col("filepath"), root, f"{staging.rstrip('/')}/content").alias(
            "target"
        ),
    )


def file_metadata(catalog: DataFrame, staging: str) -> DataFrame:
    """One document per valid file; paths are those in the staging tree."""
    return (
        with_ids(valid_files(catalog))
        .withColumn("asset_path", _content(F.col("asset_path_relative"), staging))
        .withColumn("filepath", _content(F.col("filepath_relative"), staging))
        .select(*FILE_DOCUMENT)
    )


def asset_lists(catalog: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """One row per asset and part: lists of every trait, over all its files."""
    rows = catalog.where(F.col("asset_path").isNotNull()).select(
        "asset_path", "filepath", "file_traits"
    )
    lists = part_lists(
        rows, ["asset_path"], "filepath", {t: F.col("file_traits")[t] for t in TRAIT_LISTS}, part_size
    )
    return lists.select(
        "asset_path", "part", *[null_if_empty(F.col(t)).alias(t) for t in TRAIT_LISTS]
    )


def _named_files(catalog: DataFrame) -> DataFrame:
    """Files of assets without an error of their own: those that documents cover."""
    return catalog.where(F.col("asset_path").isNotNull() & F.col("asset_error").isNull())


def published_assets(catalog: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """asset_id, asset_name, n_parts of every asset with at least one valid file; the
    name is that of its first valid file."""
    return (
        with_ids(_named_files(catalog))
        .groupBy("asset_id")
        .agg(*[v.alias(n) for n, v in _whole_asset(part_size).items()])
        .where(F.col("first").isNotNull())
        .select("asset_id", F.col("first.asset_name").alias("asset_name"), "n_parts")
    )


def _whole_asset(part_size: int) -> dict[str, Column]:
    """Aggregates over the files of an asset."""
    return {
        "first": F.min(F.when(F.col("asset_valid"), F.struct("filepath", "asset_name"))),
        "n_parts": F.ceil(F.count("*") / part_size),
    }


def asset_metadata(
    catalog: DataFrame, staging: str, part_size: int = PART_SIZE
) -> DataFrame:
    """Documents of every asset with at least one valid file.

    Lists hold the valid files in path order; `filepaths` are source paths.
    `asset_traits` covers all files of the asset.  A document covers up to
    `part_size` files, so no task builds a longer list; an asset's documents are
    numbered by `part`, of `n_parts`, and put together in that order they are the
    same whatever the size.  A part without a valid file has empty lists.
    """
    # these are the same for all files of an asset
    constant = ["asset_path_relative", "asset_type"]
    rows = _named_files(catalog).select(
        "asset_path", *constant, "asset_valid", "asset_name", "filename", "filepath",
        "filepath_relative", "file_traits",
    )
    valid = F.col("asset_valid")
    listed = {
        "filenames": "filename",
        "filepaths": "filepath",
        "filepaths_relative": "filepath_relative",
    }
    lists = part_lists(
        rows,
        ["asset_path"],
        "filepath",
        {n: F.when(valid, F.col(c)) for n, c in listed.items()}
        | {f"t_{t}": F.col("file_traits")[t] for t in TRAIT_LISTS},
        part_size,
        {c: F.min(c) for c in constant} | _whole_asset(part_size),
    )
    traits = F.struct(*[null_if_empty(F.col(f"t_{t}")).alias(t) for t in TRAIT_LISTS])
    return (
        lists.where(F.col("first").isNotNull())
        .withColumn("asset_name", F.col("first.asset_name"))
        .withColumn("asset_traits", traits)
        # ids are digests, which no shuffle can compress, so they are made after it
        .withColumn("asset_id", paths.url_uuid(F.col("asset_path")))
        .withColumn("file_ids", F.transform("filepaths", paths.url_uuid))
        .withColumn("asset_path", _content(F.col("asset_path_relative"), staging))
        .select(*ASSET_DOCUMENT)
    )


def document_file(kind: str, part: Column | None = None) -> Column:
    """Place of a document below `metadata`; parts after the first are numbered."""
    name = F.concat(F.lit(f"{kind}/"), F.col(f"{kind}_id"))
    if part is not None:
        name = F.concat(name, F.when(part > 0, F.concat(F.lit("."), part)).otherwise(F.lit("")))
    return F.concat(name, F.lit(".json"))


def json_lines(documents: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One JSON text per document, in a column `value`."""
    return documents.select(F.to_json(F.struct(*fields)).alias("value"))


def document_targets(
    documents: DataFrame, kind: str, fields: Sequence[str], staging: str
) -> DataFrame:
    """Documents as (target, value): one JSON file per document."""
    part = F.col("part") if "part" in documents.columns else None
    return documents.select(
        F.concat(F.lit(f"{staging.rstrip('/')}/metadata/"), document_file(kind, part)).alias("target"),
        F.to_json(F.struct(*fields)).alias("value"),
    )


def metadata_documents(
    catalog: DataFrame,
    staging: str,
    kinds: Sequence[str] = METADATA_TYPES,
    part_size: int = PART_SIZE,
) -> DataFrame:
    """metadata_type, id, part, value of all documents of the kinds asked for; file
    documents have part 0.  A chunk holds the documents of its kind, which are made
    once for both."""
    unknown = sorted(set(kinds) - set(METADATA_TYPES))
    if unknown:
        raise ValueError(f"No metadata is called {', '.join(unknown)}; there is {', '.join(METADATA_TYPES)}.")
    found = []
    for family, fields in (("asset", ASSET_DOCUMENT), ("file", FILE_DOCUMENT)):
        own = [k for k in kinds if k.startswith(family)]
        if own:
            if family == "asset":
                docs = asset_metadata(catalog, staging, part_size)
            else:
                docs = file_metadata(catalog, staging).withColumn("part", F.lit(0).cast("long"))
            found.append(
                docs.select(
                    F.explode(F.array(*map(F.lit, own))).alias("metadata_type"),
                    F.col(f"{family}_id").alias("id"),
                    "part",
                    F.to_json(F.struct(*fields)).alias("value"),
                )
            )
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def object_keys(
    catalog: DataFrame, staging: str, prefix: str, part_size: int = PART_SIZE
) -> DataFrame:
    """Keys under which an object store holds contents and documents, one for each
    part of an asset."""
    prefix = prefix.rstrip("/") + "/"
    files = with_ids(valid_files(catalog))
    content = files.select(
        F.lit("content").alias("kind"),
        F.concat(F.lit(prefix + "content/"), F.col("filepath_relative")).alias("object_key"),
        _content(F.col("filepath_relative"), staging).alias("source"),
    )

    def metadata(rows: DataFrame, kind: str, part: Column | None = None) -> DataFrame:
        file = F.concat(F.lit("metadata/"), document_file(kind, part))
        return rows.select(
            F.lit(kind).alias("kind"),
            F.concat(F.lit(prefix), file).alias("object_key"),
            F.concat(F.lit(staging.rstrip("/") + "/"), file).alias("source"),
        )

    parts = published_assets(catalog, part_size).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1))
    )
    return content.unionByName(metadata(files, "file")).unionByName(
        metadata(parts, "asset", F.col("part"))
    )


def export_folders(catalog: DataFrame) -> DataFrame:
    """Every folder of the published tree once, with its parent and, on the
    folder of an asset, the asset's id.  Single-file assets have no folder."""
    files = with_ids(valid_files(catalog))
    held = files.select(
        paths.parent_path(F.concat(F.lit("/"), F.col("filepath_relative"))).alias("folder"),
        F.when(
            F.col("asset_type") != "file",
            F.concat(F.lit("/"), F.col("asset_path_relative")),
        ).alias("asset_folder"),
        F.when(F.col("asset_type") != "file", F.col("asset_id")).alias("asset_id"),
    ).distinct()
    assets = (
        held.where(F.col("asset_folder").isNotNull())
        .select(F.col("asset_folder").alias("folder"), "asset_id")
        .distinct()
    )
    every = (
        held.select("folder")
        .unionByName(assets.select("folder"))
        .distinct()
        .select(
            F.explode(
                F.concat(paths.ancestors(F.col("folder")), F.array(F.col("folder")))
            ).alias("folder")
        )
        .where(F.col("folder") != "/")
        .distinct()
    )
    return every.join(assets, "folder", "left").select(
        "folder",
        paths.file_name(F.col("folder")).alias("name"),
        paths.parent_path(F.col("folder")).alias("parent_folder"),
        "asset_id",
    )


def export_items(catalog: DataFrame) -> DataFrame:
    """Every published file with the folder that holds it."""
    return with_ids(valid_files(catalog)).select(
        "file_id",
        F.col("filename").alias("name"),
        paths.parent_path(F.concat(F.lit("/"), F.col("filepath_relative"))).alias(
            "parent_folder"
        ),
        F.col("filepath").alias("source"),
    )


def folder_objects(catalog: DataFrame, staging: str) -> DataFrame:
    """Objects (object_key, source or value) of a published tree of folders and items."""
    none = F.lit(None).cast("string")
    folders = export_folders(catalog)
    described = folders.select(
        F.concat(F.substring("folder", 2, 1 << 20), F.lit("/.folder.json")).alias("object_key"),
        none.alias("source"),
        F.to_json(F.struct(*folders.columns)).alias("value"),
    )
    items = export_items(catalog)
    place = F.substring(F.concat("parent_folder", F.lit("/"), "name"), 2, 1 << 20)
    contents = items.select(place.alias("object_key"), _content(place, staging).alias("source"), none.alias("value"))
    told = items.select(
        F.concat(place, F.lit(".item.json")).alias("object_key"),
        none.alias("source"),
        F.to_json(F.struct(*items.columns)).alias("value"),
    )
    return described.unionByName(contents).unionByName(told)


def directories(listing: DataFrame, column: str = "filepath") -> DataFrame:
    """Every directory above a listed path, once.

    Parents are made distinct before their ancestors are expanded, so a
    directory of a billion files is expanded once.
    """
    parents = listing.select(paths.parent_path(F.col(column)).alias("d")).distinct()
    return (
        parents.select(
            F.explode(F.concat(paths.ancestors(F.col("d")), F.array("d"))).alias("directory")
        )
        .where(F.col("directory") != "/")
        .distinct()
    )


def empty_directories(
    directory_table: DataFrame, listing: DataFrame, ignored: str = ".DS_Store"
) -> DataFrame:
    """Directories with no file beneath them, `ignored` files not counting."""
    used = directories(listing.where(F.col("filename") != ignored))
    return directory_table.select("directory").join(used, "directory", "left_anti")


def missing_files(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Expected paths that the listing does not hold."""
    return expected.join(listing.select("filepath"), "filepath", "left_anti")


def staging_missing(seen: DataFrame, staging: str) -> DataFrame:
    """Directories a staging tree needs and does not have."""
    spark: SparkSession = seen.sparkSession
    needed = spark.createDataFrame(
        [(f"{staging.rstrip('/')}/{d}",) for d in STAGING_DIRECTORIES], "directory string"
    )
    return needed.join(seen, "directory", "left_anti")


def expand_filepaths(assets: DataFrame, root: Column, specification: str, specs) -> DataFrame:
    """Asset rows with parallel lists to the file paths they stand for.

    Every name field is a list with one value per file.
    """
    spec = specs[specification]
    fields = tuple(dict.fromkeys([*spec.filename_fields, *spec.asset_name_fields]))
    rows = assets.withColumn("_root", root).select(
        "*", F.posexplode(F.arrays_zip(*fields)).alias("position", "_file")
    )
    traits = {f: F.col("_file")[f] for f in fields}
    filename = format_name(traits, spec.filename_fields)
    if spec.asset_type == "file":
        path = F.concat_ws("/", "_root", filename)
    else:
        path = F.concat_ws("/", "_root", format_name(traits, spec.asset_name_fields), filename)
    return rows.withColumn("filepath", path).drop("_root", "_file")
