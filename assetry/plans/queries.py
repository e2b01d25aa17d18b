"""Every operator as a query over the test tables.

A query takes a session and a folder of Parquet tables.  Those on files start
from the listing derived of `lineitem` (see sources.fixtures).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetry.functions import naming, paths
from assetry.functions import rules as R
from assetry.operators import assets, files, graph, grouping, publish, set_rules
from assetry.operators.merging import Aggregator
from assetry.operators.merging import group_merge as group_merge_of
from assetry.plans import catalog as plans
from assetry.plans import workflow
from assetry.plans.searches import CTE_SEARCH, GROUP_CONCAT_SEARCH, RECURSIVE_SEARCH, SEARCHES, SPARK_LIST
from assetry.plans.store import Store
from assetry.session import configure
from assetry.sources import fixtures, listing, metadata, objects, progress, staging, traits
from assetry.sources.fixtures import ROOT, STAGING
from assetry.sources.tables import materialized, shared_folder
from assetry.specs import EXAMPLE_SPECS, LISTING_SPECS, SET_SPECS, SHIPPED_SPECS, Spec, registry, spec_table, trait
from assetry.streaming import catalog as streams

Query = Callable[[SparkSession, str], DataFrame]
SPECS = LISTING_SPECS
# Files of a document or list in these queries: few, so that assets span several.
PART_SIZE = 4
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.listing(spark, sf_dir)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_rows(_listing(spark, sf_dir), SPECS, ROOT)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.update(_listing(spark, sf_dir).drop("ok", "ln", "pk"), SPECS, ROOT)


# Listings as they were before and are after changes of all kinds (columns `width`, `ok`, `ln`, `pk`).
BEFORE = ("pk % 13 <> 1", "if(pk % 17 = 2 AND width IS NOT NULL, 40, width)")
AFTER = ("pk % 11 <> 5", "width")
_stores: dict[tuple, Store] = {}


def _store(spark: SparkSession, sf_dir: str, *states: tuple[str, str]) -> Store:
    """The saved catalog of a folder of tables, made once in an application and read by all
    queries; with a version for each state of its listing (by default the whole one)."""
    key = (spark.sparkContext.applicationId, sf_dir, states)
    if key not in _stores or not _stores[key].versions():
        store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4()}")
        for kept, width in states or [("true", "width")]:
            table = _listing(spark, sf_dir).where(kept).withColumn("width", F.expr(width).cast("int"))
            store.update(table.drop("ok", "ln", "pk"), SPECS, ROOT)
        _stores[key] = store
    return _stores[key]


def _saved_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).read()


def _data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.read_files(_saved_catalog(spark, sf_dir))


def _text(array: Column) -> Column:
    return F.array_join(array.cast("array<string>"), ",")


# --- sources and sinks ------------------------------------------------------


@query
def listing_columns(spark, sf_dir):
    return listing.with_names(_listing(spark, sf_dir).select("filepath"))


@query
def scan_directories(spark, sf_dir):
    return publish.directories(_listing(spark, sf_dir))


@query
def filter_include(spark, sf_dir):
    return listing.filter_paths(
        _listing(spark, sf_dir), include="/spec00[12]/.*_v1"
    ).select("filepath")


@query
def filter_exclude(spark, sf_dir):
    return listing.filter_paths(_listing(spark, sf_dir), exclude="misc|/raw").select(
        "filepath"
    )


@query
def filter_include_exclude(spark, sf_dir):
    return listing.filter_paths(
        _listing(spark, sf_dir), include="proj01[0-9]", exclude=r"\.png$"
    ).select("filepath")


@query
def file_metadata(spark, sf_dir):
    docs = publish.file_metadata(_saved_catalog(spark, sf_dir), STAGING)
    return docs.withColumn("file_traits", F.to_json("file_traits"))


@query
def file_chunk(spark, sf_dir):
    docs = publish.file_metadata(_saved_catalog(spark, sf_dir), STAGING)
    return publish.json_lines(docs, publish.FILE_DOCUMENT)


@query
def asset_metadata(spark, sf_dir):
    docs = publish.asset_metadata(_saved_catalog(spark, sf_dir), STAGING, PART_SIZE)
    for lists in ("file_ids", "filenames", "filepaths", "filepaths_relative"):
        docs = docs.withColumn(lists, _text(F.col(lists)))
    return docs.withColumn("asset_traits", F.to_json("asset_traits"))


@query
def asset_chunk(spark, sf_dir):
    docs = publish.asset_metadata(_saved_catalog(spark, sf_dir), STAGING, PART_SIZE)
    return publish.json_lines(docs, publish.ASSET_DOCUMENT)


@query
def metadata_by_type(spark, sf_dir):
    docs = publish.metadata_documents(
        _saved_catalog(spark, sf_dir), STAGING, ["asset", "file"], PART_SIZE
    )
    return docs.select("metadata_type", "id", "part", F.sha2("value", 256).alias("value_sha256"))


@query
def export_content_manifest(spark, sf_dir):
    lines = file_chunk(spark, sf_dir)
    return metadata.content_manifest(metadata.parse_file_documents(lines), "/export")


@query
def copy_plan(spark, sf_dir):
    return publish.copy_plan(_saved_catalog(spark, sf_dir), ROOT, STAGING)


@query
def export_object_keys(spark, sf_dir):
    return publish.object_keys(_saved_catalog(spark, sf_dir), STAGING, "catalog", PART_SIZE)


@query
def export_folders(spark, sf_dir):
    return publish.export_folders(_saved_catalog(spark, sf_dir))


@query
def export_items(spark, sf_dir):
    return publish.export_items(_saved_catalog(spark, sf_dir))


@query
def staging_missing(spark, sf_dir):
    catalog = _saved_catalog(spark, sf_dir)
    docs = publish.document_targets(
        publish.file_metadata(catalog, STAGING), "file", publish.FILE_DOCUMENT, STAGING
    )
    written = publish.copy_plan(catalog, ROOT, STAGING).select("target")
    written = written.unionByName(docs.select("target"))
    return publish.staging_missing(publish.directories(written, "target"), STAGING)


@query
def empty_directories(spark, sf_dir):
    table = _listing(spark, sf_dir)
    hidden = F.col("pk") % 50 < 20
    left = table.withColumn(
        "filename", F.when(hidden, F.lit(".DS_Store")).otherwise(F.col("filename"))
    )
    return publish.empty_directories(publish.directories(table), left)


@query
def progress_latest(spark, sf_dir):
    return progress.latest_progress(
        _log(spark, sf_dir), "name", F.struct("created", "event_id"), "step", "total", "message"
    )


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a progress log: one log per user, step from the event's JSON."""
    records = fixtures.table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("name"),
        F.col("ts").alias("created"),
        F.get_json_object("props", "$.k").cast("int").alias("step"),
        F.when(F.col("event_id") % 10 == 0, F.lit(0)).otherwise(F.lit(100)).alias("total"),
        F.col("event_type").alias("text"),
    )
    return progress.with_message(records, F.col("step"), F.col("total"), F.col("text"))


@query
def progress_message(spark, sf_dir):
    return _log(spark, sf_dir).select("event_id", "progress", "message")


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of files made of `part`: name and value."""
    return fixtures.table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), F.col("p_partkey") % 7, F.lit("/part"), "p_partkey", F.lit(".txt")).alias("name"),
        F.concat("p_name", F.lit("\n"), "p_brand").alias("value"),
    )


def _written(spark: SparkSession, texts: DataFrame, folder: str) -> DataFrame:
    """Write texts below a folder; their targets, with name."""
    target = F.concat(F.lit(f"{folder}/"), "name")
    staging.write_documents(texts.withColumn("target", target)).write.format("noop").mode("overwrite").save()
    return texts.select("name", target.alias("source"))


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


@query
def stage_content(spark, sf_dir):
    """Files made of `part`, copied in two runs with one ledger."""
    folder = _fresh(spark, "files")
    sources = _written(spark, _part_files(spark, sf_dir), f"{folder}/in")
    plan = sources.select("source", F.concat(F.lit(f"{folder}/out/"), "name").alias("target"))
    objects.recorded(plan.where("target LIKE '%/m3/%'"), f"{folder}/ledger")
    done = objects.recorded(plan, f"{folder}/ledger")
    return done.withColumn("target", paths.relative_path(F.col("target"), f"{folder}/out"))


@query
def export_objects(spark, sf_dir):
    """Files made of `part`, published under their keys, and read from there."""
    folder = _fresh(spark, "objects")
    sources = _written(spark, _part_files(spark, sf_dir), f"{folder}/in")
    objects.export_objects(sources.withColumnRenamed("name", "object_key"), f"{folder}/out")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = found.option("pathGlobFilter", "part*").load(f"{folder}/out")
    key = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
    return found.select(key.alias("object_key"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query
def read_metadata(spark, sf_dir):
    """JSON documents made of `part`, one file each, as rows."""
    folder = _fresh(spark, "documents")
    value = F.to_json(F.struct("p_partkey", "p_name", F.struct("p_brand", "p_size").alias("more")))
    docs = fixtures.table(spark, sf_dir, "part").select(
        F.concat(F.lit("d"), F.col("p_partkey") % 7, F.lit("/"), "p_partkey", F.lit(".json")).alias("name"),
        F.concat(F.lit("/* a part */ "), value).alias("value"),
    )
    _written(spark, docs, folder)
    schema = "p_partkey bigint, p_name string, more struct<p_brand: string, p_size: int>"
    read = metadata.read_json(spark, f"{folder}/*", schema)
    return read.select("p_partkey", "p_name", "more.p_brand", "more.p_size")


@query
def export_disk(spark, sf_dir):
    """The workflow from a tree of files made of `part` to an export: names that do not parse stay
    out, and so do wrong extensions."""
    # trees are listed on a mounted file system, by plain paths
    folder = re.sub("^file:(//)?(?=/)", "", _fresh(spark, "workflow"))
    part = F.col("p_partkey")
    name = F.concat(
        F.lit("p-proj"), naming.padded(part % 25 + 1, 3), F.lit("_s-vdb001_d-part"), part,
        F.when(part % 9 == 4, F.lit("_x")).otherwise(F.lit("_v")), naming.padded(part % 999 + 1, 3),
        F.when(part % 10 == 3, F.lit(".abc")).otherwise(F.lit(".vdb")),
    )
    texts = fixtures.table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), part % 7, F.lit("/"), name).alias("name"), F.col("p_name").alias("value")
    )
    _written(spark, texts, f"{folder}/in")
    project = workflow.Project(
        spark, f"{folder}/in", f"{folder}/staging", SPECS, exporters=[workflow.disk_exporter(f"{folder}/out")]
    )
    workflow.workflow(project, ["delete", "update", "create", "export"])
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/out/content")
    place = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
    return found.select(place.alias("name"), F.sha2("content", 256).alias("sha256"))


# --- projections, filters, predicates ---------------------------------------


@query
def cond_column(spark, sf_dir):
    table = files.when_else(
        _listing(spark, sf_dir),
        "size_class",
        F.col("width") > 100,
        F.concat(F.lit("wide "), F.col("width")),
        F.coalesce(F.col("width").cast("string"), F.lit("no image")),
    )
    return table.select("filepath", "size_class")


@query
def add_specification(spark, sf_dir):
    table = files.add_specification(_listing(spark, sf_dir), SPECS)
    return table.select("filepath", "specification", "file_error")


@query
def spec_not_found(spark, sf_dir):
    table = files.add_specification(_listing(spark, sf_dir), SPECS)
    return table.where(F.col("file_error") == files.SPEC_UNKNOWN).select(
        "filepath", "specification", "file_error"
    )


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = files.with_name(_listing(spark, sf_dir), SPECS)
    slots = naming.slot_fields(F.col("_slots"))
    fields = [
        F.when(files.is_parsed(), v).alias(n) for n, v in zip(naming.FIELDS, slots)
    ]
    return table.select("filepath", "filename", *[f.alias(f"n_{n}") for n, f in zip(naming.FIELDS, fields)],
                        "filename_error", F.col("specification").alias("spec"))


@query
def parse_filename(spark, sf_dir):
    table = _parsed(spark, sf_dir)
    return table.select(
        "filepath",
        *[
            (_text(F.col(f"n_{f}")) if f == "coordinate" else F.col(f"n_{f}")).alias(f)
            for f in naming.FIELDS
        ],
    )


@query
def format_name(spark, sf_dir):
    fields = {f: F.col(f"n_{f}") for f in naming.FIELDS}
    name = F.when(F.col("n_project").isNotNull(), naming.format_name(fields, naming.FIELDS))
    return _parsed(spark, sf_dir).select("filepath", name.alias("name"))


@query
def parse_extension(spark, sf_dir):
    name = F.col("filename")
    return _listing(spark, sf_dir).select(
        "filepath",
        naming.parse_extension(name).alias("extension"),
        naming.parse_name(name, ["extension"]).getField("extension").alias("parsed_extension"),
    )


@query
def filename_error(spark, sf_dir):
    return files.with_name(_listing(spark, sf_dir), SPECS).select(
        "filepath", "filename_error"
    )


@query
def validate_filepath(spark, sf_dir):
    return _rows(spark, sf_dir).select("filepath", "file_error")


@query
def file_traits(spark, sf_dir):
    return _rows(spark, sf_dir).select(
        "filepath", F.to_json("file_traits").alias("file_traits")
    )


def _path_depth(path: str) -> int:
    return path.count("/")


def _line_number(path: str) -> int:
    """Order number of a path; files with no clean version have none."""
    if "_v0" in path:
        raise ValueError("version below 100")
    return int(path.split("/o")[1].split("/")[0])


TRAIT_SPECS = registry(
    [
        Spec(
            "vdb001",
            asset_type="file",
            traits={"depth": trait(R.is_int()), "order": trait(R.is_int())},
            file_traits={"depth": _path_depth, "order": _line_number},
        ),
        Spec("spec002", file_traits={"order": _line_number}),
    ]
)


@query
def user_traits(spark, sf_dir):
    table = traits.read_traits(_listing(spark, sf_dir).select("filepath", "filename"), TRAIT_SPECS)
    return table.select(
        "filepath",
        F.try_element_at("user_traits", F.lit("depth")).try_cast("int").alias("depth"),
        F.try_element_at("user_traits", F.lit("order")).try_cast("int").alias("order_number"),
        F.try_element_at("trait_errors", F.lit("order_error")).alias("order_error"),
    )


@query
def image_traits(spark, sf_dir):
    """Headers of PNG and JPEG files, built by Spark from the listed sizes."""

    def hexed(value: Column, digits: int) -> Column:
        return F.lpad(F.hex(value.cast("long")), digits, "0")

    table = _listing(spark, sf_dir)
    png = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"),
        hexed(F.col("width"), 8),
        hexed(F.col("height"), 8),
        F.lit("0802000000FFFFFFFF"),
    )
    jpeg = F.concat(
        F.lit("FFD8FFE000040000FFC0001108"),
        hexed(F.col("height"), 4),
        hexed(F.col("width"), 4),
        F.lit("03"),
    )
    header = F.when(F.col("extension") == "png", png).when(
        F.col("extension") == "jpg", jpeg
    )
    content = table.select(
        "filepath", F.unhex(F.coalesce(header, F.lit(""))).alias("content")
    )
    return traits.image_sizes_of(content, "content")


@query
def relative_path(spark, sf_dir):
    table = files.add_relative_path(_listing(spark, sf_dir), "filepath", ROOT + "/")
    return table.select(
        "filepath_relative",
        paths.relative_path(F.col("filepath"), "/ingress/proj001").alias("below_project"),
    )


@query
def asset_name(spark, sf_dir):
    return _rows(spark, sf_dir).select("filepath", "asset_name")


@query
def asset_path(spark, sf_dir):
    return _rows(spark, sf_dir).select("filepath", "asset_path", "asset_path_relative")


@query
def asset_type(spark, sf_dir):
    return _rows(spark, sf_dir).select("filepath", "asset_type")


@query
def asset_id(spark, sf_dir):
    return files.add_asset_id(_rows(spark, sf_dir)).select("filepath", "asset_id")


@query
def asset_valid(spark, sf_dir):
    rows = materialized(_rows(spark, sf_dir), "files")
    return assets.add_asset_valid(rows, SPECS).select("filepath", "asset_valid")


@query
def cleanup(spark, sf_dir):
    table = files.cleanup(_rows(spark, sf_dir).drop("ok", "ln", "pk"))
    return table.withColumn("file_traits", F.to_json("file_traits")).withColumn(
        "asset_traits", F.to_json("asset_traits")
    )


@query
def read_files(spark, sf_dir):
    return _data(spark, sf_dir)


@query
def read_scalar_columns(spark, sf_dir):
    return plans.scalar_columns(_saved_catalog(spark, sf_dir))


@query
def valid_files(spark, sf_dir):
    return publish.valid_files(_saved_catalog(spark, sf_dir)).select("filepath", "asset_path")


@query
def expand_filepaths(spark, sf_dir):
    table = _listing(spark, sf_dir)
    fields = {
        "project": F.concat(F.lit("proj"), naming.padded(F.col("ok") % 25 + 1, 3)),
        "specification": F.lit("spec002"),
        "descriptor": F.lit("bagel"),
        "version": (F.col("ok") % 999 + 1).cast("int"),
        "frame": F.col("ln") * 1000 + F.col("pk"),
        "extension": F.lit("jpg"),
    }
    rows = table.select("ok", "filepath", *[v.alias(n) for n, v in fields.items()])
    lists = grouping.to_prototype(
        rows, ["ok"], "filepath", {n: F.col(n) for n in fields}
    )
    root = F.concat(F.lit(ROOT + "/by-order/"), F.col("ok").cast("string"))
    return publish.expand_filepaths(lists, root, "spec002", SPECS).select("ok", "filepath")


@query
def redact_columns(spark, sf_dir):
    table = fixtures.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_number"),
        F.col("c_name").alias("access_key"),
        F.struct(
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").cast("string").alias("root_id"),
        ).alias("settings"),
        F.col("c_mktsegment").alias("callback_url"),
        F.array(
            F.struct(F.col("c_name").alias("secret_key"), F.col("c_nationkey").cast("string").alias("n"))
        ).alias("logins"),
        F.create_map(F.lit("access_key"), F.col("c_name"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias(
            "options"
        ),
    )
    plain = paths.redact(table)
    return plain.select(
        "customer_number",
        "access_key",
        F.to_json("settings").alias("settings"),
        F.to_json("logins").alias("logins"),
        F.to_json("options").alias("options"),
        "callback_url",
    )


@query
def redact_hash(spark, sf_dir):
    table = fixtures.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_number"),
        F.col("c_name").alias("access_key"),
        F.create_map(F.lit("access_key"), F.col("c_name"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias(
            "options"
        ),
    )
    return paths.redact(table, hashed=True).withColumn("options", F.to_json("options"))


# --- joins and groups --------------------------------------------------------


@query
def group_lookup(spark, sf_dir):
    return grouping.group_lookup(
        _rows(spark, sf_dir), "asset_path", F.count(F.lit(1)).alias("n_files")
    )


def _widened(state: list, frame: int | None) -> list:
    if frame is not None:
        low, high, n, total = state
        state = [min(low, frame), max(high, frame), n + 1, total + frame]
    return state


# Lowest, highest, number and mean (rounded down) of frames as one text.
FRAME_RANGE = Aggregator(
    start=lambda: [10**9, -1, 0, 0],
    add=_widened,
    merge=lambda a, b: [min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], a[3] + b[3]],
    finish=lambda s: f"{s[0]}-{s[1]} {s[2]} {s[3] // s[2]}" if s[2] else "none",
    returns="string",
)


@query
def group_merge(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("asset_path", F.col("file_traits.frame").alias("frame"))
    return group_merge_of(rows, "asset_path", F.col("frame"), FRAME_RANGE, "frames")


@query
def lookup_join(spark, sf_dir):
    rows = materialized(_rows(spark, sf_dir).select("filepath", "asset_path"), "paths")
    return grouping.lookup_join(
        rows, "asset_path", F.count(F.lit(1)).alias("n_files"), "filepath"
    )


@query
def spec_lookup(spark, sf_dir):
    """The registry is the small side: one row per specification."""
    table = files.add_specification(_listing(spark, sf_dir), SPECS)
    return table.select("filepath", "specification").join(
        F.broadcast(spec_table(spark, SPECS)), "specification", "left"
    )


@query
def missing_files(spark, sf_dir):
    table = _listing(spark, sf_dir)
    renamed = F.regexp_replace("filepath", r"\.png$", ".jpg")
    return publish.missing_files(table.select(renamed.alias("filepath")), table)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and coordinates of each order, taken from its listed lines."""
    return fixtures.file_keys(spark, sf_dir).select(
        F.col("ok"),
        F.col("ln"),
        F.array(
            (F.col("ln") % 3).cast("int"), (F.col("pk") % 2).cast("int")
        ).alias("coordinate"),
    )


@query
def missing_coordinates(spark, sf_dir):
    return set_rules.missing_coordinates(_points(spark, sf_dir), ["ok"], "coordinate", 2)


@query
def missing_values(spark, sf_dir):
    return set_rules.missing_values(_points(spark, sf_dir), ["ok"], "ln")


@query
def to_prototype(spark, sf_dir):
    table = _listing(spark, sf_dir)
    lists = grouping.to_prototype(
        table,
        ["ok"],
        "filepath",
        {
            "filenames": F.col("filename"),
            "widths": F.col("width"),
            "odd_lines": F.when(F.col("ln") % 2 == 1, F.col("ln")),
        },
        PART_SIZE,
    )
    return lists.select(
        "ok", "part", *[_text(F.col(c)).alias(c) for c in ("filenames", "widths", "odd_lines")]
    )


@query
def map_prototype(spark, sf_dir):
    table = _listing(spark, sf_dir).select(
        "ok",
        "filepath",
        F.map_filter(
            F.create_map(
                F.lit("width"), F.col("width"), F.lit("line"), F.col("ln"),
                F.lit("part"), F.when(F.col("pk") % 2 == 0, F.col("pk")),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("traits"),
    )
    lists = grouping.map_prototype(table, ["ok"], "filepath", "traits", PART_SIZE)
    return lists.select("ok", "trait", "part", _text(F.col("values")).alias("values"))


@query
def asset_traits(spark, sf_dir):
    rows = materialized(_rows(spark, sf_dir).select("asset_path", "filepath", "file_traits"), "traits")
    lists = publish.asset_lists(rows, PART_SIZE)
    return lists.select(
        "asset_path", "part", F.to_json(F.struct(*publish.TRAIT_LISTS)).alias("asset_traits")
    )


@query
def read_assets(spark, sf_dir):
    return plans.read_assets(_saved_catalog(spark, sf_dir))


@query
def distinct_assets(spark, sf_dir):
    return _rows(spark, sf_dir).select("asset_path").distinct()


@query
def coordinate_bounds(spark, sf_dir):
    return set_rules.bounds_report(_points(spark, sf_dir), ["ok"], "coordinate").select(
        "ok", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z"
    )


@query
def graph_nodes(spark, sf_dir):
    return graph.graph_nodes(_saved_catalog(spark, sf_dir))


@query
def graph_edges(spark, sf_dir):
    return graph.graph_edges(_saved_catalog(spark, sf_dir))


@query
def asset_summary(spark, sf_dir):
    return assets.asset_summary(_rows(spark, sf_dir), SPECS)


# --- scalar functions ---------------------------------------------------------


@query
def error_text(spark, sf_dir):
    part = F.col("p_partkey")
    first = F.when(part % 3 != 0, F.concat(F.lit("bad size "), F.col("p_size")))
    second = F.when(part % 2 == 0, F.concat(F.lit("bad brand "), F.col("p_brand")))
    return fixtures.table(spark, sf_dir, "part").select(
        "p_partkey", paths.error_text("ValidationError", first, second).alias("error")
    )


@query
def str_to_bool(spark, sf_dir):
    part = F.col("p_partkey")
    words = F.array(*[F.lit(w) for w in ("true", "TRUE", "True", "false", "yes", "")])
    text = F.get(words, (part % 6).cast("int"))
    return fixtures.table(spark, sf_dir, "part").select(
        "p_partkey",
        paths.str_to_bool(text).alias("flag"),
        paths.str_to_bool(F.col("p_name")).alias("name_flag"),
    )


@query
def time_string(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "events").select(
        "event_id", paths.time_string(F.col("ts")).alias("time_text")
    )


@query
def coordinate_axes(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "filepath", *paths.coordinate_axes(F.col("n_coordinate"))
    )


# --- rules ---------------------------------------------------------------------


WORDS = "array('pizza', 'master-pizza', 'final', 'last1', 'Kiwi', 'taco_1', 'a-b', '-x', '')"
PROJECTS = "array('proj', 'pr', 'project', 'abcdefghijk', 'Proj', 'pro-j', 'p1x')"
EXTENSIONS = "array('png', 'PNG', 'jpg', 'j-g', 'vdb', '')"

# Query name: value judged on each listed file, and the rule.
EACH_RULES: dict[str, tuple[str, R.Rule]] = {
    "rule_project": (
        f"concat(get({PROJECTS}, pk % 7), if(pk % 11 = 0, '', cast(pk AS string)))",
        R.is_project(),
    ),
    "rule_descriptor": (f"get({WORDS}, pk % 9)", R.is_descriptor()),
    "rule_version": ("int(pk * 2 - 100)", R.is_version()),
    "rule_frame": ("int(pk * 11 - 100)", R.is_frame()),
    "rule_coordinate": (
        """CASE pk % 5 WHEN 0 THEN array(int(pk * 11)) WHEN 1 THEN array(int(ln - 3), 0)
           WHEN 2 THEN array(1, 2, int(pk)) WHEN 3 THEN array(1, 2, 3, 4)
           ELSE cast(array() AS array<int>) END""",
        R.is_coordinate(),
    ),
    "rule_extension": (f"get({EXTENSIONS}, pk % 6)", R.is_extension()),
    "rule_eq": ("width", R.is_eq(4)),
    "rule_lt": ("ln", R.is_lt(5)),
    "rule_gt": ("ln", R.is_gt(2)),
    "rule_lte": ("ln", R.is_lte(5)),
    "rule_gte": ("ln", R.is_gte(2)),
    "rule_in": ("ln", R.is_in([1, 3])),
    "rule_type": ("if(pk % 7 = 0, concat('x', pk), cast(pk AS string))", R.is_int()),
}


def _each(name: str, value: str, rule: R.Rule) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return set_rules.each_report(
            _listing(spark, sf_dir), ["ok"], F.expr(value), "filepath", rule
        )

    run.__name__ = name
    query(run)


for _name, (_value, _rule) in EACH_RULES.items():
    _each(_name, _value, _rule)


@query
def rule_homogenous(spark, sf_dir):
    table = _listing(spark, sf_dir).select("ok", "width")
    return set_rules.homogenous_report(table, ["ok"], "width")


@query
def rule_not_missing(spark, sf_dir):
    return set_rules.not_missing_report(_points(spark, sf_dir), ["ok"], "ln")


@query
def rule_uniform_coordinates(spark, sf_dir):
    return set_rules.uniform_report(_points(spark, sf_dir), ["ok"], "coordinate")


@query
def rule_dense_coordinates(spark, sf_dir):
    return set_rules.dense_report(_points(spark, sf_dir), ["ok"], "coordinate").select(
        "ok", "n_distinct", "volume", "valid"
    )


@query
def rule_begin_at(spark, sf_dir):
    report = set_rules.begin_report(_points(spark, sf_dir), ["ok"], "coordinate", [0, 0])
    return report.withColumn("low", _text(F.col("low")))


def _asset_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.assets_of(_listing(spark, sf_dir).drop("ok", "ln", "pk"), SPECS, ROOT)


@query
def rule_required(spark, sf_dir):
    table = _asset_errors(spark, sf_dir)
    required = F.col("asset_error").contains("This field is required.")
    return table.where(required).select("asset_path", "specification", "n_files")


@query
def rule_rogue(spark, sf_dir):
    table = _asset_errors(spark, sf_dir)
    rogue = F.col("asset_error").contains("Rogue field.")
    return table.where(rogue).select("asset_path", "specification", "n_file_errors")


@query
def validate_assets(spark, sf_dir):
    return _asset_errors(spark, sf_dir)


@query
def validate_sets(spark, sf_dir):
    """As `validate_assets`, by specifications with set rules of all kinds."""
    return plans.assets_of(_listing(spark, sf_dir).drop("ok", "ln", "pk"), SET_SPECS, ROOT)


OWN_SPECS = registry(
    [
        replace(
            LISTING_SPECS["spec001"],
            traits={
                **LISTING_SPECS["spec001"].traits,
                "version": trait(R.is_version(), R.each_python("not_seven", lambda v: v % 7 != 0, "{} is a multiple of seven.")),
                "coordinate": trait(
                    R.each_python("low", lambda c: sum(c) < 3, "{} is too far out."),
                    R.each_set("some", lambda m: m("n_distinct") > 1, lambda m: F.format_string("%d places.", m("n_distinct"))),
                    required=True,
                ),
            },
        ),
        replace(
            LISTING_SPECS["spec002"],
            traits={
                **LISTING_SPECS["spec002"].traits,
                "frame": trait(
                    R.each("below", lambda v: v < 4000, lambda v: F.concat(v.cast("string"), F.lit(" is late."))),
                    required=True,
                ),
            },
        ),
        LISTING_SPECS["vdb001"],
    ]
)


@query
def validate_own(spark, sf_dir):
    """As `validate_assets`, with rules of the user's own: Python predicates, column functions and
    a function of measures."""
    return plans.assets_of(_listing(spark, sf_dir).drop("ok", "ln", "pk"), OWN_SPECS, ROOT)


def _order(path: str) -> int:
    return int(path.split("/o")[1].split("/")[0])


TYPED_SPECS = registry(
    [
        replace(
            LISTING_SPECS["vdb001"],
            traits={
                **LISTING_SPECS["vdb001"].traits,
                "parts": trait(R.each_python("small", lambda v: sum(v) < 7, "{} is too much.")),
                "even": trait(R.is_eq(True)),
                "rest": trait(R.is_gt(2)),
            },
            file_traits={
                "parts": lambda path: [_order(path) % 3, _order(path) % 7],
                "even": lambda path: _order(path) % 2 == 0,
                "rest": lambda path: "none" if _order(path) % 5 == 0 else _order(path) % 10,
            },
            trait_types={"parts": "array<int>", "even": "boolean", "rest": "int"},
        )
    ]
)


@query
def typed_traits(spark, sf_dir):
    """Assets judged by lists, truth values and numbers that user functions read."""
    table = _listing(spark, sf_dir).select("filepath", "filename", "extension")
    return plans.assets_of(traits.read_traits(table, TYPED_SPECS), TYPED_SPECS, ROOT)


@query
def validate_examples(spark, sf_dir):
    """Assets judged by the example specifications as they are shipped."""
    return plans.assets_of(_listing(spark, sf_dir).drop("ok", "ln", "pk"), EXAMPLE_SPECS, ROOT)


@query
def validate_shipped(spark, sf_dir):
    """Assets of the raw specifications as they are shipped; files of `raw009` are taken for theirs."""
    table = _listing(spark, sf_dir).drop("ok", "ln", "pk")
    names = {c: F.replace(F.col(c), F.lit("raw009"), F.lit("raw001")) for c in ("filepath", "filename")}
    return plans.assets_of(table.withColumns(names), SHIPPED_SPECS, ROOT)


@query
def set_summary(spark, sf_dir):
    return assets.asset_summary(materialized(_rows(spark, sf_dir), "files"), SET_SPECS)


@query
def missing_boxes(spark, sf_dir):
    """Absent boxes of a grid of lines by parts, for each supplier."""
    rows = fixtures.table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        (F.col("l_partkey") % 23).cast("int").alias("x"),
        F.col("l_linenumber").alias("y"),
        (F.col("l_orderkey") % 5).cast("int").alias("z"),
    )
    return set_rules.missing_boxes(rows, ["l_suppkey"])


@query
def update(spark, sf_dir):
    table = _catalog(spark, sf_dir)
    return table.withColumn("file_traits", F.to_json("file_traits"))


@query
def catalog_update(spark, sf_dir):
    """The second version of a catalog: files were added, removed and changed."""
    table = _store(spark, sf_dir, BEFORE, AFTER).read()
    return table.withColumn("file_traits", F.to_json("file_traits"))


@query
def catalog_changes(spark, sf_dir):
    """Rows that the second version has otherwise than the first."""
    return _store(spark, sf_dir, BEFORE, AFTER).changes(1, 2)


# --- streams ---------------------------------------------------------------------


STREAM_ROWS = 100_000  # of a file of the stream, about


def _listing_stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The listing as a stream of four batches, of as many files each; a quarter of it comes twice."""
    table = _listing(spark, sf_dir).drop("ok", "ln")
    n = max(1, fixtures.table(spark, sf_dir, "lineitem").count() // (4 * STREAM_ROWS))
    part = F.col("pk") % 4
    for i in range(4):
        # on the key alone, so that a batch lists its own files only
        own = table.where(part.isin([1, 3]) if i == 3 else part == i).drop("pk")
        own = own.withColumn("listed_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
        own.repartition(n).write.mode("append").parquet(f"{folder}/listing")
    return spark.readStream.schema(own.schema).option("maxFilesPerTrigger", n).parquet(f"{folder}/listing")


@query
def stream_update(spark, sf_dir):
    """The catalog after its listing came as a stream, in four batches with repeats."""
    folder = _fresh(spark, "stream")
    store = Store(spark, f"{folder}/store")
    stream = _listing_stream(spark, sf_dir, folder)
    streams.stream_update(stream, store, SPECS, ROOT, f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return store.read().withColumn("file_traits", F.to_json("file_traits"))


@query
def stream_asset_state(spark, sf_dir):
    """Summary of the states of all assets after the stream has ended."""
    folder = _fresh(spark, "stream")
    stream = streams.first_listed(_listing_stream(spark, sf_dir, folder))
    once = stream.writeStream.format("parquet").option("path", f"{folder}/once")
    once = once.option("checkpointLocation", f"{folder}/once-checkpoint").trigger(availableNow=True)
    once.start().awaitTermination()
    again = spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/once")
    states = streams.asset_states(again, SPECS, ROOT)
    streams.follow_assets(states, f"{folder}/states", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    changes = spark.read.parquet(f"{folder}/states")
    return streams.state_summary(streams.latest_states(changes))


# --- search --------------------------------------------------------------------


def _search(name: str, text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plans.search(_data(spark, sf_dir), text)

    run.__name__ = name
    query(run)


for _name, _sql in SEARCHES.items():
    _search(_name, _sql)
_search("search_cte", CTE_SEARCH.format(lead="WITH"))
_search("search_group_concat", GROUP_CONCAT_SEARCH.format(list=SPARK_LIST))
_search("search_recursive", RECURSIVE_SEARCH.format(lead="WITH RECURSIVE"))
