import os
import uuid

import pytest
from pyspark.sql import functions as F

from assetry.functions import rules as R
from assetry.operators import assets, files, graph, publish
from assetry.plans import catalog as plans
from assetry.sources import listing, traits
from assetry.specs import (
    EXAMPLE_SPECS,
    LISTING_SPECS,
    SHIPPED_SPECS,
    SMALL_SPECS,
    Spec,
    directory_above,
    registry,
    trait,
)
from tests.tree import FILES, make_tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tree") / "ingress")
    make_tree(path)
    return path


@pytest.fixture(scope="module")
def catalog(spark, root):
    table = traits.read_traits(listing.scan_tree(spark, root), SMALL_SPECS)
    return plans.update(table, SMALL_SPECS, root).cache()


def test_every_row_of_the_tree(catalog, root):
    rows = {r.filepath: r for r in catalog.collect()}
    assert len(rows) == len(FILES) == 26
    for folder, name, valid, error in FILES:
        r = rows[os.path.join(root, folder, name)]
        assert r.asset_valid is valid, name
        assert (r.file_error is None) if error is None else (error in r.file_error), name


def test_validity_by_asset(catalog):
    rows = (
        catalog.where("asset_path IS NOT NULL").groupBy("asset_path")
        .agg(F.bool_and("asset_valid").alias("v")).orderBy("asset_path").collect()
    )
    assert [r.v for r in rows] == [True, True, False, True, False]


def test_catalog_columns(catalog):
    assert catalog.columns == [
        "specification", "extension", "filename", "filepath", "file_error", "file_traits",
        "asset_name", "asset_path", "asset_type", "asset_error", "asset_valid",
        "asset_path_relative", "filepath_relative",
    ]


def test_summary_agrees_with_rows(spark, root, catalog):
    table = traits.read_traits(listing.scan_tree(spark, root), SMALL_SPECS)
    rows = files.file_rows(table, SMALL_SPECS, root)
    got = {r.specification: r.asDict() for r in assets.asset_summary(rows, SMALL_SPECS).collect()}
    assert got["spec001"] == {
        "specification": "spec001", "n_assets": 3, "n_valid_assets": 2, "n_files": 14, "n_valid_files": 10,
    }
    assert (got["spec002"]["n_valid_assets"], got["spec002"]["n_valid_files"]) == (1, 5)
    light = assets.add_asset_valid(rows, SMALL_SPECS)
    assert sorted((r.filepath, r.asset_valid) for r in light.collect()) == sorted(
        (r.filepath, r.asset_valid) for r in catalog.collect()
    )


def test_read_by_file(catalog):
    df = plans.read_files(catalog)
    assert df.columns == [
        "project", "specification", "descriptor", "version", "coordinate_x", "coordinate_y",
        "coordinate_z", "frame", "extension", "filename", "filepath", "file_error", "asset_name",
        "asset_path", "asset_type", "asset_error", "asset_valid", "asset_path_relative",
        "channels", "filename_error", "filepath_relative", "height", "width",
    ]
    r = df.where("filename LIKE '%v002_c0001-0001_f0008.png'").first()
    assert (r.version, r.coordinate_x, r.coordinate_y, r.coordinate_z, r.frame) == (2, 1, 1, None, 8)
    assert (r.width, r.height, r.channels) == (4, 5, 3)


def test_read_by_asset(catalog):
    df = plans.read_assets(catalog)
    assert "version" not in df.columns and "specification" not in df.columns
    rows = df.orderBy("asset_path").collect()
    assert len(rows) == 5
    assert rows[2].file_error and rows[2].asset_name.endswith("harbor_v004")


def test_search(catalog):
    df = plans.read_files(catalog)
    query = 'SELECT version, count(*) AS n FROM data WHERE specification == "spec001" GROUP BY version'
    assert {r.version: r.n for r in plans.search(df, query).collect()} == {1: 4, 2: 6, 4: 3, None: 1}
    assert plans.search(df, "-- note\nWITH a AS (SELECT 1 AS x) SELECT * FROM a").count() == 1
    for bad in ("DROP TABLE x", "INSERT INTO x SELECT 1", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a",
                "CREATE TABLE t AS SELECT 1", ""):
        with pytest.raises(ValueError):
            plans.search(df, bad)


def test_cleanup_adds_missing_columns(spark):
    df = spark.createDataFrame([("/a/b", 1, 2)], "filepath string, zeta int, alpha int")
    out = files.cleanup(df)
    assert out.columns == [*files.CATALOG_COLUMNS, "alpha", "zeta"]
    assert out.first().asset_valid is None


def test_graph(spark):
    df = spark.createDataFrame(
        [("/foo/foo.bar", "/foo/foo.bar", True), ("/foo/kiwi.taco", "/foo/kiwi.taco", False)],
        "filepath string, asset_path string, asset_valid boolean",
    )
    nodes = {r.node_id: (r.label, r.color) for r in graph.graph_nodes(df).collect()}
    assert nodes == {
        "root/foo": ("foo", "#B6ECF3"),
        "root/foo/foo.bar": ("foo.bar", "#A0D17B"),
        "root/foo/kiwi.taco": ("kiwi.taco", "#DE958E"),
    }
    edges = {(r.source, r.target) for r in graph.graph_edges(df).collect()}
    assert edges == {("root/foo", "root/foo/foo.bar"), ("root/foo", "root/foo/kiwi.taco")}


def _manifest(spark, names, folder="/in/a", **traits_of):
    rows = [(f"{folder}/{n}", n, n.rsplit(".", 1)[-1]) for n in names]
    df = spark.createDataFrame(rows, "filepath string, filename string, extension string")
    for k, v in traits_of.items():
        df = df.withColumn(k, v)
    return df


def _asset_errors(spark, table, specs, root="/in"):
    rows = plans.update(table, specs, root).collect()
    return {r.filename: (r.asset_error, r.asset_valid) for r in rows}


def test_a_mixed_directory_fails_for_both_specifications(spark):
    folder = "/in/p-proj001_s-spec001_d-pizza_v001"
    names = ["p-proj001_s-spec001_d-pizza_v001_c0000-0001_f0001.png",
             "p-proj001_s-spec002_d-pizza_v001_f0001.jpg"]
    table = _manifest(spark, names, folder, width=F.lit(4), height=F.lit(5), channels=F.lit(3))
    got = _asset_errors(spark, table, SMALL_SPECS)
    assert "extension: Rule eq fails for a file of another specification." in got[names[0]][0]
    assert "coordinate: Rogue field." in got[names[1]][0]
    assert not any(v for _, v in got.values())


def test_missing_and_wrong_traits_are_reported(spark):
    folder = "/in/p-proj001_s-spec002_d-pizza_v001"
    names = [f"p-proj001_s-spec002_d-pizza_v001_f000{i}.jpg" for i in range(3)]
    width = F.when(F.col("filename").contains("f0000"), 4).otherwise(
        F.when(F.col("filename").contains("f0001"), 7).otherwise(9))
    table = _manifest(spark, names, folder, width=width, height=F.lit(5))
    error = _asset_errors(spark, table, SMALL_SPECS)[names[0]][0]
    assert error == "DataError( channels: This field is required. width: 7 != 4. )"


def test_set_rules_of_a_specification(spark):
    spec = Spec(
        "seq001",
        filename_fields=("project", "specification", "descriptor", "version", "frame", "extension"),
        traits={"frame": trait(R.has_no_missing_values(), required=True)},
    )
    specs = registry([spec])
    rows = {}
    for d, frames in (("full", (1, 2, 3)), ("gaps", (1, 4))):
        names = [f"p-proj001_s-seq001_d-{d}_v001_f000{i}.exr" for i in frames]
        rows[d] = _manifest(spark, names, f"/in/p-proj001_s-seq001_d-{d}_v001")
    table = rows["full"].unionByName(rows["gaps"])
    got = plans.update(table, specs, "/in").collect()
    for r in got:
        full = "full" in r.filename
        assert r.asset_valid is full
        assert full or "frame: Missing values: [2, 3]." in r.asset_error
    light = assets.add_asset_valid(files.file_rows(table, specs, "/in"), specs).collect()
    assert {(r.filename, r.asset_valid) for r in light} == {(r.filename, r.asset_valid) for r in got}
    [s] = assets.asset_summary(files.file_rows(table, specs, "/in"), specs).collect()
    assert (s.n_assets, s.n_valid_assets, s.n_files, s.n_valid_files) == (2, 1, 5, 3)


def test_complex_assets_take_their_path_from_the_specification(spark):
    spec = Spec("cpx001", asset_type="complex", asset_path=directory_above(2))
    table = _manifest(spark, ["p-proj001_s-cpx001_d-x_v001.abc"], "/in/p-proj001_s-cpx001_d-x_v001/sub")
    [r] = plans.update(table, registry([spec]), "/in").collect()
    assert (r.asset_path, r.asset_valid) == ("/in/p-proj001_s-cpx001_d-x_v001", True)
    with pytest.raises(ValueError):
        Spec("cpx002", asset_type="complex")


def test_user_traits_become_typed_columns(spark):
    specs = registry([Spec("usr001", asset_type="file", traits={"size": trait(R.is_int())},
                           file_traits={"size": len})])
    table = traits.read_traits(_manifest(spark, ["p-proj001_s-usr001_d-x_v001.abc"]), specs)
    catalog = plans.update(table, specs, "/in")
    r = plans.read_user_traits(catalog, {"size": "int"}).first()
    assert (r.size, r.asset_valid) == (len("/in/a/p-proj001_s-usr001_d-x_v001.abc"), True)


def test_registries():
    assert sorted(SHIPPED_SPECS) == ["raw001", "raw002"]
    assert sorted(EXAMPLE_SPECS) == ["spec001", "spec002", "vdb001"]
    with pytest.raises(ValueError):
        registry([Spec("a"), Spec("A")])


def test_a_hot_asset_and_many_files_without_one(spark):
    """A third of the rows in one asset, a third in none: results are the same
    for any number of partitions."""
    n = 3000
    hot = spark.range(n).select(
        F.format_string("/in/p-proj001_s-spec002_d-hot_v001/p-proj001_s-spec002_d-hot_v001_f%04d.jpg", "id").alias("filepath"))
    cold = spark.range(n).select(
        F.format_string("/in/p-proj%03d_s-spec002_d-x_v001/p-proj%03d_s-spec002_d-x_v001_f0001.jpg", F.col("id") % 999 + 1, F.col("id") % 999 + 1).alias("filepath")).distinct()
    none = spark.range(n).select(F.format_string("/in/misc/%d.txt", "id").alias("filepath"))
    table = listing.with_names(hot.union(cold).union(none)).select(
        "*", F.lit(4).alias("width"), F.lit(5).alias("height"), F.lit(3).alias("channels"))
    results = []
    for parts in (1, 9):
        catalog = plans.update(table.repartition(parts), SMALL_SPECS, "/in")
        counts = catalog.groupBy("asset_valid").count().collect()
        results.append({r.asset_valid: r["count"] for r in counts})
        docs = publish.asset_metadata(catalog, "/out", part_size=1000)
        docs = docs.where("asset_name LIKE '%hot%'").orderBy("part").collect()
        assert [len(d.file_ids) for d in docs] == [1000, 1000, 1000]
        names = [x for d in docs for x in d.filenames]
        assert names == sorted(names) and len(names) == n
        assert [x for d in docs for x in d.asset_traits.frame] == list(range(n))
    assert results[0] == results[1] == {True: n + 999, False: n}


def test_user_traits_keep_to_their_kind(spark, tmp_path):
    """A user function can give an image trait; None is no value."""
    functions = {"width": lambda p: 7, "note": lambda p: None}
    spec = Spec("usr002", asset_type="file", file_traits=functions, traits={"width": trait(R.is_eq(7), required=True), "note": trait(R.is_eq(3))})
    specs = registry([spec])
    table = traits.read_traits(_manifest(spark, ["p-film12_s-usr002_d-x_v001.abc"]), specs)
    row = plans.update(table, specs, "/in").select("file_traits.width", "file_traits.user", "asset_valid").first()
    assert (row.width, row.asset_valid) == (7, True) and "note" not in row.user


def test_documents_do_not_depend_on_their_size(catalog):
    """Put together in order, an asset's parts are the same for any size."""
    whole = publish.asset_metadata(catalog, "/out").collect()
    parts = sorted(publish.asset_metadata(catalog, "/out", part_size=2).collect(), key=lambda r: (r.asset_id, r.part))
    assert len(parts) > len(whole) and all(d.n_parts == 1 for d in whole)
    for d in whole:
        own = [p for p in parts if p.asset_id == d.asset_id]
        assert [p.part for p in own] == list(range(own[0].n_parts))
        for name in ("file_ids", "filenames", "filepaths", "filepaths_relative"):
            assert [x for p in own for x in p[name]] == d[name]
        assert [x for p in own for x in (p.asset_traits.frame or [])] == d.asset_traits.frame
        assert {p.asset_name for p in own} == {d.asset_name}
    keys = publish.object_keys(catalog, "/out", "c", part_size=2).where("kind = 'asset'")
    targets = publish.document_targets(publish.asset_metadata(catalog, "/out", 2), "asset", ["part"], "/out")
    assert {r.source for r in keys.collect()} == {r.target for r in targets.collect()}


def test_ids_of_asset_documents_are_made_after_the_shuffle(spark):
    """Digests cannot be compressed, so rows travel by their paths."""
    rows = [(f"/r/{d}/{d}_f{f:04}.jpg", f"{d}_f{f:04}.jpg", "jpg", 4, 5, 3)
            for d in ("p-proj001_s-spec002_d-a_v001", "p-proj001_s-spec002_d-b_v001") for f in (1, 2, 3)]
    listing = spark.createDataFrame(
        rows, "filepath string, filename string, extension string, width int, height int, channels int"
    )
    docs = publish.asset_metadata(plans.update(listing, LISTING_SPECS, "/r"), "/s", 2)
    names = "spark.sql.debug.maxToStringFields"
    spark.conf.set(names, "1000")
    try:
        tree = docs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.unset(names)
    depth = [len(x) - len(x.lstrip(" :|+-")) for x in tree]
    grouped = [i for i, x in enumerate(tree) if x.lstrip(" :|+-").startswith("Aggregate")]
    for i in grouped:
        below = next((j for j in range(i + 1, len(tree)) if depth[j] <= depth[i]), len(tree))
        assert not any("md5" in x for x in tree[i:below])
    assert grouped
    found = {(r.asset_id, r.part): r.file_ids for r in docs.collect()}
    for d in ("a", "b"):
        asset = f"/r/p-proj001_s-spec002_d-{d}_v001"
        ids = [str(uuid.uuid3(uuid.NAMESPACE_URL, f"{asset}{asset[2:]}_f{f:04}.jpg")) for f in (1, 2, 3)]
        key = str(uuid.uuid3(uuid.NAMESPACE_URL, asset))
        assert found[key, 0] == ids[:2] and found[key, 1] == ids[2:]
