"""Versions of a saved catalog."""

import os

import pytest
from pyspark.sql import functions as F

from assetry.operators import assets as operators
from assetry.operators import files
from assetry.plans import catalog as plans
from assetry.plans import workflow as w
from assetry.plans.store import Store, UpdateConflict, fingerprint
from assetry.sources import tables
from assetry.specs import LISTING_SPECS, SMALL_SPECS
from assetry.streaming import catalog as streams
from tests.tree import make_tree


def assets(*frames):
    return [(f"p-proj001_s-spec002_d-{c}_v001", f) for c in "abcdefgh" for f in frames]


def named(spark, names, width=4):
    """Files of directories that are called as their assets must be."""
    rows = [(f"/r/{d}/{d}_f{f:04}.jpg", f"{d}_f{f:04}.jpg", "jpg", width, 5, 3) for d, f in names]
    return spark.createDataFrame(
        rows, "filepath string, filename string, extension string, width int, height int, channels int"
    )


def content(df):
    return sorted(map(str, df.withColumn("file_traits", F.to_json("file_traits")).collect()))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=16)


def test_an_update_equals_a_whole_one(spark, store):
    first = named(spark, assets(1, 2, 3))
    assert store.update(first, LISTING_SPECS, "/r").number == 1
    assert content(store.read()) == content(plans.update(first, LISTING_SPECS, "/r"))
    # one asset gains a bad file, one loses a file, one has a file changed
    gone = F.col("filepath").contains("d-b_") & F.col("filepath").contains("f0002")
    wide = F.col("filepath").contains("d-c_") & F.col("filepath").contains("f0003")
    second = (
        first.where(~gone)
        .withColumn("width", F.when(wide, 9).otherwise(F.col("width")))
        .unionByName(named(spark, [("p-proj001_s-spec002_d-a_v001", 4)], width=7))
    )
    before = store.version()
    after = store.update(second, LISTING_SPECS, "/r")
    assert after.number == 2
    assert content(store.read()) == content(plans.update(second, LISTING_SPECS, "/r"))
    assert content(store.read(1)) == content(plans.update(first, LISTING_SPECS, "/r"))
    # buckets of the other assets stay where they are
    moved = {b for b in before.segments if before.segments[b] != after.segments.get(b)}
    assert 1 <= len(moved) <= 3 < len(before.segments)
    changes = {(r.filepath.rsplit("/")[-1][20:], r.change) for r in store.changes(1, 2).collect()}
    assert changes == {
        ("d-a_v001_f0001.jpg", "changed"), ("d-a_v001_f0002.jpg", "changed"), ("d-a_v001_f0003.jpg", "changed"),
        ("d-a_v001_f0004.jpg", "added"), ("d-b_v001_f0002.jpg", "removed"), ("d-c_v001_f0001.jpg", "changed"),
        ("d-c_v001_f0002.jpg", "changed"), ("d-c_v001_f0003.jpg", "changed"),
    }


def test_buckets_are_worked_on_in_turns(spark, store, monkeypatch):
    """One bucket at a time if need be, with the same rows, and nothing is left but the versions."""
    from assetry.plans import store as stores

    calls = []
    real = stores.validate_assets
    monkeypatch.setattr(stores, "TURN", 1, raising=False)
    monkeypatch.setattr(stores, "validate_assets", lambda *a: calls.append(1) or real(*a))
    kept = set(os.listdir(tables.shared_folder(spark)))
    first = named(spark, assets(1, 2, 3)).unionByName(named(spark, [("misc", 1)]))
    store.update(first, LISTING_SPECS, "/r")
    assert len(calls) == len(store.version().segments) > 3
    assert content(store.read()) == content(plans.update(first, LISTING_SPECS, "/r"))
    kept |= {n for n in os.listdir(tables.shared_folder(spark)) if n.startswith("files-")}  # of plans.update
    del calls[:]
    gone = F.col("filepath").rlike("d-[a-e]_.*f0002")
    second = first.where(~gone).unionByName(named(spark, [("p-proj001_s-spec002_d-z_v001", 4)], width=7))
    before = store.version()
    after = store.update(second, LISTING_SPECS, "/r")
    moved = {b for b in before.segments.keys() | after.segments.keys() if before.segments.get(b) != after.segments.get(b)}
    assert len(calls) == len(moved) > 2
    assert set(os.listdir(tables.shared_folder(spark))) == kept
    assert content(store.read()) == content(plans.update(second, LISTING_SPECS, "/r"))


def test_a_listing_is_read_once(spark, store):
    """A batch of a stream would run its query again each time."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    for n in (2, 3):
        table = named(spark, assets(*range(n)))
        before = seen.value
        store.update(table.mapInArrow(counted, table.schema), LISTING_SPECS, "/r")
        assert seen.value - before == 8 * n
    assert store.read().count() == 24


def test_the_listing_streams_in_four_batches_of_several_files(spark, tmp_path, monkeypatch):
    from assetry.plans import queries

    monkeypatch.setattr(queries, "STREAM_ROWS", 50, raising=False)
    rows = [(i // 5, i * 7 % 997, i % 5) for i in range(1000)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    stream = queries._listing_stream(spark, str(tmp_path), f"{tmp_path}/s")
    names = sorted((tmp_path / "s" / "listing").glob("part-*"), key=os.path.getmtime)
    assert len(names) == 20  # of 1000 / (4 * 50) files each
    listed = queries._listing(spark, str(tmp_path)).drop("ok", "ln")
    for i in range(4):
        parts = [1, 3] if i == 3 else [i]
        want = listed.where((F.col("pk") % 4).isin(parts)).drop("pk")
        batch = spark.read.parquet(*map(str, names[5 * i : 5 * i + 5]))
        assert batch.columns == stream.columns
        assert sorted(map(str, batch.drop("listed_at").collect())) == sorted(map(str, want.collect()))


def test_rows_without_a_path_and_paths_that_come_twice(spark, store):
    """Of a path in two buckets both rows are renewed where one differs; rows without a path stay."""
    rows = [
        ("/r/x/a.jpg", "p-proj001_s-spec002_d-a_v001_f0001.jpg", 4), ("/r/x/a.jpg", "p-proj001_s-vdb001_d-a_v001.vdb", 4),
        ("/r/x/b.jpg", "b.jpg", 4), ("/r/x/b.jpg", "b.jpg", 4), (None, None, 4), (None, "c.jpg", 4),
    ]
    table = spark.createDataFrame(rows, "filepath string, filename string, width int")
    table = table.selectExpr("*", "'jpg' AS extension", "5 AS height", "3 AS channels")
    store.update(table, LISTING_SPECS, "/r")
    assert content(store.read()) == content(plans.update(table, LISTING_SPECS, "/r"))
    wide = F.when(F.col("filename").contains("vdb001"), 9).otherwise(F.col("width"))
    second = table.where("filepath IS NOT NULL").withColumn("width", wide)
    store.update(second, LISTING_SPECS, "/r")
    without = [x for x in content(store.read(1)) if "filepath=None" in x]
    assert len(without) == 2
    assert content(store.read()) == sorted(content(plans.update(second, LISTING_SPECS, "/r")) + without)


def test_nothing_new_is_no_version(spark, store):
    table = named(spark, assets(1, 2))
    store.update(table, LISTING_SPECS, "/r")
    assert store.update(table.repartition(5), LISTING_SPECS, "/r").number == 1
    assert store.versions() == [1]


def test_everything_gone_and_back(spark, store):
    table = named(spark, assets(1))
    store.update(table, LISTING_SPECS, "/r")
    assert store.update(table.limit(0), LISTING_SPECS, "/r").segments == {}
    assert store.read().count() == 0 and store.read().columns == store.read(1).columns
    store.update(table, LISTING_SPECS, "/r")
    assert content(store.read(3)) == content(store.read(1))


def test_another_registry_makes_all_files_new(spark, store):
    table = named(spark, assets(1))
    store.update(table, LISTING_SPECS, "/r")
    assert fingerprint(LISTING_SPECS, "/r") != fingerprint(SMALL_SPECS, "/r")
    store.update(table, SMALL_SPECS, "/r")
    assert content(store.read(2)) == content(plans.update(table, SMALL_SPECS, "/r"))


def test_of_two_updates_of_a_version_one_fails(spark, store):
    table = named(spark, assets(1, 2))
    last = store.update(table, LISTING_SPECS, "/r")
    store.update(table.where("NOT filepath LIKE '%d-a%'"), LISTING_SPECS, "/r")
    rows = plans.update(table, LISTING_SPECS, "/r").withColumn("listing_stamp", F.lit("x"))
    with pytest.raises(UpdateConflict):
        store._publish(last, rows, last.fingerprint, None)
    assert store.versions() == [1, 2] and store.read().count() == 14


def test_only_changed_files_are_read(spark, tmp_path):
    root = tmp_path / "in"
    make_tree(root)
    project = w.Project(spark, str(root), str(tmp_path / "out"), SMALL_SPECS, store=f"file://{tmp_path}/kept")
    w.update(project)
    before = content(project.catalog)
    again = w.Project(spark, str(root), str(tmp_path / "out"), SMALL_SPECS, store=f"file://{tmp_path}/kept")
    assert w.read(again).count() == len(before)
    # what is as it was keeps its traits, even if it could not be read now
    images = sorted(p for p in root.rglob("*.png"))
    facts = images[0].stat()
    data = images[0].read_bytes()
    images[0].write_bytes(b"x" * len(data))
    os.utime(images[0], ns=(facts.st_atime_ns, facts.st_mtime_ns))
    w.update(again)
    assert content(again.catalog) == before and again.versions().versions() == [1]
    images[0].write_bytes(b"not an image")
    w.update(again)
    assert again.versions().versions() == [1, 2] and content(again.catalog) != before


def test_no_catalog_yet(spark, store):
    with pytest.raises(RuntimeError, match="no catalog"):
        store.read()


class _Local:
    """A session without the setting."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        master, applicationId = "local[2]", "app-without-folder"


def test_a_local_session_without_a_shared_folder_gets_one():
    folder = tables.shared_folder(_Local)
    assert folder == tables.shared_folder(_Local) and folder.startswith("/")
    _Local.sparkContext.master = "spark://somewhere"
    with pytest.raises(ValueError, match="shared folder"):
        tables.shared_folder(_Local)


def _stream(spark, folder, tables):
    for t in tables:
        t.withColumn("listed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_stream_of_listings_is_merged(spark, store, tmp_path):
    first, more = named(spark, assets(1, 2)), named(spark, assets(3))
    stream = _stream(spark, str(tmp_path / "in"), [first, more])

    def run():
        query = streams.stream_update(
            stream, store, LISTING_SPECS, "/r", str(tmp_path / "checkpoint"), availableNow=True
        )
        query.awaitTermination()

    run()
    whole = first.unionByName(more)
    assert content(store.read()) == content(plans.update(whole, LISTING_SPECS, "/r"))
    assert store.version().batches["listing"] >= 1
    # restarted from its checkpoint: a changed file and one more
    wide = named(spark, [("p-proj001_s-spec002_d-a_v001", 1)], width=9)
    new = named(spark, [("p-proj001_s-spec002_d-z_v001", 1)])
    _stream(spark, str(tmp_path / "in"), [wide.unionByName(new)])
    run()
    left = whole.where("NOT filepath LIKE '%d-a_v001_f0001.jpg'")
    assert content(store.read()) == content(plans.update(left.unionByName(wide).unionByName(new), LISTING_SPECS, "/r"))
    # a batch that is known changes nothing
    versions = store.versions()
    number = store.version().batches["listing"]
    store.update(named(spark, assets(7)), LISTING_SPECS, "/r", partial=True, batch=("listing", number))
    assert store.versions() == versions
    with pytest.raises(ValueError):
        store.update(first, SMALL_SPECS, "/r", partial=True)


def test_states_of_assets_survive_a_restart(spark, tmp_path):
    folder, states_at = str(tmp_path / "in"), str(tmp_path / "states")
    first, more = named(spark, assets(1, 2)), named(spark, assets(3), width=8)
    stream = _stream(spark, folder, [first])

    def run():
        states = streams.asset_states(stream, LISTING_SPECS, "/r")
        streams.follow_assets(states, states_at, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
        return streams.state_summary(streams.latest_states(spark.read.parquet(states_at))).collect()

    def want(table):
        return operators.asset_summary(files.file_rows(table, LISTING_SPECS, "/r"), LISTING_SPECS).collect()

    assert run() == want(first)
    _stream(spark, folder, [more])
    assert run() == want(first.unionByName(more))
