import errno
import hashlib
import json
import os

import pytest

from assetry.operators import publish
from assetry.plans import catalog as plans
from assetry.plans import workflow as w
from assetry.sources import listing, metadata, progress, staging, traits
from assetry.specs import SMALL_SPECS
from assetry.streaming.progress import follow_progress
from tests.tree import FILES, jpeg, make_tree, png

VALID = [os.path.join(d, n) for d, n, ok, _ in FILES if ok]


@pytest.fixture()
def project(spark, tmp_path):
    root = str(tmp_path / "ingress")
    make_tree(root)
    return w.Project(spark, root, str(tmp_path / "staging"), SMALL_SPECS)


def _files(folder):
    found = []
    for top, _, names in os.walk(folder):
        found += [os.path.relpath(os.path.join(top, n), folder) for n in names]
    return sorted(f for f in found if not os.path.basename(f).startswith((".", "_")))


def test_scan_lists_hidden_and_empty_files(spark, tmp_path):
    for name in ("a/.hidden", "a/_under", "a/b/empty.txt", "a/.DS_Store", "top"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    (tmp_path / "void").mkdir()
    for subtrees in (1, 64):
        rows = listing.scan_tree(spark, str(tmp_path), subtrees=subtrees).collect()
        names = sorted(os.path.relpath(r.filepath, tmp_path) for r in rows)
        assert names == ["a/.hidden", "a/_under", "a/b/empty.txt", "top"]
        dirs = listing.scan_tree(spark, str(tmp_path), entry_type="directory", subtrees=subtrees)
        assert sorted(r.filename for r in dirs.collect()) == ["a", "b", "void"]
    every = listing.scan_tree(spark, str(tmp_path), exclude="")
    assert every.count() == 5
    empties = publish.empty_directories(
        dirs.withColumnRenamed("filepath", "directory"), every
    ).collect()
    assert [os.path.basename(r.directory) for r in empties] == ["void"]
    with pytest.raises(ValueError):
        listing.scan_tree(spark, str(tmp_path), entry_type="link")
    with pytest.raises(FileNotFoundError):
        listing.scan_tree(spark, str(tmp_path / "absent"))


def test_unreadable_directories_are_rows(tmp_path, monkeypatch):
    """A forbidden or vanished directory is a row; other errors end the task."""
    for name in ("a/x", "a/b/y", "a/gone/z", "c/w"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    errors, real = {"b": errno.EACCES, "gone": errno.ENOENT}, os.scandir

    def scandir(path):
        code = errors.get(os.path.basename(path))
        if code:
            raise OSError(code, os.strerror(code), path)
        return real(path)

    monkeypatch.setattr(listing.os, "scandir", scandir)
    for subtrees in ("1", "64"):
        reader = listing.TreeReader({"path": str(tmp_path), "subtrees": subtrees})
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        found = {os.path.relpath(r["filepath"], tmp_path): r["listing_error"] for r in rows}
        assert len(rows) == 4 and found == {
            "a/x": None,
            "c/w": None,
            "a/b": "PermissionError( Permission denied )",
            "a/gone": "FileNotFoundError( No such file or directory )",
        }
        for code in (errno.EIO, errno.ESTALE):
            monkeypatch.setitem(errors, "c", code)
            with pytest.raises(OSError):
                [list(reader.read(p)) for p in reader.partitions()]
        monkeypatch.delitem(errors, "c")
    absent = listing.TreeReader({"path": str(tmp_path / "no mount")})
    with pytest.raises(FileNotFoundError):
        list(absent.read(listing.Subtrees((str(tmp_path / "no mount/a"),), True)))


def test_unreadable_directories_in_the_catalog(spark, tmp_path):
    name = "p-proj001_s-spec002_d-x_v001"
    rows = [(f"/r/{name}", name, "", "PermissionError( no )"), (f"/r/{name}/{name}_f0001.jpg", f"{name}_f0001.jpg", "jpg", None)]
    table = spark.createDataFrame(rows, "filepath string, filename string, extension string, listing_error string")
    found = plans.update(traits.read_traits(table, SMALL_SPECS), SMALL_SPECS, "/r").collect()
    by_path = {r.filepath: r for r in found}
    r = by_path[f"/r/{name}"]
    assert len(found) == 2 and r.file_error == "PermissionError( no )"
    assert r.specification is None and r.asset_path is None and r.file_traits is None
    assert not (by_path[f"/r/{name}/{name}_f0001.jpg"].file_error or "").startswith("Perm")
    assert "listing_error" not in r
    with pytest.raises(Exception, match="PermissionError"):
        listing.complete(table).collect()


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([("/a/b.png", 4)], "filepath string, width int").write.parquet(path)
    r = listing.read_manifest(spark, path).first()
    assert (r.filepath, r.filename, r.extension, r.width) == ("/a/b.png", "b.png", "png", 4)


def test_image_headers(spark):
    cases = [
        (png(4, 5), (4, 5, 3, None)),
        (png(400, 300, 0), (400, 300, 1, None)),
        (png(1, 2, 3), (1, 2, 3, None)),
        (png(1, 2, 3, True), (1, 2, 4, None)),
        (png(1, 2, 6), (1, 2, 4, None)),
        (jpeg(640, 480), (640, 480, 3, None)),
        (jpeg(7, 9, 1), (7, 9, 1, None)),
    ]
    bad = [b"", b"\xff\xd8", b"\x89PNG\r\n\x1a\n", b"GIF89a"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([c[0] for c in cases] + bad)], "i int, b binary")
    rows = traits.image_sizes_of(df, "b").orderBy("i").collect()
    for r, (_, want) in zip(rows, cases):
        assert (r.width, r.height, r.channels, r.image_error) == want
    assert all(r.width is None and r.image_error.startswith("ValueError(") for r in rows[len(cases):])


def test_trait_errors_are_data(spark, tmp_path):
    root = str(tmp_path)
    name = "p-proj001_s-spec002_d-x_v001_f0001.jpg"
    (tmp_path / name).write_bytes(b"")
    r = traits.read_traits(listing.scan_tree(spark, root), SMALL_SPECS).first()
    assert r.width is None and "ValueError" in r.trait_errors["width_error"]


def test_create_export_delete(spark, project, tmp_path):
    target = str(tmp_path / "export")
    project.exporters = [w.disk_exporter(target, ["asset", "file"])]
    w.workflow(project, ["delete", "update", "create", "export"])
    assert _files(f"{project.staging}/content") == sorted(VALID)
    assert _files(project.root) == sorted(os.path.join(d, n) for d, n, _, _ in FILES)
    documents = _files(f"{project.staging}/metadata/file")
    assert len(documents) == len(VALID) == 15
    with open(f"{project.staging}/metadata/file/{documents[0]}") as f:
        doc = json.load(f)
    assert list(doc) == list(publish.FILE_DOCUMENT)
    assert os.path.exists(doc["filepath"]) and doc["filepath"].startswith(project.staging)
    names = _files(f"{project.staging}/metadata/asset")
    assert len(names) == 3
    sizes = []
    for n in names:
        with open(f"{project.staging}/metadata/asset/{n}") as f:
            doc = json.load(f)
        assert list(doc) == list(publish.ASSET_DOCUMENT)
        assert all(p.startswith(project.root) for p in doc["filepaths"])
        assert len(doc["asset_traits"]["frame"]) == len(doc["file_ids"])
        sizes.append(len(doc["file_ids"]))
    assert sorted(sizes) == [4, 5, 6]
    for kind, count in (("asset", 3), ("file", 15)):
        chunk = spark.read.text(f"{project.staging}/metadata/{kind}-chunk/*")
        assert chunk.count() == count
    assert _files(f"{target}/content") == sorted(VALID)
    assert len(_files(f"{target}/metadata/asset")) == 3
    assert not os.path.exists(f"{target}/metadata/asset-chunk")
    w.delete(project)
    assert _files(project.staging) == []


def test_export_needs_a_staging_tree(spark, project, tmp_path):
    os.makedirs(f"{project.staging}/content")
    project.exporters = [w.disk_exporter(str(tmp_path / "export"))]
    with pytest.raises(FileNotFoundError, match="metadata/asset"):
        w.export(project)


def test_move_mode_leaves_the_rest(spark, project):
    project.write_mode = "move"
    w.workflow(project, ["update", "create"])
    assert _files(f"{project.staging}/content") == sorted(VALID)
    assert len(_files(project.root)) == 26 - 15


def test_copying_twice_is_harmless(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    source, target = str(tmp_path / "a"), str(tmp_path / "out" / "a")
    plan = spark.createDataFrame([(source, target)], "source string, target string")
    assert [r.status for r in staging.stage_content(plan).collect()] == ["copied"]
    assert [r.status for r in staging.stage_content(plan).collect()] == ["present"]
    assert [r.status for r in staging.stage_content(plan, "move").collect()] == ["moved"]
    assert [r.status for r in staging.stage_content(plan, "move").collect()] == ["present"]
    with pytest.raises(ValueError):
        staging.stage_content(plan, "link")


def test_workflow_rules(project):
    with pytest.raises(ValueError, match="taco"):
        w.workflow(project, ["update", "taco"])
    with pytest.raises(RuntimeError, match="run update first"):
        w.workflow(project, ["create"])
    w.workflow(project, ["delete"])


def test_nothing_valid_writes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "misc.txt").write_text("")
    p = w.Project(spark, str(tmp_path / "in"), str(tmp_path / "out"), SMALL_SPECS)
    w.workflow(p, ["update", "create"])
    assert not (tmp_path / "out").exists()
    assert w.search(p, "SELECT count(*) AS n FROM data").first().n == 1


def test_read_json_with_comments(spark, tmp_path):
    (tmp_path / "good.json").write_text('// note\n{"a": 1 /* one */}')
    (tmp_path / "bad.json").write_text("nothing here")
    rows = metadata.read_json(spark, str(tmp_path), "a int").collect()
    assert sorted((r.a, r._corrupt_record is None) for r in rows if r.a) == [(1, True)]
    assert sum(r._corrupt_record is not None for r in rows) == 1


def _log(folder, name, n):
    with open(os.path.join(folder, f"{name}.json"), "w") as f:
        for i in range(n):
            f.write(json.dumps(dict(name=name, created=float(i), step=i + 1, total=n,
                                    original_message="m", message=f"{name} {i}", progress=(i + 1) / n)) + "\n")


def test_progress(spark, tmp_path):
    folder = str(tmp_path)
    records = spark.createDataFrame([], progress.LOG_SCHEMA)
    assert tuple(progress.current_state(records).first()) == (1.0, "unknown state")
    _log(folder, "a", 3)
    state = progress.current_state(progress.read_progress(spark, folder)).first()
    assert tuple(state) == (1.0, "a 2")
    _log(folder, "b", 2)
    q = follow_progress(spark, folder).writeStream.outputMode("complete").format("memory").queryName("followed").start()
    try:
        q.processAllAvailable()
        rows = spark.table("followed").collect()
    finally:
        q.stop()
    assert {r.name: r.message for r in rows} == {"a": "a 2", "b": "b 1"}


def test_the_export_query_in_a_shared_folder_with_a_scheme(spark, tmp_path, monkeypatch):
    from assetry.plans import queries

    monkeypatch.setattr(queries, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    rows = [(i, f"part {i}", "brand") for i in (1, 3, 4, 12)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = queries.QUERIES["export_disk"](spark, str(tmp_path)).collect()
    # 3 has another extension, and 4 a name that does not parse
    digests = {hashlib.sha256(f"part {i}".encode()).hexdigest() for i in (1, 12)}
    assert len(got) == 2 and {r.sha256 for r in got} == digests
