import uuid

from pyspark.sql import functions as F

from assetry.functions import paths
from assetry.sources.listing import filter_paths, with_names


def test_url_uuid_equals_python(spark):
    texts = ["", "/a/b", "/ingress/proj001/é/x.png", *[f"/f/{i}" for i in range(200)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", paths.url_uuid(F.col("t")).alias("u")).collect():
        assert r.u == str(uuid.uuid3(uuid.NAMESPACE_URL, r.t))


def test_relative_path(spark):
    df = spark.createDataFrame(
        [("/foo/bar/taco.txt",), ("/foo/bar/kiwi.txt",), ("/tmp/pizza.txt",), ("/foo/barn/x",), (None,)],
        "p string",
    )
    for root in ("/foo/bar", "/foo/bar/"):
        rows = df.select(paths.relative_path(F.col("p"), root).alias("r")).collect()
        assert [r.r for r in rows] == ["taco.txt", "kiwi.txt", "/tmp/pizza.txt", "/foo/barn/x", None]


def test_names_and_extensions(spark):
    df = spark.createDataFrame(
        [(p,) for p in ("/a/b.tar.gz", "/a/none", "/a/.profile", "/a/.x.y", "/top.t")], "filepath string"
    )
    rows = with_names(df).collect()
    assert [r.filename for r in rows] == ["b.tar.gz", "none", ".profile", ".x.y", "top.t"]
    assert [r.extension for r in rows] == ["gz", "", "", "y", "t"]


def test_parents_and_ancestors(spark):
    df = spark.createDataFrame([("/a/b/c.x",), ("/a",)], "p string")
    rows = df.select(
        paths.parent_path(F.col("p")).alias("up"), paths.ancestors(F.col("p")).alias("all")
    ).collect()
    assert [(r.up, r.all) for r in rows] == [("/a/b", ["/a", "/a/b"]), ("/", [])]


def test_filters_search_the_full_path(spark):
    df = spark.createDataFrame([("/a/x.png",), ("/b/x.jpg",), ("/b/.DS_Store",)], "filepath string")

    def kept(**kw):
        return sorted(r.filepath for r in filter_paths(df, **kw).collect())

    assert len(kept()) == 3
    assert kept(include="/b/") == ["/b/.DS_Store", "/b/x.jpg"]
    assert kept(exclude=r"\.DS_Store") == ["/a/x.png", "/b/x.jpg"]
    assert kept(include="/b/", exclude="jpg") == ["/b/.DS_Store"]


def test_error_text(spark):
    df = spark.range(1).select(
        paths.error_text("E", F.lit("a")).alias("one"),
        paths.error_text("E", F.lit("a"), F.lit(None).cast("string"), F.lit("b")).alias("two"),
        paths.error_text("E", F.lit(None).cast("string")).alias("none"),
    )
    assert tuple(df.first()) == ("E( a )", "E(\na\nb\n)", None)


def test_redact(spark):
    df = spark.sql(
        "SELECT 'k' AS access_key, 's' AS secret_key, 1 AS plain, "
        "named_struct('root_id', 'r', 'deep', named_struct('api_key', 'a', 'name', 'n')) AS config"
    )
    r = paths.redact(df).first()
    assert (r.access_key, r.secret_key, r.plain) == ("REDACTED", "REDACTED", 1)
    assert r.config.root_id == "REDACTED"
    assert (r.config.deep.api_key, r.config.deep.name) == ("REDACTED", "n")
    assert paths.redact(df, hashed=True).first().access_key.startswith("hash-")


def test_scalars(spark):
    df = spark.sql("SELECT 'TRUE' AS t, 'yes' AS f, timestamp'2024-02-03 04:05:06' AS ts")
    r = df.select(
        paths.str_to_bool(F.col("t")).alias("t"),
        paths.str_to_bool(F.col("f")).alias("f"),
        paths.time_string(F.col("ts")).alias("ts"),
        paths.progress_message(F.lit(1), F.lit(2), F.lit("msg")).alias("m"),
        paths.progress_ratio(F.lit(1), F.lit(0)).alias("p"),
    ).first()
    assert tuple(r) == (True, False, "2024-02-03T-04-05-06", "Progress: 50.00% (1 of 2) - msg", 1.0)


def test_redaction_at_any_depth(spark):
    df = spark.sql(
        "SELECT array(struct('s' AS secret_key, 'a' AS b)) AS list, map('access_key', 'k', 'plain', 'p') AS m, "
        "struct(array(map('x_url', 1, 'y', 2)) AS deep) AS s, map('a', struct('t' AS api_key)) AS n"
    )
    r = paths.redact(df).first()
    hidden = paths.REDACTED
    assert r.list[0].asDict() == {"secret_key": hidden, "b": "a"}
    assert r.m == {"access_key": hidden, "plain": "p"}
    assert r.s.deep == [{"x_url": hidden, "y": "2"}]
    assert r.n == {"a": '{"api_key":"%s"}' % hidden}
    assert paths.redact(df, hashed=True).first().m["access_key"].startswith("hash-")
