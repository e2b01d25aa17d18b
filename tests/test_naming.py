import pytest
from pyspark.sql import functions as F

from assetry.functions import naming

ALL = ["project", "specification", "descriptor", "version", "coordinate", "frame", "extension"]
FULL = "p-proj001_s-spec002_d-desc_v003_c0004-0005-0006_f0007.jpeg"


def _run(spark, names, fn):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    rows = df.select("i", fn(F.col("name")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def test_parse_all_fields(spark):
    [v] = _run(spark, [FULL], lambda n: naming.parse_name(n, ALL))
    assert v.asDict() == {
        "project": "proj001",
        "specification": "spec002",
        "descriptor": "desc",
        "version": 3,
        "coordinate": [4, 5, 6],
        "frame": 7,
        "extension": "jpeg",
    }


def test_field_order_comes_from_the_fields(spark):
    fields = ["project", "specification", "coordinate", "version"]
    good, bad = _run(
        spark,
        ["p-proj002_s-spec062_c0000-0000-0000_v099", "s-spec062_p-proj002_c0000_v099"],
        lambda n: naming.parse_name(n, fields),
    )
    assert (good.version, good.coordinate) == (99, [0, 0, 0])
    assert bad is None


@pytest.mark.parametrize(
    "name, error",
    [
        (FULL, None),
        ("p-proj002_s-spec062_f-desc_v003_c0004_f0007.png", "Illegal descriptor field indicator"),
        ("pp-proj002_s-spec062_d-desc_v003_c0004_f0007.png", "Illegal project field indicator"),
        ("p-proj002_s-spec062_d-HELLO_v003_c0004_f0007.png", "Illegal descriptor field token"),
        ("p-proj00001_s-spec062_d-desc_v003_c0004_f0007.png", "Expected '_'"),
        ("p-pr001_s-spec062_d-desc_v003_c0004_f0007.png", "Illegal project field token"),
        ("p-abcdefghijk1_s-spec062_d-desc_v003_c0004_f0007.png", "Illegal project field token"),
        ("p-proj_s-spec062_d-desc_v003_c0004_f0007.png", "Illegal project field token"),
        ("p-proj001_s-spec0062_d-desc_v003_c0004_f0007.png", "Expected '_'"),
        ("p-proj001_s-spec062_d-desc_v03_c0004_f0007.png", "Illegal version field token"),
        ("p-proj001_s-spec062_d-desc_v003_c004_f0007.png", "Illegal coordinate field token"),
        ("p-proj001_s-spec062_d-desc_v003_c0004_f007.png", "Illegal frame field token"),
        ("p-proj001_s-spec062_d-desc_v003_c0004_f0007", "Illegal extension field indicator"),
        ("p-proj001_s-spec062_d-desc_v003_c0004_f0007.p$g", "Illegal extension field token"),
        ("p-proj001_s-spec062_d-desc_v003_c0004_f0007.png\n", "Illegal extension field token"),
        ("", "Illegal project field indicator"),
    ],
)
def test_first_failing_part(spark, name, error):
    [value] = _run(spark, [name], lambda n: naming.name_error(n, ALL))
    [parsed] = _run(spark, [name], lambda n: naming.parse_name(n, ALL))
    if error is None:
        assert value is None and parsed is not None
    else:
        assert value.startswith(error) and f'"{name}"' in value and parsed is None


def test_project_digits_and_letters(spark):
    names = ["p-proj1", "p-proj0004", "p-abc1", "p-abcdefghij1", "p-proj00045", "p-pro-j1", "p-proj"]
    values = _run(spark, names, lambda n: naming.parse_name(n, ["project"]))
    assert [v is not None for v in values] == [True] * 4 + [False] * 3


def test_descriptor_may_contain_indicators(spark):
    [v] = _run(spark, ["d-v012-p-banana-f99"], lambda n: naming.parse_name(n, ["descriptor"]))
    assert v.descriptor == "v012-p-banana-f99"


def test_specification_search_takes_the_first_indicator(spark):
    good = ["s-spec001", "s-spec001.png", "p-x_s-spec001_d", "pizzas-spec001", "s-abc123_s-spec001"]
    bad = ["s-spec0012", "spec001", "s-sp001", "s-specs001", "s-spec01", "s-x_s-spec001", "", "s-"]
    values = _run(spark, good + bad, naming.find_specification)
    assert values == ["spec001"] * 4 + ["abc123"] + [None] * len(bad)


def test_extension_only(spark):
    values = _run(spark, ["a.tar.gz", "foo", "a.b-", "a."], naming.parse_extension)
    assert values == ["gz", "foo", None, None]
    values = _run(
        spark, ["a.tar.gz", "foo", "a.b-"],
        lambda n: naming.parse_name(n, ["extension"]).getField("extension"),
    )
    assert values == ["gz", "foo", None]


def test_format_is_the_inverse_of_parse(spark):
    names = [FULL, "p-abc1_s-abc001_d-0-x_v999_c0000_f9999.PNG"]

    def there_and_back(n):
        parsed = naming.parse_name(n, ALL)
        return naming.format_name({f: parsed.getField(f) for f in ALL}, ALL)

    assert _run(spark, names, there_and_back) == names


def test_format_keeps_long_numbers_and_leaves_out_absent_fields(spark):
    df = spark.range(1).select(F.lit(1234).alias("version"), F.lit("x").alias("descriptor"))
    name = naming.format_name(
        {"version": F.col("version"), "descriptor": F.col("descriptor")},
        ["project", "descriptor", "version"],
    )
    assert df.select(name.alias("n")).first().n == "d-x_v1234"


@pytest.mark.parametrize(
    "fields, message",
    [
        ([], "at least one"),
        (["project", "project"], "given twice"),
        (["project", "taco"], "Unknown fields: taco"),
        (["extension", "project"], "at the end"),
    ],
)
def test_illegal_fields(fields, message):
    with pytest.raises(ValueError, match=message):
        naming.check_fields(fields)
