import itertools
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assetry.functions import rules as R
from assetry.operators import set_rules

POINTS = "g int, c array<int>"


def _passes(spark, rule, values, dtype):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    rows = df.select("i", rule.fails(F.col("v")).alias("bad")).orderBy("i").collect()
    return [not r.bad for r in rows]


@pytest.mark.parametrize(
    "rule, dtype, good, bad",
    [
        (R.is_project(), "string", ["proj001", "abc1"], ["pr1", "proj", "Proj1", "proj00001"]),
        (R.is_descriptor(), "string", ["desc", "a-b"], ["master-desc", "Desc", "", "final", "last1"]),
        (R.is_version(), "int", [1, 999], [-1, 0, 1000]),
        (R.is_frame(), "int", [59, 0, 9999], [-1, 10000]),
        (R.is_coordinate(), "array<int>", [[59], [59, 0], [59, 4, 23]], [[-1], [0, 0, 10000], [], [1, 2, 3, 4]]),
        (R.is_extension(), "string", ["png", "mp4"], ["PNG", "p-g", ""]),
        (R.is_eq(5), "int", [5], [99]),
        (R.is_lt(5), "int", [4], [5]),
        (R.is_gt(5), "int", [6], [5]),
        (R.is_lte(5), "int", [5], [6]),
        (R.is_gte(5), "int", [5], [4]),
        (R.is_in([1, 3]), "int", [1, 3], [2]),
        (R.is_int(), "string", ["1", "-3"], ["x", ""]),
    ],
)
def test_each_rules(spark, rule, dtype, good, bad):
    expected = [True] * len(good) + [False] * len(bad) + [True]  # null is absent
    assert _passes(spark, rule, [*good, *bad, None], dtype) == expected


def test_message_holds_the_first_failing_value(spark):
    df = spark.createDataFrame([("a", "p2", 99), ("a", "p1", 7), ("a", "p3", 5), ("b", "p1", 5)], "g string, p string, v int")
    rows = set_rules.each_report(df, ["g"], F.col("v"), "p", R.is_eq(5)).collect()
    got = {r.g: (r.n_values, r.n_failed, r.first_failure) for r in rows}
    assert got == {"a": (3, 2, "7 != 5."), "b": (1, 0, None)}


def _failing(spark, groups, dtype, rule):
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, f"g int, v {dtype}")
    return {r.g: r.message for r in set_rules.violations(df, ["g"], "v", rule).collect()}


def test_homogenous(spark):
    groups = {1: ["a"], 2: ["a", "a"], 3: ["a", "b"], 4: ["a", None], 5: [None], 6: [None, None]}
    assert set(_failing(spark, groups, "string", R.is_homogenous())) == {3, 4, 6}


def test_not_missing_values(spark):
    groups = {1: [0, 1, 2], 2: [0, 1, 4], 3: [0, 1, 1], 4: [7]}
    texts = _failing(spark, groups, "int", R.has_no_missing_values())
    assert texts == {2: "Missing values: [2, 3].", 3: "Missing values: []."}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v int")
    rows = set_rules.missing_values(df, ["g"], "v").collect()
    assert sorted((r.g, r.v) for r in rows) == [(2, 2), (2, 3)]


GRID = [list(p) for p in itertools.product(range(3), range(3))]


def test_coordinate_rules(spark):
    shifted = [[x + 1, y] for x, y in GRID]
    groups = {
        1: GRID * 3,
        2: (GRID * 3)[:-1],
        3: [p for p in GRID if p != [2, 0]],
        4: [[x + 1, y + 2] for x, y in GRID],
        5: shifted,
    }
    uniform = _failing(spark, groups, "array<int>", R.has_uniform_coordinate_count())
    assert uniform == {2: "Non-uniform coordinate count. Missing coordinates: [[2, 2]]."}
    dense = _failing(spark, groups, "array<int>", R.has_dense_coordinates())
    assert dense == {3: "Non-dense coordinates. Missing coordinates: [[2, 0]]."}
    begin = _failing(spark, groups, "array<int>", R.coordinates_begin_at([1, 2]))
    assert set(begin) == {1, 2, 3, 5}


def test_missing_coordinates_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    groups = defaultdict(list)
    for g in range(40):
        for _ in range(rnd.randint(1, 20)):
            groups[g].append([rnd.randint(0, 3), rnd.randint(-1, 2), rnd.randint(5, 7)])
    df = spark.createDataFrame([(g, c) for g, cs in groups.items() for c in cs], POINTS)
    rows = set_rules.missing_coordinates(df, ["g"], "c", 3).collect()
    got = sorted((r.g, r.x, r.y, r.z) for r in rows)
    want = []
    for g, cs in groups.items():
        axes = [range(min(a), max(a) + 1) for a in zip(*cs)]
        taken = {tuple(c) for c in cs}
        want += [(g, *p) for p in itertools.product(*axes) if p not in taken]
    assert got == sorted(want)
    report = {r.g: r.valid for r in set_rules.dense_report(df, ["g"], "c").collect()}
    assert {g for g, ok in report.items() if not ok} == {w[0] for w in want}
    counts = {g: Counter(map(tuple, cs)) for g, cs in groups.items()}
    uniform = {r.g: r.valid for r in set_rules.uniform_report(df, ["g"], "c").collect()}
    assert uniform == {g: len(set(c.values())) == 1 for g, c in counts.items()}


def test_long_ranges_are_expanded_in_steps(spark):
    df = spark.createDataFrame([(1, 5), (1, 25_003), (2, 0), (2, 2)], "g int, v int")
    rows = set_rules.missing_values(df, ["g"], "v").collect()
    assert sorted((r.g, r.v) for r in rows) == [(1, v) for v in range(6, 25_003)] + [(2, 1)]


def test_text_against_numbers(spark):
    """A value that cannot be read as a number fails and ends nothing."""
    df = spark.createDataFrame([("abc",), ("3",), ("4.5",), (None,)], "v string")
    for rule, want in ((R.is_eq(3), [True, False, True, False]), (R.is_lt(4), [True, False, True, False]),
                       (R.is_in([3, 4.5]), [True, False, False, False]), (R.is_eq("abc"), [False, True, True, False])):
        assert [r[0] for r in df.select(rule.fails(F.col("v"))).collect()] == want


def test_rules_are_told_apart():
    one = R.each("mine", lambda v: v > 1, lambda v: v)
    two = R.each("mine", lambda v: v > 2, lambda v: v)
    assert one != two and R.is_eq(1) != R.is_eq(True) and R.is_project() == R.is_project()


def test_wide_gaps(spark):
    df = spark.createDataFrame([(1, -2), (1, 2147483647), (1, 5)], "k int, v int")
    runs = set_rules.missing_runs(df, ["k"], "v").collect()
    assert sorted((r.first, r.last) for r in runs) == [(-1, 4), (6, 2147483646)]
    assert set_rules.not_missing_report(df, ["k"], "v").first().valid is False


def test_two_far_corners_are_a_handful_of_boxes(spark):
    df = spark.createDataFrame([(1, [0, 0, 0]), (1, [9999, 9999, 9999]), (2, [0, 5]), (2, [3, 5]), (3, [4])], POINTS)
    points = df.select("g", *[set_rules.axis(F.col("c"), i).alias(a) for i, a in enumerate("xyz")])
    boxes = set_rules.missing_boxes(points, ["g"]).collect()
    whole, flat = [b for b in boxes if b.g == 1], [tuple(b) for b in boxes if b.g == 2]
    assert len(whole) == 5 and flat == [(2, 1, 2, 5, 5, None, None)] and len(boxes) == 6
    assert sum((b.x1 - b.x0 + 1) * (b.y1 - b.y0 + 1) * (b.z1 - b.z0 + 1) for b in whole) == 10**12 - 2
    text = _failing(spark, {1: [[0, 0, 0], [9999, 9999, 9999]]}, "array<int>", R.has_dense_coordinates())[1]
    assert text == (
        "Non-dense coordinates. Missing coordinates: [[0, 0, 1..9999], [0, 1..9999, 0..9999], "
        "[1..9998, 0..9999, 0..9999], [9999, 0..9998, 0..9999], [9999, 9999, 0..9998]]."
    )


def test_many_missing_values_are_ranges(spark):
    text = _failing(spark, {1: [0, 3, 1000], 2: list(range(0, 1000, 2))}, "int", R.has_no_missing_values())
    assert text[1] == "Missing values: [1..2, 4..999]."
    assert text[2].startswith("Missing values: [1, 3, 5,") and text[2].endswith(", 199, ...].")


def test_a_set_rule_of_ones_own(spark):
    rule = R.each_set(
        "few", lambda m: m("n_distinct") > 2, lambda m: F.format_string("%d values, up to %d.", m("n_distinct"), m("high"))
    )
    assert _failing(spark, {1: [1, 2], 2: [1, 2, 2, 9]}, "int", rule) == {2: "3 values, up to 9."}
    assert rule != R.each_set("few", lambda m: m("n_distinct") > 3, lambda m: F.lit(""))


def test_whole_numbers_are_compared_exactly(spark):
    big = 1 << 53
    df = spark.createDataFrame([(big,), (big + 1,), (big - 1,), (None,)], "v long")
    cases = {
        R.is_eq(big + 1): [True, False, True, False], R.is_gt(big): [True, False, True, False],
        R.is_lt(big + 1): [False, True, False, False], R.is_lte(big): [False, True, False, False],
        R.is_gte(big + 1): [True, False, True, False], R.is_in([big + 1, 7]): [True, False, True, False],
    }
    for rule, want in cases.items():
        assert [r[0] for r in df.select(rule.fails(F.col("v"))).collect()] == want
        texts = df.select(rule.fails(F.col("v").cast("string"))).collect()
        assert [r[0] for r in texts] == want
    parts = spark.createDataFrame([(4.5,), (4.0,), (float("nan"),)], "v double")
    assert [r[0] for r in parts.select(R.is_gt(4).fails(F.col("v"))).collect()] == [False, True, False]
    assert [r[0] for r in parts.select(R.is_eq(4).fails(F.col("v"))).collect()] == [True, False, True]
    assert [r[0] for r in parts.select(R.is_lte(4).fails(F.col("v"))).collect()] == [True, False, True]


def test_twenty_set_rules_are_two_aggregates(spark, tmp_path):
    from assetry.operators import assets
    from assetry.specs import Spec, registry, trait

    own = [R.each_set(f"rule{i}", lambda m, i=i: m("n_distinct") > i, lambda m: F.lit("many.")) for i in range(16)]
    specs = registry(
        [
            Spec("spec001", traits={"width": trait(*own, R.is_homogenous()), "frame": trait(R.has_no_missing_values())}),
            Spec("spec002", traits={"coordinate": trait(R.has_dense_coordinates(), R.has_uniform_coordinate_count()),
                                    "width": trait(*own[:5], R.is_homogenous())}),
        ]
    )
    rows = spark.createDataFrame(
        [("a", "spec001", 1, 1), ("a", "spec001", 2, 3), ("b", "spec002", 1, 1)],
        "asset_path string, specification string, width int, frame int",
    ).selectExpr(
        "asset_path", "specification",
        "struct(width, frame, array(frame, width) AS coordinate) AS file_traits",
    )
    rows.write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    _, failed, rules = assets.set_failures(files, specs)
    plan = failed._jdf.queryExecution().executedPlan().toString()
    assert len(rules) == 20 and plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2
    got = {(r.asset_path, r.check) for r in failed.collect()}
    names = [(c.trait, c.rule.name) for c in assets.Compiled(specs).checks]
    assert {(a, *names[i]) for a, i in got} == {
        ("a", "frame", "not_missing"), ("a", "width", "homogenous"), ("a", "width", "rule0"), ("a", "width", "rule1"),
        ("b", "width", "rule0"),
    }


def test_python_rules_run_in_one_pass(spark):
    even = R.each_python("even", lambda v: v % 2 == 0, "{} is odd.")
    near = R.each_python("near", lambda c: sum(c) < 5)
    odd = R.each_python("fails", lambda v: 1 // (v - 3) >= 0)
    df = spark.createDataFrame([(1, [1, 2]), (2, [4, 4]), (3, [0]), (None, None)], "v int, c array<int>")
    v, c = F.col("v"), F.col("c")
    table = df.select(even.message(v).alias("a"), near.message(c).alias("b"), odd.fails(v).alias("d"))
    assert [tuple(r) for r in table.collect()] == [
        ("1 is odd.", None, True), (None, "[4, 4] is not valid.", True), ("3 is odd.", None, True), (None, None, False),
    ]
    flags = df.select(even.fails(v), near.fails(c), odd.fails(v))
    plan = flags._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_declared_types_of_user_traits(spark):
    from assetry.operators import assets
    from assetry.specs import Spec, registry

    df = spark.createDataFrame([("[1, 2]", "true", "7"), ("no list", "maybe", "x"), (None, None, None)], "a string, b string, c string")
    typed = df.select(*[R.read_typed(F.col(c), t).alias(c) for c, t in (("a", "array<int>"), ("b", "boolean"), ("c", "int"))])
    assert [tuple(r) for r in typed.collect()] == [([1, 2], True, 7), (None, None, None), (None, None, None)]
    assert [r[0] for r in df.select(R.reads_as("int").message(F.col("c"))).collect()] == [None, "Value 'x' is not int.", None]
    two = [Spec("spec001", trait_types={"t": "int"}), Spec("spec002", trait_types={"t": "boolean"})]
    with pytest.raises(ValueError, match="declared"):
        assets.Compiled(registry(two))
