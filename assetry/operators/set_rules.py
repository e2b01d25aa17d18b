"""Rules on all values of one asset, as grouped aggregates.

Values are first counted per (group, value), with a map-side combine, so that a
group of any size reaches the second aggregate as its distinct values only.  All set
rules of a registry share these two aggregates: a row's traits are exploded with the
number of their stream, and each rule is judged from the measures of its stream.
The `*_report` functions give the figures behind one verdict for every group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetry.functions.rules import Rule, SetRule


def each_report(
    df: DataFrame, keys: Sequence[str], value: Column, order: str, rule: Rule
) -> DataFrame:
    """Per group: values, failing values, and the text of the first failure."""
    rows = df.select(*keys, order, value.alias("_value"))
    failed = rule.fails(F.col("_value"))
    rows = rows.select(
        *keys,
        order,
        F.when(F.col("_value").isNotNull(), F.lit(1)).alias("_one"),
        F.when(failed, rule.report(F.col("_value"))).alias("_text"),
    )
    return rows.groupBy(*keys).agg(
        F.count("_one").alias("n_values"),
        F.count("_text").alias("n_failed"),
        F.min_by(
            F.col("_text"), F.when(F.col("_text").isNotNull(), F.col(order))
        ).alias("first_failure"),
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Occurrences of each distinct value of each group."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def homogenous_report(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All equal?  Fewer than two values pass; a null among values fails."""
    counts = value_counts(df, keys, value)
    return (
        counts.groupBy(*keys)
        .agg(
            F.sum("n").alias("n_values"),
            F.count(F.lit(1)).alias("n_distinct"),
            F.count_if(F.col(value).isNull()).alias("_nulls"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
        )
        .withColumn(
            "valid",
            (F.col("n_values") < 2)
            | ((F.col("n_distinct") == 1) & (F.col("_nulls") == 0)),
        )
        .drop("_nulls")
    )


def not_missing_report(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Are the values exactly low..high, each once?"""
    counts = value_counts(df, keys, value)
    report = counts.groupBy(*keys).agg(
        F.sum("n").alias("n_values"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )
    span = F.col("high").cast("long") - F.col("low") + 1
    return report.withColumn(
        "valid", (F.col("n_values") == span) & (F.col("n_distinct") == span)
    )


def uniform_report(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Does every distinct coordinate occur equally often?"""
    counts = value_counts(df, keys, value)
    return (
        counts.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_distinct"),
            F.min("n").alias("lowest_count"),
            F.max("n").alias("highest_count"),
        )
        .withColumn("valid", F.col("lowest_count") == F.col("highest_count"))
    )


def axis(coordinate: Column, i: int) -> Column:
    return F.get(coordinate, F.lit(i))


def bounds_report(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Lowest and highest value of each axis."""
    return df.groupBy(*keys).agg(
        *[
            fn(axis(F.col(value), i)).alias(f"{side}_{a}")
            for i, a in enumerate("xyz")
            for fn, side in ((F.min, "min"), (F.max, "max"))
        ]
    )


def dense_report(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Is every point of the bounding box taken?  All points lie in their own
    box, so it is full exactly when their number equals its volume."""
    points = value_counts(df, keys, value)
    report = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_distinct"),
        *[
            fn(axis(F.col(value), i)).alias(f"{side}_{a}")
            for i, a in enumerate("xyz")
            for fn, side in ((F.min, "min"), (F.max, "max"))
        ],
    )
    volume = F.lit(1).cast("long")
    for a in "xyz":
        volume = volume * F.coalesce(
            F.col(f"max_{a}").cast("long") - F.col(f"min_{a}") + 1, F.lit(1)
        )
    return report.withColumn("volume", volume).withColumn(
        "valid", F.col("n_distinct") == F.col("volume")
    )


def begin_report(
    df: DataFrame, keys: Sequence[str], value: str, origin: Sequence[int]
) -> DataFrame:
    """Is the lexicographically lowest coordinate the origin?"""
    at = F.array(*[F.lit(int(o)) for o in origin])
    report = value_counts(df, keys, value).groupBy(*keys).agg(F.min(value).alias("low"))
    return report.withColumn("valid", F.col("low") == at)


# --- all set rules at once -----------------------------------------------------

# What a set rule can ask for, per group and stream.  Numbers are longs; a text that is none
# has no number, and only coordinates are points.
MEASURES = (
    "n_values", "n_nulls", "n_distinct", "lowest_count", "highest_count", "low", "high", "low_text", "high_text",
    "low_point", "high_point", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z", "volume",
)
NAMED = 100  # missing values or points that a message names one by one
_STREAM, _VALUE = "_stream", ("_number", "_text", "_point")


def stream_value(value: Column, kind: str) -> Column:
    """A value of any kind (number, text, point) in one struct type."""
    none = F.lit(None)
    number = value.try_cast("bigint") if kind != "point" else none.cast("bigint")
    text = value.cast("string") if kind == "text" else none.cast("string")
    point = value.cast("array<int>") if kind == "point" else none.cast("array<int>")
    return F.struct(*[v.alias(n) for n, v in zip(_VALUE, (number, text, point))])


def stream_counts(rows: DataFrame, keys: Sequence[str], streams: Mapping[int, tuple[Column, Column]]) -> DataFrame:
    """Occurrences of each distinct value per group and stream, from one pass over the rows.  A
    stream is a condition on the row and a `stream_value`."""
    tagged = [
        F.when(when, F.struct(F.lit(i).alias(_STREAM), *[value[n].alias(n) for n in _VALUE]))
        for i, (when, value) in streams.items()
    ]
    exploded = rows.select(*keys, F.inline(F.array_compact(F.array(*tagged))))
    return exploded.groupBy(*keys, _STREAM, *_VALUE).agg(F.count(F.lit(1)).alias("n"))


def measures(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`MEASURES` per group and stream."""
    point = F.col("_point")
    absent = reduce(and_, (F.col(v).isNull() for v in _VALUE))
    table = counts.groupBy(*keys, _STREAM).agg(
        F.sum("n").alias("n_values"),
        F.sum(F.when(absent, F.col("n")).otherwise(0)).alias("n_nulls"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.min("n").alias("lowest_count"),
        F.max("n").alias("highest_count"),
        F.min("_number").alias("low"),
        F.max("_number").alias("high"),
        F.min("_text").alias("low_text"),
        F.max("_text").alias("high_text"),
        F.min(point).alias("low_point"),
        F.max(point).alias("high_point"),
        *[
            fn(axis(point, i)).alias(f"{side}_{a}")
            for i, a in enumerate("xyz")
            for fn, side in ((F.min, "min"), (F.max, "max"))
        ],
    )
    volume = F.lit(1).cast("long")
    for a in "xyz":
        volume = volume * F.coalesce(F.col(f"max_{a}").cast("long") - F.col(f"min_{a}") + 1, F.lit(1))
    return table.withColumn("volume", volume)


def failures(
    measured: DataFrame, keys: Sequence[str], rules: Sequence[tuple[int, int, SetRule]]
) -> DataFrame:
    """keys, stream, check, `text` and `names` of the rules that fail; rules are (stream,
    check, rule), and a rule's report ends in `text` where `names` is null."""
    found = [
        F.when(
            (F.col(_STREAM) == stream) & F.coalesce(rule.fails(F.col), F.lit(True)),
            F.struct(
                F.lit(check).alias("check"),
                rule.report(F.col).alias("text"),
                F.lit(rule.names).cast("string").alias("names"),
            ),
        )
        for stream, check, rule in rules
    ]
    return measured.select(*keys, _STREAM, "highest_count", F.inline(F.array_compact(F.array(*found))))


def messages(
    counts: DataFrame, failed: DataFrame, keys: Sequence[str], rules: Sequence[tuple[int, int, SetRule]]
) -> DataFrame:
    """keys, check, message of failed rules.  Missing values and points are named, up to `NAMED`
    of them; more, as ranges and boxes of which the first `NAMED` stand in the text.  Read
    only for groups that fail, and by rules that name something."""
    ids = [*keys, _STREAM]
    plain = failed.where("names IS NULL").select(*keys, "check", F.col("text").alias("message"))
    parts = []
    kinds = {r.names for *_, r in rules if r.names}
    for kind in sorted(kinds):
        own = failed.where(F.col("names") == kind)
        groups = own.select(*ids, "highest_count").distinct()
        rows = counts.join(groups, ids)
        if kind == "values":
            runs = missing_runs(rows, ids, "_number")
            pieces = runs.select(*ids, F.struct("first", "last").alias("piece"))
        elif kind == "points":
            axes = {a: axis(F.col("_point"), i) for i, a in enumerate("xyz")}
            points = rows.select(*ids, *[v.alias(a) for a, v in axes.items()])
            boxes = missing_boxes(points, ids)
            pieces = boxes.select(*ids, F.struct(*BOX).alias("piece"))
        else:
            rare = rows.where(F.col("n") < F.col("highest_count"))
            pieces = rare.select(*ids, F.struct(F.col("_point")).alias("piece"))
        place = F.row_number().over(Window.partitionBy(*ids).orderBy("piece"))
        first = pieces.withColumn("_place", place).where(F.col("_place") <= NAMED + 1)
        listed = first.groupBy(*ids).agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
        joined = own.join(listed, ids, "left")
        names = F.coalesce(_named(kind, F.col("pieces")), F.lit("[]"))
        parts.append(joined.select(*keys, "check", F.concat("text", names, F.lit(".")).alias("message")))
    for p in parts:
        plain = plain.unionByName(p)
    return plain


def _named(kind: str, pieces: Column) -> Column:
    """Text of the first pieces: single values or points if they are few, else ranges."""
    if kind == "rare":
        values = F.transform(pieces, lambda p: p["_point"])
        return _listed(F.transform(values, lambda v: v.cast("string")))

    def span(low: Column, high: Column) -> Column:
        return F.when(low == high, low.cast("string")).otherwise(F.concat(low, F.lit(".."), high))

    if kind == "values":
        size = F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["last"] - p["first"] + 1)
        single = F.flatten(F.transform(pieces, lambda p: F.sequence(p["first"], p["last"])))
        ranges = F.transform(pieces, lambda p: span(p["first"], p["last"]))
        return F.when(size <= NAMED, _listed(F.transform(single, lambda v: v.cast("string")))).otherwise(
            _listed(ranges)
        )

    def volume(p: Column) -> Column:
        size = F.lit(1).cast("long")
        for a in "xyz":
            size = size * F.coalesce(p[f"{a}1"] - p[f"{a}0"] + 1, F.lit(1))
        return size

    def points(p: Column) -> Column:
        def along(a: str, made: Column) -> Column:
            values = F.coalesce(F.sequence(p[f"{a}0"], p[f"{a}1"]), F.array().cast("array<bigint>"))
            longer = F.flatten(
                F.transform(made, lambda m: F.transform(values, lambda v: F.concat(m, F.array(v))))
            )
            return F.when(p[f"{a}0"].isNull(), made).otherwise(longer)

        made = F.array(F.array().cast("array<bigint>"))
        for a in "xyz":
            made = along(a, made)
        return made

    size = F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + volume(p))
    single = F.array_sort(F.flatten(F.transform(pieces, points)))
    boxes = F.transform(
        pieces,
        lambda p: F.concat(
            F.lit("["), F.concat_ws(", ", *[span(p[f"{a}0"], p[f"{a}1"]) for a in "xyz"]), F.lit("]")
        ),
    )
    return F.when(size <= NAMED, _listed(F.transform(single, lambda v: v.cast("string")))).otherwise(
        _listed(boxes)
    )


def _listed(texts: Column) -> Column:
    more = F.when(F.size(texts) > NAMED, F.lit(", ...")).otherwise(F.lit(""))
    return F.concat(F.lit("["), F.array_join(F.slice(texts, 1, NAMED), ", "), more, F.lit("]"))


def violations(
    rows: DataFrame, keys: Sequence[str], value: str, rule: SetRule
) -> DataFrame:
    """keys and `message` of the groups that break a set rule; nulls count as values here."""
    dtype = rows.schema[value].dataType.simpleString()
    kind = "point" if dtype.startswith("array") else "text" if dtype == "string" else "number"
    streams = {0: (F.lit(True), stream_value(F.col(value), kind))}
    counts = stream_counts(rows, keys, streams)
    rules = [(0, 0, rule)]
    failed = failures(measures(counts, keys), keys, rules)
    return messages(counts, failed, keys, rules).select(*keys, "message")


RANGE_STEP = 10_000


def expand_range(
    df: DataFrame, keys: Sequence[str], low: str, high: str, name: str
) -> DataFrame:
    """One row per integer from `low` to `high`, in a column `name`.

    A range is first cut into steps, one row each, and the steps are spread over
    the cluster before they are expanded: no task holds a long range.
    """
    start = F.sequence(F.col(low).cast("long"), F.col(high).cast("long"), F.lit(RANGE_STEP))
    steps = df.withColumn("_start", F.explode(start)).repartition(*keys, "_start")
    last = F.least(F.col("_start") + RANGE_STEP - 1, F.col(high).cast("long"))
    dtype = df.schema[low].dataType
    values = steps.withColumn(name, F.explode(F.sequence(F.col("_start"), last)))
    return values.withColumn(name, F.col(name).cast(dtype)).drop("_start")


def missing_runs(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, `first` and `last` of each run of integers absent between two values
    that a group has: one row per gap, however wide."""
    distinct = df.select(*keys, F.col(value).cast("long").alias(value))
    distinct = distinct.where(F.col(value).isNotNull()).distinct()
    following = F.lead(value).over(Window.partitionBy(*keys).orderBy(value))
    return (
        distinct.withColumn("_next", following)
        .where(F.col("_next") > F.col(value) + 1)
        .select(*keys, (F.col(value) + 1).alias("first"), (F.col("_next") - 1).alias("last"))
    )


def missing_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The runs of `missing_runs`, expanded to one row per integer."""
    dtype = df.schema[value].dataType
    wanted = expand_range(missing_runs(df, keys, value), [*keys, "first"], "first", "last", value)
    return wanted.select(*keys, F.col(value).cast(dtype).alias(value))


BOX = ("x0", "x1", "y0", "y1", "z0", "z1")


def missing_boxes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is absent of each group's bounding box, as boxes (`BOX`, ends included): planes
    between the x that occur, lines of an x between its y, and runs of an (x, y) between its z.

    Points have x, y and z, null for axes that a group does not have, whose ends are null in
    the boxes too.  Boxes do not overlap.  Windows run over the distinct values of one axis.
    """
    keys = list(keys)
    points = points.select(*keys, *[F.col(a).cast("long").alias(a) for a in "xyz"])
    bounds = points.groupBy(*keys).agg(
        *[fn(a).alias(f"{a}{i}") for a in "xyz" for i, fn in enumerate((F.min, F.max))]
    )
    tables = []
    for depth, a in enumerate("xyz"):
        line = [*keys, *"xyz"[:depth]]
        distinct = points.select(*line, a).where(F.col(a).isNotNull()).distinct()
        joined = distinct.join(bounds, keys)
        low, high = F.col(f"{a}0"), F.col(f"{a}1")
        along = Window.partitionBy(*line).orderBy(a)
        before = F.coalesce(F.lag(a).over(along), low - 1)
        last = F.lead(a).over(along).isNull()
        gaps = joined.withColumns({"_before": before, "_last": last}).select(
            "*",
            F.inline(
                F.array_compact(
                    F.array(
                        F.when(
                            F.col(a) > F.col("_before") + 1,
                            F.struct((F.col("_before") + 1).alias("_low"), (F.col(a) - 1).alias("_high")),
                        ),
                        F.when(
                            F.col("_last") & (F.col(a) < high),
                            F.struct((F.col(a) + 1).alias("_low"), high.alias("_high")),
                        ),
                    )
                )
            ),
        )
        ends = []
        for i, b in enumerate("xyz"):
            if i < depth:
                ends += [F.col(b).alias(f"{b}0"), F.col(b).alias(f"{b}1")]
            elif i == depth:
                ends += [F.col("_low").alias(f"{b}0"), F.col("_high").alias(f"{b}1")]
            else:
                ends += [F.col(f"{b}0"), F.col(f"{b}1")]
        tables.append(gaps.select(*keys, *ends))
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def missing_coordinates(
    df: DataFrame, keys: Sequence[str], value: str, dims: int
) -> DataFrame:
    """One row per point of a group's bounding box that no coordinate takes.

    The boxes of `missing_boxes` are expanded, an axis at a time, spreading the
    rows over the cluster at each axis so that one large box uses many tasks.
    """
    axes = "xyz"[:dims]
    points = df.select(
        *keys,
        *[
            (axis(F.col(value), i) if i < dims else F.lit(None).cast("int")).alias(a)
            for i, a in enumerate("xyz")
        ],
    )
    wanted = missing_boxes(points.distinct(), keys)
    for i, a in enumerate(axes):
        wanted = expand_range(wanted, [*keys, *axes[:i]], f"{a}0", f"{a}1", a)
    return wanted.select(*keys, *[F.col(a).cast("int").alias(a) for a in axes])
