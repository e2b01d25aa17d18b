"""A saved catalog in versions, updated by the difference of two listings.

Rows lie in hash buckets of their asset (a file without one in that of its path), so an
asset is never spread over buckets.  A version is a small manifest that names, for each
bucket, the segment that holds it.  An update brings the listing into the same buckets, compares
it with the last version, parses what is new or changed, validates again the assets that a change
touches, and writes the buckets of those only; all others stay where they are.  Buckets are
worked on a few at a time, so the whole rows that one job shuffles or keeps besides the result
are of one size (`TURN`), however many rows there are.  The manifest is made last, by
one exclusive create, so readers see the version before or the one after, and of two
updates of one version the later fails.

Old segments are kept as long as versions name them; only an update's own intermediate tables are
deleted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assetry.operators.assets import Compiled, validate_assets
from assetry.operators.files import add_asset_path, add_specification, cleanup, file_rows
from assetry.sources import tables
from assetry.specs import Registry

BUCKETS = 64
STAMP = "listing_stamp"
TURN = 256 << 20  # bytes of files worked on at once, as far as buckets go


class UpdateConflict(RuntimeError):
    """Another update has published the version that this one was to publish."""


def asset_key() -> Column:
    return F.coalesce("asset_path", "filepath")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(asset_key()), F.lit(buckets)).cast("int").alias("bucket")


def fingerprint(specs: Registry, root: str) -> str:
    """Digest of all in a registry that decides about a row, as far as it has a name: rules by name
    and arguments, functions by module and qualified name."""

    def named(f) -> str:
        return f"{getattr(f, '__module__', '')}.{getattr(f, '__qualname__', repr(f))}" if f else ""

    lines = [root]
    for name, s in specs.items():
        lines.append(f"{name} {s.asset_type} {tuple(s.filename_fields)} {tuple(s.asset_name_fields)}")
        lines.append(f"{tuple(s.image_traits)} {named(s.asset_path)} {s.required}")
        lines += [f"{t} {named(f)}" for t, f in sorted(s.file_traits.items())]
    for c in Compiled(specs).checks:
        own = tuple(map(named, c.rule.own)) if getattr(c.rule, "own", ()) else ()
        lines.append(f"{c.trait}:{c.rule.name}:{c.rule.args}:{own}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@dataclass(frozen=True)
class Version:
    """What a manifest holds: segments by bucket, and the rows' schema."""

    number: int
    buckets: int
    segments: dict[int, str]
    schema: str
    fingerprint: str
    batches: dict[str, int]  # last batch merged of each stream

    def text(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @classmethod
    def parse(cls, text: str) -> Version:
        fields = json.loads(text)
        fields["segments"] = {int(k): v for k, v in fields["segments"].items()}
        return cls(**fields)


class Store:
    """Versions of a catalog below a folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/versions/{number:09}.json"

    def versions(self) -> list[int]:
        names = tables.names_in(self.spark, f"{self.folder}/versions")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version | None:
        """A version, by default the last; none where there is none yet."""
        if number is None:
            known = self.versions()
            if not known:
                return None
            number = known[-1]
        return Version.parse(tables.read_text(self.spark, self._manifest(number)))

    def _table(self, v: Version) -> tables.Buckets:
        schema = StructType.fromJson(json.loads(v.schema))
        return tables.Buckets(self.spark, {b: f"{s}/bucket={b}" for b, s in v.segments.items()}, schema)

    def rows(self, v: Version, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of a version with their listing stamp; of some buckets if those are given."""
        return self._table(v).of(buckets)

    def read(self, number: int | None = None) -> DataFrame:
        """The catalog of a version."""
        v = self.version(number)
        if v is None:
            raise RuntimeError("There is no catalog yet: run update first.")
        return self.rows(v).drop(STAMP)

    def update(
        self,
        listing: DataFrame,
        specs: Registry,
        root: str,
        stamp: Sequence[str] = (),
        drop: Sequence[str] = (),
        read: Callable[[DataFrame], DataFrame] | None = None,
        partial: bool = False,
        batch: tuple[str, int] | None = None,
    ) -> Version:
        """Publish the version that a listing makes of the last one.

        A file is as it was if its `stamp` columns (all but the path, if none are given) are
        equal; those in `drop` are no columns of the catalog.  `read` adds traits to the rows of new and changed files; nothing else
        opens a file.  With another registry or root, every file is new.  Where nothing has
        changed, the last version stays.

        A `partial` listing says nothing of files that it does not have.  `batch` is the name of
        a stream and the number of its batch: one that the version has seen changes nothing.
        """
        last, mark = self.version(), fingerprint(specs, root)
        if last and batch and last.batches.get(batch[0], -1) >= batch[1]:
            return last
        if last and partial and last.fingerprint != mark:
            raise ValueError("A part of a listing can't change the registry or the root of a catalog.")
        whole = last is None or last.fingerprint != mark
        n_buckets = last.buckets if last else self.buckets
        segment = f"{self.folder}/segments/{uuid.uuid4()}"
        with tables.Scratch(self.spark, "update") as scratch:
            listed = self._listed(listing, specs, stamp, drop, n_buckets, scratch)
            # of no bucket for a listing without rows, whose version has a schema
            turns = _turns(listed.sizes()) or [[]]
            if whole:
                buckets = None
                for some in turns:
                    here = scratch.before_turn(len(turns))
                    fresh = scratch.table(self._parsed(listed.of(some), specs, root, read), "files")
                    rows = cleanup(validate_assets(fresh, specs)).drop("asset_traits")
                    schema = self._write(rows, segment, n_buckets)
                    del fresh, rows
                    scratch.clear(here)
            else:
                changed, buckets = self._changed(last, listed, partial, scratch)
                if not buckets:
                    return last
                schema = StructType.fromJson(json.loads(last.schema))
                sizes = self._table(last).sizes()
                for b, size in listed.sizes().items():
                    sizes[b] = sizes.get(b, 0) + size
                turns = _turns({b: sizes[b] for b in buckets})
                for some in turns:
                    here = scratch.before_turn(len(turns))
                    rows = self._renewed(self.rows(last, some), listed.of(some), changed, specs, root, read, scratch)
                    schema = self._write(rows, segment, n_buckets)
                    del rows
                    scratch.clear(here)
        return self._commit(last, segment, schema, mark, buckets, batch)

    def _listed(
        self, listing: DataFrame, specs: Registry, stamp: Sequence[str], drop: Sequence[str], n: int, scratch: tables.Scratch
    ) -> tables.Buckets:
        """The listing with its stamps in the buckets that its files will have."""
        columns = listing.columns
        told = [c for c in ("filepath", "filename", "listing_error") if c in columns]
        placed = listing.select(*told, F.struct(*columns).alias("_row"))
        placed = add_asset_path(add_specification(placed, specs), specs)
        placed = placed.select(bucket_of(n), "_row.*")
        # stamps are made after the shuffle
        names = list(stamp) or [c for c in columns if c != "filepath"]
        rows = placed.hint("rebalance", "bucket").withColumn(STAMP, _stamp(names)).drop(*drop)
        rows = rows.sortWithinPartitions("bucket", "filepath")
        path = scratch.path("listing")
        rows.write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        return tables.Buckets(self.spark, tables.buckets_in(self.spark, path), rows.drop("bucket").schema)

    def _changed(
        self, last: Version, listed: tables.Buckets, partial: bool, scratch: tables.Scratch
    ) -> tuple[DataFrame, list[int]]:
        """Paths that are no more as they were: of new, changed or gone files; and the buckets
        of those before and now.

        A path is as it was if it is on both sides with one stamp.  Each row brings its path, 64
        bits of its stamp, and the bit of its bucket.
        """

        def side(rows: DataFrame, bucket: Column, now: bool) -> DataFrame:
            place, one = F.pmod(bucket, F.lit(64)), F.lit(1).cast("long")
            bits = [
                F.when(F.floor(place / 32) == i, F.call_function("shiftleft", one, (place % 32).cast("int")))
                .otherwise(F.lit(0).cast("long"))
                .alias(f"bits_{i}")
                for i in (0, 1)
            ]
            return rows.select("filepath", F.xxhash64(STAMP).alias("stamp"), F.lit(now).alias("now"), *bits)

        before = side(self.rows(last), bucket_of(last.buckets), False)
        now = side(listed.numbered(), F.col("bucket"), True)
        paths = before.unionByName(now).where("filepath IS NOT NULL").groupBy("filepath").agg(
            F.min("stamp").alias("low"), F.max("stamp").alias("high"),
            F.bool_or("now").alias("now"), F.bool_and("now").alias("new"),
            *[F.bit_or(f"bits_{i}").alias(f"bits_{i}") for i in (0, 1)],
        )
        differs = F.col("new") | (F.col("now") & (F.col("low") != F.col("high")))
        if not partial:
            differs = differs | ~F.col("now")
        changed = scratch.table(paths.where(differs).select("filepath", "bits_0", "bits_1"), "changes")
        del paths, before, now
        bits = changed.agg(*[F.bit_or(f"bits_{i}").alias(f"bits_{i}") for i in (0, 1)]).first()
        every = last.segments.keys() | listed.folders.keys()
        at = [b for b in sorted(every) if bits[b % 64 // 32] is not None and bits[b % 64 // 32] >> (b % 32) & 1]
        return changed.select("filepath"), at

    def _renewed(
        self, before: DataFrame, listed: DataFrame, changed: DataFrame, specs: Registry, root: str, read, scratch: tables.Scratch
    ) -> DataFrame:
        """Rows of some buckets as they are now."""
        fresh = scratch.table(self._parsed(listed.join(changed, "filepath", "left_semi"), specs, root, read), "files")
        before = before.withColumn("key", asset_key())
        gone = before.select("filepath", "key").join(changed, "filepath", "left_semi")
        keys = fresh.select(asset_key().alias("key")).unionByName(gone.select("key"))
        touched = scratch.table(keys.where("key IS NOT NULL").distinct(), "touched")
        # a changed path is one of a touched asset, so whole rows are dealt by their assets only
        again = before.join(touched, "key", "left_semi").join(changed, "filepath", "left_anti")
        again = scratch.table(again.select(*fresh.columns), "files")
        rows = cleanup(validate_assets(fresh.unionByName(again), specs)).drop("asset_traits")
        others = before.join(touched, "key", "left_anti").drop("key")
        return rows.unionByName(others)

    def _parsed(self, listing: DataFrame, specs: Registry, root: str, read) -> DataFrame:
        return file_rows(read(listing) if read else listing, specs, root)

    def _write(self, rows: DataFrame, segment: str, n_buckets: int) -> StructType:
        """Add rows to a segment; their schema."""
        columns = rows.columns
        placed = rows.select(bucket_of(n_buckets), *columns)
        tables.write_buckets(placed, segment, ("asset_path", "filepath"))
        return placed.select(*columns).schema

    def _publish(
        self,
        last: Version | None,
        rows: DataFrame,
        mark: str,
        buckets: list[int] | None,
        batch: tuple[str, int] | None = None,
    ) -> Version:
        segment = f"{self.folder}/segments/{uuid.uuid4()}"
        schema = self._write(rows, segment, last.buckets if last else self.buckets)
        return self._commit(last, segment, schema, mark, buckets, batch)

    def _commit(
        self,
        last: Version | None,
        segment: str,
        schema: StructType,
        mark: str,
        buckets: list[int] | None,
        batch: tuple[str, int] | None = None,
    ) -> Version:
        """Make the manifest of the version whose buckets (all, or those given) are in a segment."""
        segments = {b: segment for b in tables.buckets_in(self.spark, segment)}
        if buckets is not None:
            segments |= {b: s for b, s in last.segments.items() if b not in buckets}
        number = last.number + 1 if last else 1
        batches = (last.batches if last else {}) | (dict([batch]) if batch else {})
        n_buckets = last.buckets if last else self.buckets
        v = Version(number, n_buckets, segments, schema.json(), mark, batches)
        if not tables.write_once(self.spark, self._manifest(number), v.text()):
            raise UpdateConflict(f"Version {number} of {self.folder} is already there.")
        return v

    def changes(self, first: int, second: int) -> DataFrame:
        """Rows that differ between two versions: filepath, `change` (added, removed or
        changed), and asset_path, asset_error and asset_valid before and after.  Buckets whose
        segment is the same in both are not read."""
        a, b = self.version(first), self.version(second)
        if a.buckets != b.buckets:
            differ = None
        else:
            every = a.segments.keys() | b.segments.keys()
            differ = [k for k in every if a.segments.get(k) != b.segments.get(k)]
        told = ("asset_path", "asset_error", "asset_valid")

        def side(v: Version, name: str) -> DataFrame:
            rows = self.rows(v, differ).drop(STAMP)
            content = F.to_json(F.struct(*[c for c in rows.columns if c != "filepath"]))
            return rows.select(
                F.col("filepath").alias(f"path_{name}"),
                F.substring(F.unhex(F.sha2(content, 256)), F.lit(1), F.lit(16)).alias(f"content_{name}"),
                *[F.col(c).alias(f"{c}_{name}") for c in told],
            )

        joined = side(a, "before").join(side(b, "after"), F.col("path_before") == F.col("path_after"), "full")
        kind = (
            F.when(F.col("path_before").isNull(), F.lit("added"))
            .when(F.col("path_after").isNull(), F.lit("removed"))
            .otherwise(F.lit("changed"))
        )
        return joined.where(~F.col("content_before").eqNullSafe(F.col("content_after"))).select(
            F.coalesce("path_before", "path_after").alias("filepath"),
            kind.alias("change"),
            *[f"{c}_{side_}" for c in told for side_ in ("before", "after")],
        )


def _stamp(names: Sequence[str]) -> Column:
    """96 bits that tell whether columns are as they were; that of a file that is there is never null."""
    digest = F.unhex(F.sha2(F.to_json(F.struct(*names)), 256))
    return F.base64(F.substring(digest, F.lit(1), F.lit(12)))


def _turns(sizes: dict[int, int]) -> list[list[int]]:
    """Buckets to work on at once: together of `TURN` bytes at most, where one is not larger."""
    turns, total = [], 0
    for b, size in sorted(sizes.items()):
        if not turns or total + size > TURN:
            turns.append([])
            total = 0
        turns[-1].append(b)
        total += size
    return turns
