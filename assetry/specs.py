"""Specifications: what an asset's names and traits must look like.

A specification is data: the fields of its file names, the kind of asset, the
rules on each trait, and the functions that read traits from files.  A registry
is a list of specifications; operators compile it into column expressions, so a
registry of any usual size adds no join to a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetry.functions import rules as R
from assetry.functions.naming import check_fields
from assetry.functions.paths import parent_path

ASSET_TYPES = ("file", "sequence", "complex")

BASE_FIELDS = ("project", "specification", "descriptor", "version")
IMAGE_TRAITS = ("width", "height", "channels")


@dataclass(frozen=True)
class Trait:
    """Rules on one trait of a specification."""

    rules: tuple[R.Rule | R.SetRule, ...] = ()
    required: bool = False

    @property
    def each(self) -> tuple[R.Rule, ...]:
        return tuple(r for r in self.rules if isinstance(r, R.Rule))

    @property
    def sets(self) -> tuple[R.SetRule, ...]:
        return tuple(r for r in self.rules if isinstance(r, R.SetRule))


def trait(*rules: R.Rule | R.SetRule, required: bool = False) -> Trait:
    return Trait(tuple(rules), required)


# Rules every specification starts from; its own traits replace them by name.
BASE_TRAITS: dict[str, Trait] = {
    "project": trait(R.is_project()),
    "specification": trait(),
    "descriptor": trait(R.is_descriptor()),
    "version": trait(R.is_version()),
    "extension": trait(R.is_extension(), required=True),
}


@dataclass(frozen=True)
class Spec:
    """A named, versioned rule set.

    ``asset_path`` turns the file path into the path of its asset.  `file`
    assets are the file itself and `sequence` assets its directory; a `complex`
    asset needs ``asset_path`` given.  ``file_traits`` are functions of the path that read
    traits from a file; ``trait_types`` the Spark types of their values (number, truth, list,
    struct), text where none is given.  A value of another type fails its rule.
    """

    name: str
    asset_type: str = "sequence"
    filename_fields: Sequence[str] = BASE_FIELDS + ("extension",)
    asset_name_fields: Sequence[str] = BASE_FIELDS
    traits: Mapping[str, Trait] = field(default_factory=dict)
    file_traits: Mapping[str, Callable[[str], object]] = field(default_factory=dict)
    trait_types: Mapping[str, str] = field(default_factory=dict)
    image_traits: Sequence[str] = ()
    asset_path: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        if self.asset_type not in ASSET_TYPES:
            raise ValueError(f"{self.asset_type} is not one of {list(ASSET_TYPES)}.")
        if self.asset_type == "complex" and self.asset_path is None:
            raise ValueError("A complex specification must define asset_path.")
        check_fields(self.filename_fields)
        check_fields(self.asset_name_fields)

    @property
    def fields(self) -> dict[str, Trait]:
        """All declared traits with their rules."""
        every = {**BASE_TRAITS, **self.traits}
        for name, dtype in self.trait_types.items():
            own = every.get(name, Trait())
            every[name] = Trait((R.reads_as(dtype), *own.rules), own.required)
        return every

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(sorted(n for n, t in self.fields.items() if t.required))

    def path_of_asset(self, filepath: Column) -> Column:
        if self.asset_path is not None:
            return self.asset_path(filepath)
        return filepath if self.asset_type == "file" else parent_path(filepath)


def directory_above(levels: int) -> Callable[[Column], Column]:
    """Asset path of a complex asset: the directory this many levels up."""

    def path(filepath: Column) -> Column:
        for _ in range(levels):
            filepath = parent_path(filepath)
        return filepath

    return path


Registry = Mapping[str, Spec]


def registry(specs: Iterable[Spec]) -> dict[str, Spec]:
    """Index specifications by their lower-case name."""
    table: dict[str, Spec] = {}
    for spec in specs:
        key = spec.name.lower()
        if key in table:
            raise ValueError(f"Specification {key} is registered twice.")
        table[key] = spec
    return table


def by_spec(
    specification: Column,
    specs: Registry,
    make: Callable[[Spec], Column | None],
) -> Column:
    """One column chosen by specification; null for unregistered ones."""
    chosen = None
    for name, spec in specs.items():
        value = make(spec)
        if value is None:
            continue
        test = specification == F.lit(name)
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return F.lit(None) if chosen is None else chosen


def spec_table(spark: SparkSession, specs: Registry) -> DataFrame:
    """The registry as a table, one row per specification."""
    rows = [
        (
            name,
            spec.asset_type,
            "_".join(spec.filename_fields),
            "_".join(spec.asset_name_fields),
            ",".join(spec.required),
        )
        for name, spec in specs.items()
    ]
    return spark.createDataFrame(
        rows,
        "specification string, asset_type string, filename_fields string, "
        "asset_name_fields string, required_traits string",
    )


_WITH_FRAME = BASE_FIELDS + ("frame", "extension")
_WITH_COORDINATE = BASE_FIELDS + ("coordinate", "frame", "extension")


def _raw_traits() -> dict[str, Trait]:
    return {
        "height": trait(required=True),
        "width": trait(required=True),
        "frame": trait(R.is_frame(), required=True),
        "channels": trait(R.is_in([1, 3]), required=True),
        "extension": trait(R.is_extension(), R.is_eq("jpg"), required=True),
    }


RAW001 = Spec(
    "raw001",
    filename_fields=_WITH_FRAME,
    traits=_raw_traits(),
    image_traits=IMAGE_TRAITS,
)
RAW002 = Spec(
    "raw002",
    filename_fields=_WITH_COORDINATE,
    traits={**_raw_traits(), "coordinate": trait(R.is_coordinate(), required=True)},
    image_traits=IMAGE_TRAITS,
)
SPEC001 = Spec(
    "spec001",
    filename_fields=_WITH_COORDINATE,
    traits={
        "descriptor": trait(R.is_descriptor(), R.is_homogenous(), required=True),
        "frame": trait(R.is_frame(), required=True),
        "extension": trait(R.is_extension(), R.is_eq("png"), required=True),
        "coordinate": trait(R.is_coordinate()),
        "height": trait(required=True),
        "width": trait(required=True),
        "channels": trait(required=True),
    },
    image_traits=IMAGE_TRAITS,
)
SPEC002 = Spec(
    "spec002",
    filename_fields=_WITH_FRAME,
    traits={
        "frame": trait(R.is_frame(), R.is_gt(-1), required=True),
        "extension": trait(R.is_extension(), R.is_eq("jpg"), required=True),
        "width": trait(R.is_eq(1024), required=True),
        "height": trait(R.is_eq(1024), required=True),
        "channels": trait(R.is_eq(3), required=True),
    },
    image_traits=IMAGE_TRAITS,
)
VDB001 = Spec(
    "vdb001",
    asset_type="file",
    traits={"extension": trait(R.is_extension(), R.is_eq("vdb"), required=True)},
)

SHIPPED_SPECS = registry([RAW001, RAW002])
EXAMPLE_SPECS = registry([SPEC001, SPEC002, VDB001])


def _small_image_traits(extension: str, **own: Trait) -> dict[str, Trait]:
    return {
        "frame": trait(required=True),
        "extension": trait(R.is_eq(extension), required=True),
        "height": trait(R.is_eq(5), required=True),
        "width": trait(R.is_eq(4), required=True),
        "channels": trait(R.is_eq(3), required=True),
        **own,
    }


# The pair of specifications behind the 27-file test catalog and, with vdb001,
# behind the synthetic listing: images 5 high, 4 wide, 3 channels.
SMALL_SPEC001 = Spec(
    "spec001",
    filename_fields=_WITH_COORDINATE,
    traits=_small_image_traits("png", coordinate=trait(required=True)),
    image_traits=IMAGE_TRAITS,
)
SMALL_SPEC002 = Spec(
    "spec002",
    filename_fields=_WITH_FRAME,
    traits=_small_image_traits("jpg"),
    image_traits=IMAGE_TRAITS,
)
SMALL_SPECS = registry([SMALL_SPEC001, SMALL_SPEC002])
LISTING_SPECS = registry([SMALL_SPEC001, SMALL_SPEC002, VDB001])

# The same with set rules of all kinds.
SET_SPECS = registry(
    [
        replace(
            SMALL_SPEC001,
            traits=_small_image_traits(
                "png",
                coordinate=trait(
                    R.has_uniform_coordinate_count(),
                    R.has_dense_coordinates(),
                    R.coordinates_begin_at([0, 0]),
                    required=True,
                ),
                descriptor=trait(R.is_descriptor(), R.is_homogenous()),
            ),
        ),
        replace(
            SMALL_SPEC002,
            traits={
                **_small_image_traits("jpg", descriptor=trait(R.is_descriptor(), R.is_homogenous())),
                "frame": trait(R.has_no_missing_values(), required=True),
                "width": trait(R.is_eq(4), R.is_homogenous(), required=True),
            },
        ),
        VDB001,
    ]
)
