"""Asset validation: all rules of all specifications in one grouped aggregate.

A trait that is present, and a rule that fails, each own one bit.  Every file
row sets its bits, and an asset is the OR of its files: one hash aggregate on
fixed-width columns with a map-side combine, so a huge asset costs no more than
a small one.  A specification is then a pair of masks: traits it requires, and
traits it knows; any other trait present is a rogue one.  Message texts are made
afterwards, from failing rows only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetry.functions import naming
from assetry.functions.rules import Rule, SetRule, read_typed
from assetry.operators import set_rules
from assetry.specs import IMAGE_TRAITS, Registry, by_spec

BITS = 62  # per long, sign bit left alone


def trait_value(name: str, types: Mapping[str, str] | None = None) -> Column:
    """A trait of a file row as a typed column; a user trait is text unless `types` has it."""
    traits = F.col("file_traits")
    if name in naming.FIELDS or name in IMAGE_TRAITS or name == "filename_error":
        return traits.getField(name)
    text = F.try_element_at(traits.getField("user"), F.lit(name))
    return read_typed(text, types[name]) if types and name in types else text


@dataclass(frozen=True)
class Check:
    """One (trait, rule) pair; shared by every specification that declares it."""

    trait: str
    rule: Rule | SetRule

    @property
    def key(self) -> str:
        rule = self.rule
        more = (rule.kinds, rule.own) if isinstance(rule, Rule) else rule.own
        return f"{self.trait}:{rule.name}:{rule.args}:{more}"


class Compiled:
    """Bit numbers of the traits and rules of a registry."""

    def __init__(self, specs: Registry):
        self.specs = specs
        user = {t for s in specs.values() for t in s.file_traits}
        read = user | {t for s in specs.values() for t in s.image_traits}
        declared = {t for s in specs.values() for t in s.fields}
        self.errors = tuple(f"{t}_error" for t in sorted(read))
        self.traits = (
            *naming.FIELDS,
            *IMAGE_TRAITS,
            "filename_error",
            *sorted((user | declared) - {*naming.FIELDS, *IMAGE_TRAITS}),
            *self.errors,
        )
        checks = dict.fromkeys(
            Check(t, r)
            for s in specs.values()
            for t, trait in s.fields.items()
            for r in trait.rules
        )
        self.checks = tuple(checks)
        self.spec_names = tuple(specs)
        self.types: dict[str, str] = {}
        for s in specs.values():
            for t, dtype in s.trait_types.items():
                if self.types.setdefault(t, dtype) != dtype:
                    raise ValueError(f"Trait {t} is declared as {self.types[t]} and as {dtype}.")

    def presence(self) -> list[Column]:
        """Per trait: is it present on this row?"""
        errors = F.col("file_traits.errors")
        return [
            F.try_element_at(errors, F.lit(t)).isNotNull()
            if t in self.errors
            else trait_value(t).isNotNull()
            for t in self.traits
        ]

    def value(self, check: Check) -> Column:
        """What a check judges on a row."""
        raw = isinstance(check.rule, Rule) and check.rule.raw
        return trait_value(check.trait, None if raw else self.types)

    def failures(self) -> list[Column]:
        """Per check: does this row fail it?  Set rules never fail on a row."""
        return [
            c.rule.fails(self.value(c)) if isinstance(c.rule, Rule) else F.lit(False)
            for c in self.checks
        ]

    def check_bits(self, spec: str) -> list[int]:
        fields = self.specs[spec].fields
        return [
            i
            for i, c in enumerate(self.checks)
            if c.trait in fields and c.rule in fields[c.trait].rules
        ]

    def known_bits(self, spec: str) -> list[int]:
        return [i for i, t in enumerate(self.traits) if t in self.specs[spec].fields]

    def required_bits(self, spec: str) -> list[int]:
        return [i for i, t in enumerate(self.traits) if t in self.specs[spec].required]


def pack_bits(flags: Sequence[Column], prefix: str) -> list[Column]:
    """Booleans as bits of as many long columns as they need."""
    words = []
    for start in range(0, len(flags), BITS):
        word = F.lit(0).cast("long")
        for i, flag in enumerate(flags[start : start + BITS]):
            word = word.bitwiseOR(
                F.when(flag, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
            )
        words.append(word.alias(f"{prefix}_{start // BITS}"))
    return words


def _words(flags: Sequence, prefix: str) -> list[str]:
    return [f"{prefix}_{i}" for i in range((len(flags) + BITS - 1) // BITS)]


def _word_of(bits: Sequence[int], word: int) -> int:
    """Mask of the bits that fall into a word."""
    return sum(1 << (b - word * BITS) for b in bits if b // BITS == word)


def _names(words: Sequence[Column], names: Sequence[str]) -> Column:
    """Array of the names whose bits are on."""

    def chosen(word: Column, chunk: Sequence[str]) -> Column:
        return F.filter(
            F.split(F.lit("/".join(chunk)), "/"),
            lambda _, i: F.getbit(word, i) != 0,
        )

    parts = [
        chosen(word, names[w * BITS : (w + 1) * BITS]) for w, word in enumerate(words)
    ]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def asset_bits(files: DataFrame, specs: Registry) -> DataFrame:
    """One row per asset: `n_files`, `n_file_errors` and the packed traits,
    failures and specifications of its files.

    Files without an asset combine into one row per task before the shuffle;
    that row has no specification and is dropped after it.  (A filter in front
    would be pushed through the name parsing and run it twice.)
    """
    c = Compiled(specs)
    of_spec = [F.col("specification") == s for s in c.spec_names]
    words = (
        _words(c.traits, "has") + _words(c.checks, "fails") + _words(of_spec, "spec")
    )
    any_spec = F.lit(False)
    for w in _words(of_spec, "spec"):
        any_spec = any_spec | (F.col(w) != 0)
    return (
        files.select(
            "asset_path",
            F.col("file_error").isNotNull().cast("long").alias("_error"),
            *pack_bits(c.presence(), "has"),
            *pack_bits(c.failures(), "fails"),
            *pack_bits(of_spec, "spec"),
        )
        .groupBy("asset_path")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum("_error").alias("n_file_errors"),
            *[F.bit_or(w).alias(w) for w in words],
        )
        .where(any_spec)
    )


def row_messages(files: DataFrame, specs: Registry) -> DataFrame:
    """asset_path, check, message: first failure of each rule in each asset, by
    file path.  Reads only the rows that fail a rule of their own specification."""
    c = Compiled(specs)
    found, any_fails = [], F.lit(False)
    for i, check in enumerate(c.checks):
        if not isinstance(check.rule, Rule):
            continue
        owners = [s for s in c.spec_names if i in c.check_bits(s)]
        value = c.value(check)
        fails = F.col("specification").isin(owners) & check.rule.fails(value)
        any_fails = any_fails | fails
        found.append(
            F.when(
                fails,
                F.struct(
                    F.lit(i).alias("check"),
                    check.rule.report(value).alias("message"),
                ),
            )
        )
    return (
        files.where(any_fails)
        .select(
            "asset_path",
            "filepath",
            F.explode_outer(F.array_compact(F.array(*found))).alias("f"),
        )
        .where(F.col("f").isNotNull())
        .groupBy("asset_path", F.col("f.check").alias("check"))
        .agg(F.min_by(F.col("f.message"), F.col("filepath")).alias("message"))
    )


def _set_streams(c: Compiled) -> tuple[dict, list]:
    """Streams (condition, value) and set rules (stream, check, rule): traits with the same
    owners share one."""
    numbers: dict[tuple, int] = {}
    streams, rules = {}, []
    for i, check in enumerate(c.checks):
        if isinstance(check.rule, Rule):
            continue
        owners = tuple(s for s in c.spec_names if i in c.check_bits(s))
        key = (check.trait, owners)
        if key not in numbers:
            numbers[key] = len(numbers)
            value = c.value(check)
            if check.trait == "coordinate" or c.types.get(check.trait, "") == "array<int>":
                kind = "point"
            else:
                whole = check.trait in (*IMAGE_TRAITS, "version", "frame")
                kind = "number" if whole or c.types.get(check.trait) in ("int", "bigint") else "text"
            streams[numbers[key]] = (
                F.col("specification").isin(list(owners)) & value.isNotNull(),
                set_rules.stream_value(value, kind),
            )
        rules.append((numbers[key], i, check.rule))
    return streams, rules


def set_failures(files: DataFrame, specs: Registry) -> tuple[DataFrame, DataFrame, list] | None:
    """Value counts, failed set rules (asset_path, check, ...) and the rules: one scan of the
    files and two aggregates, however many rules there are."""
    streams, rules = _set_streams(Compiled(specs))
    if not rules:
        return None
    counts = set_rules.stream_counts(files, ["asset_path"], streams)
    measured = set_rules.measures(counts, ["asset_path"])
    return counts, set_rules.failures(measured, ["asset_path"], rules), rules


def set_messages(files: DataFrame, specs: Registry) -> DataFrame | None:
    """asset_path, check, message for the set rules of the registry."""
    found = set_failures(files, specs)
    if found is None:
        return None
    counts, failed, rules = found
    return set_rules.messages(counts, failed, ["asset_path"], rules)


def findings(bits: DataFrame, c: Compiled) -> DataFrame:
    """Asset bits to one row per asset and specification (an asset has more than
    one only if its directory mixes them), with three packed sets: `missing`
    required traits, `rogue` traits, and `failed` checks."""
    present = _names([F.col(w) for w in _words(c.spec_names, "spec")], c.spec_names)
    rows = bits.withColumn("specification", F.explode(present))

    def mask(bits_of, word: int, extra: int = 0) -> Column:
        values = {s: _word_of(bits_of(s), word) ^ extra for s in c.spec_names}
        return by_spec(
            F.col("specification"), c.specs, lambda s: F.lit(values[s.name.lower()]).cast("long")
        )

    sets = []
    for i, w in enumerate(_words(c.traits, "has")):
        every = (1 << BITS) - 1
        sets.append(
            F.col(w).bitwiseAND(mask(c.known_bits, i, every)).alias(f"rogue_{i}")
        )
        required = mask(c.required_bits, i)
        sets.append(required.bitwiseAND(F.bitwise_not(F.col(w))).alias(f"missing_{i}"))
    for i, w in enumerate(_words(c.checks, "fails")):
        sets.append(F.col(w).bitwiseAND(mask(c.check_bits, i)).alias(f"failed_{i}"))
    return rows.select(
        "asset_path", "specification", "n_files", "n_file_errors", *sets
    )


def has_findings(c: Compiled) -> Column:
    """Does a row of `findings` hold any finding?"""
    words = (
        _words(c.traits, "rogue") + _words(c.traits, "missing") + _words(c.checks, "failed")
    )
    union = F.col(words[0])
    for w in words[1:]:
        union = union.bitwiseOR(F.col(w))
    return union != 0


def asset_table(
    files: DataFrame, specs: Registry, failing_only: bool = False
) -> DataFrame:
    """One row per asset and specification: `n_files`, `n_file_errors`,
    `asset_error`, null for a sound asset.

    The files are read twice, so they should be a saved table.
    """
    c = Compiled(specs)
    rows = findings(asset_bits(files, specs), c)
    messages = row_messages(files, specs)
    extra = set_messages(files, specs)
    if failing_only and extra is None:
        rows = rows.where(has_findings(c))
    if extra is not None:
        messages = messages.unionByName(extra)
    messages = messages.groupBy("asset_path").agg(
        F.map_from_entries(F.collect_list(F.struct("check", "message"))).alias("messages")
    )

    def columns(flags: Sequence, prefix: str) -> list[Column]:
        return [F.col(w) for w in _words(flags, prefix)]

    numbers = [str(i) for i in range(len(c.checks))]
    names = F.lit("/".join(f"{x.trait}:{x.rule.name}" for x in c.checks))
    set_checks = [str(i) for i, x in enumerate(c.checks) if isinstance(x.rule, SetRule)]
    own_checks = by_spec(
        F.col("specification"),
        specs,
        lambda s: F.split(
            F.lit("/".join(str(i) for i in c.check_bits(s.name.lower()) if str(i) in set_checks)),
            "/",
        ),
    )

    def text(number: Column) -> Column:
        i = number.cast("int")
        check = F.split(F.get(F.split(names, "/"), i), ":")
        return F.concat(
            F.get(check, F.lit(0)),
            F.lit(": "),
            F.coalesce(
                F.try_element_at(F.col("messages"), i),
                F.concat(
                    F.lit("Rule "),
                    F.get(check, F.lit(1)),
                    F.lit(" fails for a file of another specification."),
                ),
            ),
        )

    failed = _names(columns(c.checks, "failed"), numbers)
    if set_checks:
        reported = F.transform(F.map_keys("messages"), lambda k: k.cast("string"))
        failed = F.concat(
            failed,
            F.coalesce(
                F.array_intersect(own_checks, reported), F.array().cast("array<string>")
            ),
        )
    errors = F.array_sort(
        F.concat(
            F.transform(
                _names(columns(c.traits, "rogue"), c.traits),
                lambda t: F.concat(t, F.lit(": Rogue field.")),
            ),
            F.transform(
                _names(columns(c.traits, "missing"), c.traits),
                lambda t: F.concat(t, F.lit(": This field is required.")),
            ),
            F.transform(failed, text),
        )
    )
    return (
        rows.join(messages, "asset_path", "left")
        .withColumn("_errors", errors)
        .select(
            "asset_path",
            "specification",
            "n_files",
            "n_file_errors",
            F.when(
                F.size("_errors") > 0,
                F.concat(
                    F.lit("DataError( "), F.array_join("_errors", " "), F.lit(" )")
                ),
            ).alias("asset_error"),
        )
    )


def broken_assets(files: DataFrame, specs: Registry) -> DataFrame:
    """asset_path, specification of the assets that break their rules, without
    texts.  Cheaper than `asset_table` where only validity is asked."""
    c = Compiled(specs)
    rows = findings(asset_bits(files, specs), c)
    broken = rows.where(has_findings(c)).select("asset_path", "specification")
    found = set_failures(files, specs)
    if found is None:
        return broken
    extra = found[1].select("asset_path", "check")
    owners = _owner_table(c)
    more = extra.withColumn("specification", F.explode(F.element_at(owners, F.col("check"))))
    more = more.join(rows, ["asset_path", "specification"], "left_semi")
    return broken.unionByName(more.select("asset_path", "specification")).distinct()


def _owner_table(c: Compiled) -> Column:
    """Map of check number to the specifications that declare it."""
    entries = []
    for i in range(len(c.checks)):
        owners = [s for s in c.spec_names if i in c.check_bits(s)]
        entries += [F.lit(i), F.array(*[F.lit(s) for s in owners])]
    return F.create_map(*entries)


def _join_failures(files: DataFrame, failures: DataFrame, columns: list[str]) -> DataFrame:
    """Left join of assets onto file rows.

    Files without an asset join on their own path, which is never an asset's,
    so that their null keys do not pile up in one partition.  A huge asset is a
    skewed key of the file side only, which adaptive execution splits.
    """
    right = failures.select(
        F.col("asset_path").alias("_asset"),
        F.col("specification").alias("_spec"),
        *columns,
    )
    return (
        files.withColumn("_key", F.coalesce("asset_path", "filepath"))
        .join(
            right,
            (F.col("_key") == F.col("_asset"))
            & F.col("specification").eqNullSafe(F.col("_spec")),
            "left",
        )
        .drop("_key", "_asset", "_spec")
    )


def _row_valid(specs: Registry, sound: Column) -> Column:
    return (
        F.coalesce(F.col("specification").isin(list(specs)), F.lit(False))
        & F.col("file_error").isNull()
        & sound
    )


def validate_assets(files: DataFrame, specs: Registry) -> DataFrame:
    """Add `asset_error` (a text, null when sound) and `asset_valid` to every
    file row.  Validity is per row: no asset error, no file error, known
    specification."""
    assets = asset_table(files, specs, failing_only=True)
    joined = _join_failures(files, assets, ["asset_error"])
    return joined.withColumn(
        "asset_valid", _row_valid(specs, F.col("asset_error").isNull())
    )


def add_asset_valid(files: DataFrame, specs: Registry) -> DataFrame:
    """Add `asset_valid` only."""
    broken = broken_assets(files, specs).withColumn("_broken", F.lit(True))
    joined = _join_failures(files, broken, ["_broken"])
    return joined.withColumn(
        "asset_valid", _row_valid(specs, F.col("_broken").isNull())
    ).drop("_broken")


def asset_summary(files: DataFrame, specs: Registry) -> DataFrame:
    """Assets and files by specification: how many, and how many are valid.

    An asset counts as valid when all its files are.  One aggregate per asset,
    then one per specification; nothing is joined back to the files.
    """
    c = Compiled(specs)
    rows = findings(asset_bits(files, specs), c)
    sound = ~has_findings(c)
    if any(isinstance(x.rule, SetRule) for x in c.checks):
        bad = broken_assets(files, specs).withColumn("_broken", F.lit(True))
        rows = rows.join(bad, ["asset_path", "specification"], "left")
        sound = sound & F.col("_broken").isNull()
    clean = F.col("n_files") - F.col("n_file_errors")
    return rows.groupBy("specification").agg(
        F.count(F.lit(1)).alias("n_assets"),
        F.count_if(sound & (F.col("n_file_errors") == 0)).alias("n_valid_assets"),
        F.sum("n_files").alias("n_files"),
        F.sum(F.when(sound, clean).otherwise(F.lit(0))).alias("n_valid_files"),
    )
