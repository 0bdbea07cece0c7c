"""Identifiers, seeds, stable shards, path components, short texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordscope import fixed_values as fv


def unit_id(model: Column, group: Column, seed: Column) -> Column:
    """``model__group__seed`` with path separators and blanks replaced."""
    return F.concat_ws(
        "__", F.translate(model, "/", "_"), F.translate(group, " ", "_"), seed.cast("string")
    )


def cell_seed(
    group_index: Column,
    language_index: Column,
    model_index: Column,
    replicate: Column,
    base: int = fv.BASE_SEED,
    offset: int = 0,
) -> Column:
    """Linear seed; distinct while each index stays below its multiplier's range."""
    m_base, m_group, m_language, m_model = fv.SEED_MULTIPLIERS
    return (
        F.lit(base * m_base + offset).cast("long")
        + group_index.cast("long") * m_group
        + language_index.cast("long") * m_language
        + model_index.cast("long") * m_model
        + replicate.cast("long")
    )


def seed_slot(language_index: Column, model_index: Column, replicate: Column) -> Column:
    """The part of a seed that follows its group's."""
    _, _, m_language, m_model = fv.SEED_MULTIPLIERS
    return (language_index * m_language + model_index * m_model + replicate).cast("int")


def short_seed(group_index: Column, replicate: Column, base: int = fv.BASE_SEED) -> Column:
    """Seed format of the small proof-of-concept grid."""
    return F.lit(base * 1000).cast("long") + group_index.cast("long") * 100 + replicate.cast("long")


def stable_shard(key: Column, n_shards: int) -> Column:
    """Shard number from the first 64 bits of SHA-256; the same on every engine."""
    if n_shards < 1:
        raise ValueError(f"n_shards must be >= 1, got {n_shards}")
    if n_shards == 1:
        return F.lit(0)
    head = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 16), 16, 10)
    return F.pmod(head.cast("decimal(20,0)"), F.lit(n_shards).cast("decimal(20,0)")).cast("int")


def in_shard(key: Column, shard_id: int, n_shards: int) -> Column:
    """Predicate: does this key belong to the shard?"""
    if n_shards < 1:
        raise ValueError(f"n_shards must be >= 1, got {n_shards}")
    if not 0 <= shard_id < n_shards:
        raise ValueError(f"shard_id {shard_id} out of range for n_shards {n_shards}")
    if n_shards == 1:
        return F.lit(True)
    return stable_shard(key, n_shards) == shard_id


def marker_key(marker: Column, group: Column) -> Column:
    return F.concat(F.lit("marker:"), marker, F.lit(":"), group)


def is_marker(key: Column) -> Column:
    return key.startswith("marker:")


def split_marker(key: Column) -> Column:
    """``struct<marker, grp>``; a key without the prefix has a NULL marker."""
    parts = F.split(key, ":", 3)
    return F.struct(
        F.when(is_marker(key), parts[1]).alias("marker"),
        F.when(is_marker(key), parts[2]).otherwise(key).alias("grp"),
    )


def safe_path_component(name: Column) -> Column:
    """Replace reserved characters and blanks, drop trailing dots and blanks."""
    unsafe = fv.UNSAFE_PATH_CHARACTERS + " "
    cleaned = F.regexp_replace(F.translate(name, unsafe, "_" * len(unsafe)), "[. ]+$", "")
    return F.when(F.length(cleaned) > 0, cleaned).otherwise(F.lit("_"))


def canonical_path(group: Column, seed: Column, root: str) -> Column:
    return F.concat(
        F.lit(root.rstrip("/") + "/"),
        safe_path_component(group),
        F.lit("/seed_"),
        seed.cast("string"),
        F.lit(".png"),
    )


def cell_id(model: Column, language: Column, country: Column, group: Column) -> Column:
    return F.concat_ws("|", model, language, country, group)


def shard_group(grid: Column, model: Column, language: Column) -> Column:
    return F.concat_ws("|", grid, model, language)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def fold_seed(seed: Column, modulus: int = fv.PROVIDER_SEED_MODULUS) -> Column:
    return F.pmod(seed.cast("long"), F.lit(modulus).cast("long"))


def major_code(major: Column, minor: Column) -> Column:
    """Explicit major code, else the first character of the minor code."""
    return F.coalesce(F.nullif(major, F.lit("")), F.substring(minor, 1, 1))


def tenths_half_even(x: Column) -> Column:
    """One decimal, half to even, of the exact binary value of ``x`` (1 to 2048; beyond, of its decimal form).

    1.15 is stored a little below 1.15 and becomes 1.1; only x.25 and x.75 are ties.
    """
    unit = 1 << 52  # in these units every double from 1 to 2048 is an integer
    whole = (x * float(unit)).cast("long").cast("decimal(38,0)") * F.lit(10)
    rest = whole % F.lit(unit)
    tenths = ((whole - rest) / F.lit(unit)).cast("long")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (tenths % 2 == 1))
    return F.when(x < 2048, (tenths + up.cast("long")) / 10.0).otherwise(F.bround(x, 1))


def format_eta(seconds: Column) -> Column:
    """Days, hours or minutes as short text, rounded half to even; a dash if unknown."""
    return (
        F.when(seconds.isNull(), F.lit("—"))
        .when(seconds >= 86_400.0, F.format_string("%.1f d", tenths_half_even(seconds / 86_400.0)))
        .when(seconds >= 3_600.0, F.format_string("%.1f h", tenths_half_even(seconds / 3_600.0)))
        .otherwise(F.format_string("%.0f min", F.bround(seconds / 60.0, 0)))
    )


def case_map(key: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """CASE expression from a small fixed mapping."""
    items = list(mapping.items())
    start = F.when(key == items[0][0], F.lit(items[0][1]))
    expr = reduce(lambda e, kv: e.when(key == kv[0], F.lit(kv[1])), items[1:], start)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def backend_for(model: Column) -> Column:
    return case_map(model, fv.BACKEND_BY_MODEL, fv.BACKEND_DEFAULT)


def runner_for(model: Column) -> Column:
    return case_map(model, fv.RUNNER_BY_MODEL, fv.RUNNER_DEFAULT)


def country_for_language(language: Column) -> Column:
    return F.when(language == "en", F.lit(fv.MULTI_COUNTRY)).otherwise(
        case_map(language, fv.LANGUAGE_COUNTRY, fv.DEFAULT_COUNTRY)
    )
