"""Grid enumeration, pending work, manifests.

A grid is a linear expansion of its first dimension: every group row explodes
into (language, model, replicate) combinations held in literal arrays. There is
no join between dimensions, and a large group table stays distributed.

Which units are done is decided before the expansion where possible: the ids of a log
are taken apart into group and slot, and each group row meets its own done slots. So
one row per group moves, not one per cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions import ids
from ordscope.functions.literals import array_of, structs_of
from ordscope.functions.prompts import prompt_status, prompt_text
from ordscope.operators.checks import require_columns
from ordscope.session import materialise
from ordscope.sources.literals import literal_table


def indexed(values: Sequence[str], index_name: str, value_name: str) -> Column:
    """Literal array of (index, value), ready to be exploded with ``inline``."""
    return structs_of(enumerate(values), (index_name, value_name))


def enumerate_grid(
    groups: DataFrame,
    languages: Sequence[str],
    models: Sequence[str],
    replicates: int,
    grid: str = "main",
    offset: int = 0,
    priority: int = 0,
    base: int = fv.BASE_SEED,
    country: Column | None = None,
    done: DataFrame | None = None,
) -> DataFrame:
    """All cells of a grid from ``groups (grp_index, grp)``.

    ``ord_*`` columns reproduce the enumeration order (priority, group, language,
    model, replicate) for anything that has to respect it. Given a table ``done`` with
    an ``image_id``, the column ``done`` tells whether it has the cell's id; a group
    without an index has no seed, so its cells are never done.
    """
    require_columns(groups, ["grp_index", "grp"], "groups")
    if done is not None and not _seeds_distinct(len(languages), len(models), replicates):
        plain = enumerate_grid(groups, languages, models, replicates, grid, offset, priority, base, country)
        return flag_done(plain, done)
    groups = groups.select("grp_index", "grp")
    slots = []
    if done is not None:
        found = done_slots(done, models, len(languages), replicates, base, offset).hint("merge")
        same = (F.col("grp_index").cast("long") == F.col("__group")) & F.translate("grp", " ", "_").eqNullSafe(F.col("__part"))
        groups, slots = groups.join(found, same, "left").select("grp_index", "grp", "__slots"), ["__slots"]
        # Few bytes that become many cells: a fixed number of partitions, which is not merged by size.
        spark = groups.sparkSession
        groups = groups.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    cells = (
        groups.select("grp_index", "grp", *slots, F.inline(indexed(languages, "lang_index", "language")))
        .select("*", F.inline(indexed(models, "model_index", "model")))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    )
    seed = ids.cell_seed(
        F.col("grp_index"), F.col("lang_index"), F.col("model_index"), F.col("replicate"), base, offset
    )
    anchor = ids.country_for_language(F.col("language")) if country is None else country
    slot = ids.seed_slot(F.col("lang_index"), F.col("model_index"), F.col("replicate"))
    is_done = F.coalesce(F.array_contains("__slots", slot), F.lit(False)).alias("done") if slots else None
    return cells.select(
        F.lit(grid).alias("grid"),
        F.lit(priority).alias("prio"),
        F.col("grp_index").cast("long").alias("ord_group"),
        F.col("lang_index").alias("ord_language"),
        F.col("model_index").alias("ord_model"),
        "replicate",
        F.col("grp").alias("occupation"),
        "language",
        anchor.alias("country"),
        "model",
        seed.alias("seed"),
        F.lit(replicates).alias("target_n"),
        ids.unit_id(F.col("model"), F.col("grp"), seed).alias("image_id"),
        *([] if is_done is None else [is_done]),
    )


def _seeds_distinct(n_languages: int, n_models: int, replicates: int) -> bool:
    """Does each index stay below its multiplier's range, so that a seed tells them all?"""
    _, m_group, m_language, m_model = fv.SEED_MULTIPLIERS
    return n_languages * m_language <= m_group and n_models * m_model <= m_language and replicates <= m_model


def done_slots(
    done: DataFrame, models: Sequence[str], n_languages: int, replicates: int, base: int = fv.BASE_SEED, offset: int = 0,
    id_col: str = "image_id",
) -> DataFrame:
    """``__group, __part, __slots``: the done units of a grid, one row per group index and group name in ids.

    An id is taken apart into its seed's indices and the group's name, and counts only
    if these give the same id again; ids of other grids fall out here. A group has at
    most as many slots as combinations, however often an id is logged.
    """
    m_base, m_group, m_language, m_model = fv.SEED_MULTIPLIERS

    def once(rows: DataFrame, *kept: str, **columns: Column) -> DataFrame:
        """By way of a generator, across which an expression is not computed anew wherever it is used."""
        return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))

    rows = once(done, __id=F.col(id_col).cast("string"))
    rows = once(rows, "__id", __seed=F.substring_index("__id", "__", -1).try_cast("long"))
    rows = once(rows, "__id", "__seed", __rest=F.try_subtract("__seed", F.lit(base * m_base + offset).cast("long")))
    rows = once(rows.where("__rest IS NOT NULL"), "__id", "__seed", "__rest", __slot=F.pmod("__rest", F.lit(m_group).cast("long")).cast("int"))
    language, rest = F.floor(F.col("__slot") / m_language), F.col("__slot") % m_language
    rows = rows.where((language < n_languages) & (F.floor(rest / m_model) < len(models)) & (rest % m_model < replicates))
    heads = array_of([model.replace("/", "_") + "__" for model in models])
    rows = once(
        rows, "__id", "__rest", "__slot", __head=F.get(heads, F.floor(rest / m_model).cast("int")), __tail=F.concat(F.lit("__"), F.col("__seed").cast("string"))
    )
    # The id of a group without a name: "model__seed".
    bare = F.concat("__head", F.substring("__tail", 3, 20))
    between = F.substring("__id", F.length("__head") + 1, F.length("__id") - F.length("__head") - F.length("__tail"))
    rows = once(rows, "__id", "__rest", "__slot", "__head", "__tail", __bare=F.col("__id") == bare, __part=between)
    rows = rows.where(F.col("__bare") | (F.col("__id") == F.concat("__head", "__part", "__tail")))
    group = F.expr(f"(__rest - __slot) div {m_group}").alias("__group")
    part = F.when(~F.col("__bare"), F.col("__part")).alias("__part")
    return rows.select(group, part, "__slot").groupBy("__group", "__part").agg(F.collect_set("__slot").alias("__slots"))


def flag_done(cells: DataFrame, done: DataFrame | None, id_col: str = "image_id") -> DataFrame:
    """``cells`` with the column ``done``; cells that were enumerated with it stay as they are."""
    if done is None:
        require_columns(cells, ["done"], "cells")
        return cells
    # Distinct ids collapse map-side, so an id logged very often is one row in the join.
    ready = done.select(F.col(id_col).cast("string").alias(id_col), F.lit(True).alias("__done")).distinct()
    # Ids and cells are far larger than the files they come from, by which a broadcast would be planned.
    flagged = cells.join(ready.hint("merge"), id_col, "left")
    return flagged.withColumn("done", F.coalesce("__done", F.lit(False))).drop("__done")


def _named_groups(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return literal_table(spark, enumerate(names), "grp_index int, grp string")


def main_grid(spark: SparkSession) -> DataFrame:
    return enumerate_grid(
        _named_groups(spark, fv.GROUP_NAMES), fv.MAIN_LANGUAGES, fv.MAIN_MODELS, fv.MAIN_REPLICATES
    )


def poc_grid(spark: SparkSession) -> DataFrame:
    """Small proof-of-concept grid with its own seed format."""
    cells = enumerate_grid(
        _named_groups(spark, fv.POC_GROUPS), ("en",), fv.MAIN_MODELS[:1], fv.POC_REPLICATES, "poc",
        country=F.lit(fv.DEFAULT_COUNTRY),
    )
    seed = ids.short_seed(F.col("ord_group"), F.col("replicate"))
    return cells.withColumn("seed", seed).withColumn(
        "image_id", ids.unit_id(F.col("model"), F.col("occupation"), F.col("seed"))
    )


def marker_grid(spark: SparkSession) -> DataFrame:
    """Marker variants: the marker takes the language slot of the seed."""
    cells = enumerate_grid(
        _named_groups(spark, fv.MARKER_GROUPS),
        list(fv.MARKERS),
        fv.MAIN_MODELS[:1],
        fv.MARKER_REPLICATES,
        "h5",
        fv.SEED_OFFSETS["h5"],
        priority=1,
        country=F.lit(fv.MULTI_COUNTRY),
    )
    key = ids.marker_key(F.col("language"), F.col("occupation"))
    return cells.withColumn("occupation", key).withColumns(
        {
            "language": F.lit("en"),
            "image_id": ids.unit_id(F.col("model"), F.col("occupation"), F.col("seed")),
        }
    )


def robustness_grid(spark: SparkSession) -> DataFrame:
    groups = _named_groups(spark, fv.ROBUSTNESS_GROUPS)
    extra_models = enumerate_grid(
        groups,
        fv.MAIN_LANGUAGES,
        fv.EXTRA_MODELS,
        fv.ROBUSTNESS_REPLICATES,
        "robustness",
        fv.SEED_OFFSETS["robustness"],
        priority=2,
    )
    indigenous = enumerate_grid(
        groups,
        fv.INDIGENOUS_LANGUAGES,
        fv.MAIN_MODELS,
        fv.ROBUSTNESS_REPLICATES,
        "robustness",
        fv.SEED_OFFSETS["robustness_indigenous"],
        priority=3,
        country=F.lit(fv.MULTI_COUNTRY),
    )
    return extra_models.unionByName(indigenous)


def all_grids(spark: SparkSession) -> DataFrame:
    """Ordered union: main, marker, robustness (``prio`` keeps the order)."""
    return main_grid(spark).unionByName(marker_grid(spark)).unionByName(robustness_grid(spark))


def expected_size(n_groups: int, n_languages: int, n_models: int, replicates: int) -> int:
    return n_groups * n_languages * n_models * replicates


def expected_sizes() -> dict[str, int]:
    n = len(fv.ROBUSTNESS_GROUPS) * fv.ROBUSTNESS_REPLICATES
    return {
        "main": expected_size(
            len(fv.GROUP_NAMES), len(fv.MAIN_LANGUAGES), len(fv.MAIN_MODELS), fv.MAIN_REPLICATES
        ),
        "h5": expected_size(len(fv.MARKER_GROUPS), len(fv.MARKERS), 1, fv.MARKER_REPLICATES),
        "robustness": n * len(fv.MAIN_LANGUAGES) * len(fv.EXTRA_MODELS)
        + n * len(fv.INDIGENOUS_LANGUAGES) * len(fv.MAIN_MODELS),
    }


ENUMERATION_ORDER = ("prio", "ord_group", "ord_language", "ord_model", "replicate")


def pending_cells(
    cells: DataFrame, done: DataFrame | None = None, shard_id: int = 0, n_shards: int = 1, id_col: str = "image_id"
) -> DataFrame:
    """Cells that are not done yet and belong to the shard.

    The shard predicate runs before the anti-join and is also applied to the done
    ids: both sides then carry 1/n_shards of the keys into the shuffle. Without a
    table ``done`` the cells' own column tells.
    """
    mine = ids.in_shard(F.col(id_col), shard_id, n_shards)
    if done is None:
        return flag_done(cells, None).where(mine & ~F.col("done")).drop("done")
    ready = done.select(F.col(id_col).cast("string").alias(id_col)).where(
        ids.in_shard(F.col(id_col).cast("string"), shard_id, n_shards)
    )
    # Distinct ids collapse map-side, so an id logged very often is one row in the join.
    ready = ready.distinct()
    return cells.where(mine).join(ready.hint("merge"), id_col, "left_anti")


def renderable(cells: DataFrame) -> DataFrame:
    """Cells whose prompt can be rendered."""
    return cells.where(prompt_status(F.col("occupation"), F.col("language")) == "ok")


def slice_predicate(
    include_fallback: bool = False,
    include_main: bool = True,
    include_indigenous: bool = True,
    include_extra: bool = True,
) -> Column:
    """Which slices of the grid a shift works on."""
    model, language = F.col("model"), F.col("language")
    fallback = model == fv.MAIN_MODELS[0]
    main = model.isin(*fv.MAIN_MODELS[1:])
    indigenous = language.isin(*fv.INDIGENOUS_LANGUAGES)
    return F.when(fallback, F.lit(include_fallback)).otherwise(
        (main & F.lit(include_main))
        | (indigenous & F.lit(include_indigenous))
        | (~main & F.lit(include_extra))
    )


def missing_manifest(
    cells: DataFrame, done: DataFrame | None = None, n_shards: int = 4, id_col: str = "image_id"
) -> DataFrame:
    """One row per missing unit with counts of its cell, routing and prompt.

    ``done`` may contain repeats; it is reduced to distinct ids first. Cells that were
    enumerated with their column ``done`` need no table and are not shuffled. The count
    of finished units per cell is an aggregate joined back on the cell id.
    """
    cid = ids.cell_id(F.col("model"), F.col("language"), F.col("country"), F.col("occupation"))
    flagged = flag_done(cells, done, id_col).withColumn("cell_id", cid)
    # One row per cell, written out so that the join back is planned with its size:
    # broadcast while small, and the missing rows are not shuffled again.
    counts = materialise(
        flagged.groupBy("cell_id").agg(F.count_if("done").alias("current_n")), "cell-counts"
    )
    runner = ids.runner_for(F.col("model"))
    return (
        flagged.where(~F.col("done"))
        .drop("done")
        .join(counts, "cell_id", "left")
        .select(
            "grid",
            "model",
            ids.backend_for(F.col("model")).alias("backend"),
            "language",
            "country",
            "occupation",
            F.col("cell_id").alias("prompt_id"),
            "cell_id",
            id_col,
            "seed",
            F.coalesce(prompt_text(F.col("occupation"), F.col("language")), F.lit("")).alias("prompt"),
            prompt_status(F.col("occupation"), F.col("language")).alias("prompt_status"),
            F.col("target_n").cast("long").alias("target_n"),
            "current_n",
            F.greatest(F.col("target_n") - F.col("current_n"), F.lit(0)).alias("missing_n"),
            ids.shard_group(F.col("grid"), F.col("model"), F.col("language")).alias("shard_group"),
            ids.stable_shard(F.col(id_col), n_shards).alias("shard_id"),
            F.lit(n_shards).alias("n_shards"),
            runner.alias("recommended_runner"),
        )
    )


def manifest_problems(manifest: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Counts that must be zero: repeated ids, rows of completed cells."""
    per_id = manifest.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("missing_n") <= 0) | (F.col("current_n") >= F.col("target_n"))).alias("bad"),
    )
    return per_id.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("completed_rows"),
    )


def normalise_manifest(manifest: DataFrame, default_grid: str | None = None) -> DataFrame:
    """Trim column names; derive ``grid`` from the shard group; check required columns."""
    df = manifest.toDF(*[c.strip() for c in manifest.columns])
    if "grid" not in df.columns:
        if "shard_group" in df.columns:
            df = df.withColumn("grid", F.split(F.col("shard_group").cast("string"), r"\|", 2)[0])
        elif default_grid:
            df = df.withColumn("grid", F.lit(default_grid))
    require_columns(
        df,
        ["model", "language", "grid", "recommended_runner", "prompt_status", "image_id", "occupation", "seed"],
        "manifest",
    )
    return df


def select_work(
    manifest: DataFrame,
    model: str,
    language: str,
    done: DataFrame,
    shard_id: int = 0,
    n_shards: int = 1,
    max_units: int = 0,
    grid: str | None = None,
    runner: str | None = None,
) -> DataFrame:
    """Rows of a manifest one worker should take, in a stable order."""
    df = normalise_manifest(manifest, grid)
    df = df.where((F.col("model") == model) & (F.col("language") == language))
    if grid:
        df = df.where(F.col("grid") == grid)
    if runner:
        df = df.where(F.col("recommended_runner") == runner)
    df = df.where(F.col("prompt_status") == "ok")
    df = pending_cells(df.withColumn("image_id", F.col("image_id").cast("string")), done, shard_id, n_shards)
    return top_rows(df, ["grid", "occupation", "seed", "image_id"], max_units)


def top_rows(df: DataFrame, order: Sequence[str], n: int = 0) -> DataFrame:
    """Stable multi-key sort, optionally the first n rows (a top-k, not a full sort)."""
    ordered = df.orderBy(*order)
    return ordered.limit(n) if n > 0 else ordered


def keep_targets(manifest: DataFrame, targets: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Manifest rows whose id is listed."""
    return manifest.join(targets.select(id_col).distinct(), id_col, "left_semi")


def metadata_rows(
    df: DataFrame,
    aliases: Mapping[str, str] | None = None,
) -> DataFrame:
    """Canonical metadata projection: renamed country, casts, default model source."""
    source = F.col("model_source") if "model_source" in df.columns else F.lit(None).cast("string")
    renamed = {"country": "country_proxy", **(aliases or {})}
    columns = {renamed.get(c, c): F.col(c) for c in df.columns if c != "model_source"}
    casts = {"seed": "long", "duration_s": "double", "timestamp": "long"}
    return df.select(
        *[(col.cast(casts[name]) if name in casts else col).alias(name) for name, col in columns.items()],
        F.coalesce(source, F.col("model")).alias("model_source"),
    )
