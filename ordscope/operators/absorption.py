"""Regression with factors of any number of levels: their effects are absorbed, not estimated.

By the theorem of Frisch, Waugh and Lovell the coefficients of the remaining terms, the
residual sum of squares and robust errors follow from the residuals of all columns after
a projection on the absorbed factors. The projection of the largest factor is a division
of sums by counts per level. That of the others is solved by conjugate gradients on their
sums per level, all columns at once, each with its own step lengths. A step is a few
joins and map-side combined sums over the distinct level combinations; levels stay in
tables, and only one number per column comes to the driver.

The rank of the absorbed factors is their number of levels less the links they share:
for two factors exactly the number of connected components of the graph of levels that
occur together. Further factors are each counted against the first, an upper bound where
they are collinear with several at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordscope.session import materialise

MOST_STEPS = 2000


@dataclass
class Absorbed:
    """Projection of the columns on the absorbed factors.

    ``incidence``: ``cell, first`` (a level of the first factor), ``level`` (of another one;
    null with one factor) ``n``; ``columns``: ``cell, column, value`` (sums over the
    cell's rows); ``first_effects``: ``first, column, value``; ``other_effects``: ``level,
    column, value`` or None.
    """

    factors: tuple[str, ...]
    incidence: DataFrame
    columns: DataFrame
    first_effects: DataFrame
    other_effects: DataFrame | None
    rank: int

    def fitted(self) -> DataFrame:
        """``cell, column, value``: the projection's value in each cell, where it is not zero for lack of data."""
        cells = self.incidence.select("cell", "first").distinct()
        fitted = cells.join(self.first_effects, "first").select("cell", "column", "value")
        if self.other_effects is not None:
            others = self.incidence.select("cell", "level").join(self.other_effects, "level").select("cell", "column", "value")
            fitted = fitted.unionAll(others)
        return fitted.groupBy("cell", "column").agg(F.sum("value").alias("value"))

    def explained(self) -> DataFrame:
        """Tidy ``i, j, value``: the part of the columns' products that the factors explain."""
        left = self.columns.select("cell", F.col("column").alias("i"), F.col("value").alias("sum"))
        right = self.fitted().select("cell", F.col("column").alias("j"), F.col("value").alias("fit"))
        return left.join(right, "cell").groupBy("i", "j").agg(F.sum(F.col("sum") * F.col("fit")).alias("value"))


def _level(factor: str) -> Column:
    return F.concat(F.lit(f"{factor}="), F.col(f"`{factor}`").cast("string"))


def component_count(edges: DataFrame) -> int:
    """Number of connected components of the bipartite graph ``edges(a, b)`` without isolated nodes.

    Rounds of least labels; each halves what is left of a chain at least, by also
    following the label's own label.
    """
    both = edges.select("a", "b").distinct()
    both = materialise(both.unionAll(both.select("b", "a")).toDF("a", "b"), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(seen, "a").select("a", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("further"))
        moved = lower.join(jump, "label", "left").select("a", "before", F.least("label", F.coalesce("further", "label")).alias("label"))
        moved = materialise(moved, "labels")
        labels = moved.select("a", "label")
        if moved.where("label <> before").isEmpty():
            return labels.select("label").distinct().count()


def _solve(incidence: DataFrame, counts: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Effects ``level, column, value`` of the other factors, net of the first one.

    ``right`` is ``level, column, value``: sums of the columns net of the first factor.
    Preconditioned with the levels' counts; a column stops when its residual is
    ``tolerance`` times what it was.
    """
    firsts = incidence.select("cell", "first", "n").distinct().groupBy("first").agg(F.sum("n").alias("n_first"))
    sizes = incidence.groupBy("level").agg(F.sum("n").alias("size"))

    def applied(p: DataFrame) -> DataFrame:
        """The normal matrix times ``p(level, column, p)``."""
        at = incidence.join(p, "level").groupBy("cell", "first", "n", "column").agg(F.sum("p").alias("f"))
        means = at.groupBy("first", "column").agg(F.sum(F.col("n") * F.col("f")).alias("s"))
        means = means.join(firsts, "first").select("first", "column", (F.col("s") / F.col("n_first")).alias("mean"))
        # A cell whose own levels have no part of a column still carries the mean of its first level.
        spread = incidence.join(means, "first").join(at.select("cell", "column", "f"), ["cell", "column"], "left")
        net = F.col("n") * (F.coalesce("f", F.lit(0.0)) - F.col("mean"))
        return spread.groupBy("level", "column").agg(F.sum(net).alias("ap"))

    state = right.join(sizes, "level").select(
        "level", "column", F.lit(0.0).alias("x"), F.col("value").alias("r"), (F.col("value") / F.col("size")).alias("p"), "size"
    )
    state = materialise(state, "gradient")
    rows = state.groupBy("column").agg(F.sum(F.col("r") * F.col("r") / F.col("size")).alias("rz")).collect()  # one row per column
    norms = {r["column"]: r["rz"] for r in rows}
    begin = dict(norms)
    for _ in range(MOST_STEPS):
        going = [c for c, v in norms.items() if v > tolerance**2 * begin[c] and v > 0.0]
        if not going:
            return state.select("level", "column", F.col("x").alias("value"))
        moving = state.where(F.col("column").isin(going)) if len(going) < len(norms) else state
        ap = applied(moving.select("level", "column", "p"))
        full = materialise(state.join(ap, ["level", "column"], "left").fillna(0.0, ["ap"]), "gradient")
        rows = full.groupBy("column").agg(F.sum(F.col("p") * F.col("ap")).alias("pap")).collect()
        step = {r["column"]: norms[r["column"]] / r["pap"] if r["column"] in going and r["pap"] > 0 else 0.0 for r in rows}
        alpha = _per_column(step)
        moved = full.select(
            "level", "column", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p", "size"
        )
        rows = moved.groupBy("column").agg(F.sum(F.col("r") * F.col("r") / F.col("size")).alias("rz")).collect()
        new = {r["column"]: r["rz"] for r in rows}
        beta = _per_column({c: new[c] / norms[c] if c in going and norms[c] > 0 else 0.0 for c in norms})
        state = materialise(moved.withColumn("p", F.col("r") / F.col("size") + beta * F.col("p")), "gradient")
        norms = {c: new[c] if c in going else norms[c] for c in norms}
    raise ArithmeticError(f"the projection did not converge in {MOST_STEPS} steps")


def _per_column(values: dict[str, float]) -> Column:
    """A number per column name, from a map literal: there are no more columns than the solver takes terms."""
    entries = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.col("column")), F.lit(0.0)) if entries else F.lit(0.0)


def absorb(cells: DataFrame, factors: Sequence[str], columns: DataFrame, tolerance: float = 1e-12) -> Absorbed:
    """Project ``columns(cell, column, value)`` on ``factors`` of ``cells(cell, n, <factors>)``, largest factor first."""
    first, others = factors[0], list(factors[1:])
    named = cells.select("cell", F.col("n").cast("double").alias("n"), _level(first).alias("first"), *[_level(f).alias(f"l_{i}") for i, f in enumerate(others)])
    levels = F.explode(F.array(*[F.col(f"l_{i}") for i in range(len(others))])) if others else F.lit(None).cast("string")
    incidence = materialise(named.select("cell", "first", "n", levels.alias("level")), "incidence")
    counts = named.groupBy("first").agg(F.sum("n").alias("n_first"))
    sums = named.select("cell", "first").join(columns, "cell").groupBy("first", "column").agg(F.sum("value").alias("s"))
    means = materialise(sums.join(counts, "first").select("first", "column", (F.col("s") / F.col("n_first")).alias("value")), "means")
    rank = counts.count()
    if not others:
        return Absorbed(tuple(factors), incidence, columns, means, None, rank)

    own = incidence.select("cell", "level").join(columns, "cell").groupBy("level", "column").agg(F.sum("value").alias("own"))
    shared = incidence.join(means.withColumnRenamed("value", "mean"), "first").groupBy("level", "column").agg(F.sum(F.col("n") * F.col("mean")).alias("mean"))
    right = shared.join(own, ["level", "column"], "full").select(
        "level", "column", (F.coalesce("own", F.lit(0.0)) - F.coalesce("mean", F.lit(0.0))).alias("value")
    )
    effects = materialise(_solve(incidence, counts, right, tolerance), "effects")
    # What the first factor's effects are beside the others': means of the columns less their effects.
    beside = incidence.join(effects, "level").groupBy("first", "column").agg(F.sum(F.col("n") * F.col("value")).alias("s"))
    beside = beside.join(counts, "first").select("first", "column", (F.col("s") / F.col("n_first")).alias("beside"))
    effects_first = means.join(beside, ["first", "column"], "full").select(
        "first", "column", (F.coalesce("value", F.lit(0.0)) - F.coalesce("beside", F.lit(0.0))).alias("value")
    )
    for i in range(len(others)):
        pairs = named.select(F.col("first").alias("a"), F.col(f"l_{i}").alias("b"))
        rank += pairs.select("b").distinct().count() - component_count(pairs)
    return Absorbed(tuple(factors), incidence, columns, materialise(effects_first, "effects"), effects, rank)
