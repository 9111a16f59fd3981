"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the copies the mix takes of it. Among all rates from 0 to
``MOST`` (2) that meet the token constraints, entropy balancing takes those with the
least relative entropy to one copy of each document. A margin is a set of disjoint
groups, such as the sources, with a token target each; the rates are

    rate(document) = min(MOST, exp(words of the document * sum of its multipliers))

so a source that must shrink gives up long documents first and one that must grow
repeats them first. The multipliers minimise the convex dual

    sum over documents of F(words * multipliers) - sum over groups of target * multiplier

where F is the integral of min(MOST, exp). Newton iterations solve it, one margin after
the other: groups of one margin are disjoint, so its Hessian block is diagonal, and
gradient and curvature are sums that Spark aggregates. Steps are taken on the logarithm
of a group's tokens and kept between bounds that hold its solution. Documents with equal
words and margin values have equal rates, so an iteration reads one row per such cell.
Sums are exact decimals, so their order does not matter.

Rates become copies by Pareto sampling without a generator: a document takes the whole
part, and its fraction f against its hash u gives it a place u (1 - f) / (f (1 - u)).
Those up to its source's cut take one more. The cut is the prefix of places whose words
come nearest to what is missing, found by distributed running totals; then at most
``FLIPS`` single places per source are switched where that brings the source nearer.
Only hashes and rates decide, so reruns agree.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating; they share
150 % of all words; none gets more than twice its own, the excess is reshared by
weight. Defined cases: null text has size 0; a document without words keeps rate 1, as
no constraint reaches it; the null source is a source; without words all targets and
takings are 0; rows that repeat id and size share their place; texts of any length
count whole; columns other than doc_id, source and text are carried along, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import number_rows, running_totals
from ledgerloom.session import cut_lineage, materialize

WEIGHTS, SHARE, MOST, FLIPS = (3.0, 1.0, 2.0), 1.5, 2, 3
#: Largest relative error of a group's tokens; Newton steps per margin; passes over several margins.
TOLERANCE, ROUNDS, PASSES = 1e-9, 80, 60
EXACT = "decimal(38, 9)"


def words(text: Column) -> Column:
    """Number of runs of anything but ASCII blanks."""
    return F.ifnull(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from ``sized(source, size)``; every step is an aggregate over sources."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = number_rows(sizes, [F.col("source").asc_nulls_last()], "position")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("position") % len(WEIGHTS) + 1).cast("int"))
    weighed = cut_lineage(numbered.select("source", "source_size", weight.alias("weight")))
    limit = F.col("source_size") * float(MOST)
    budget = SHARE * float(weighed.agg(F.ifnull(F.sum("source_size"), F.lit(0))).first()[0])
    # Raise the common level until no source that still shares stands above its limit.
    level = 0.0
    while True:
        full = limit <= F.col("weight") * level
        free, spent = weighed.agg(
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(F.when(full, limit).otherwise(0.0))
        ).first()
        higher = (budget - (spent or 0.0)) / free if free else level
        if higher <= level:
            break
        level = higher
    return weighed.select("source", "source_size", F.least(limit, F.col("weight") * level).alias("target"))


def rate(size: Column, multiplier: Column) -> Column:
    """Copies of a document of ``size`` words at the sum of its groups' multipliers."""
    return F.when(size <= 0, F.lit(1.0)).otherwise(F.least(F.lit(float(MOST)), F.exp(size * multiplier)))


def balance(cells: DataFrame, margins: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``cells`` with ``multiplier``, the sum over a cell's groups.

    ``cells`` has the margins' columns, ``size`` and ``n``, its documents; a margin is
    (column, targets with that column and ``target``). A group with target 0 has
    multiplier minus infinity; groups without words or without a target have 0.
    """
    columns = cells.columns
    state = cut_lineage(cells.withColumn("multiplier", F.lit(0.0)))
    for _ in range(PASSES):
        moved = 0.0
        for column, targets in margins:
            found = _solve(state, column, targets)
            if len(margins) > 1:
                moved = max(moved, found.agg(F.max("error")).first()[0] or 0.0)
            added = found.select(F.col("_group"), F.col("step"))
            joined = state.join(added, state[column].eqNullSafe(added["_group"]), "left")
            state = cut_lineage(joined.select(*columns, (F.col("multiplier") + F.ifnull("step", F.lit(0.0))).alias("multiplier")))
        if len(margins) == 1 or moved <= TOLERANCE:
            break
    return state


def _solve(state: DataFrame, column: str, targets: DataFrame) -> DataFrame:
    """(_group, step, error): the multiplier to add to each group of one margin, the others fixed.

    ``error`` is the relative distance from the target before the step.
    """
    size, n, target = F.col("size"), F.col("n"), F.col("target")

    def summed(term: Column) -> Column:
        return F.sum(term.cast(EXACT)).cast("double")

    def tokens(multiplier: Column) -> tuple[Column, Column]:
        """A group's tokens, and their slope: capped documents do not move."""
        each = size * multiplier
        slope = F.when(each < math.log(MOST), n * size * size * F.exp(each)).otherwise(0.0)
        return summed(n * size * rate(size, multiplier)), summed(slope)

    mass, slope = tokens(F.col("multiplier"))
    wordy = state.filter((size > 0) & (F.col("multiplier") > -math.inf))
    groups = wordy.groupBy(F.col(column).alias("_group")).agg(
        mass.alias("mass"), slope.alias("slope"), F.min("size").alias("least"), F.max("size").alias("most"),
        F.min("multiplier").alias("low"), F.max("multiplier").alias("high"), (summed(n * size) * MOST).alias("all"),
    )
    wanted = targets.select(F.col(column).alias("_wanted"), "target")
    groups = groups.join(wanted, F.col("_group").eqNullSafe(F.col("_wanted"))).drop("_wanted")
    # At these steps every document of the group has at least MOST copies, or at most its share of the target.
    top = math.log(MOST) / F.col("least") - F.col("low")
    floor = F.least(F.log(target / F.col("all")) / F.col("least") - F.col("high"), F.lit(0.0))
    error = F.abs(F.col("mass") - target)
    allowed = F.greatest(target, F.lit(1.0)) * TOLERANCE
    fixed = F.when(target <= 0, F.lit(-math.inf)).when(target >= F.col("all") * (1 - TOLERANCE), F.greatest(top, F.lit(0.0)))
    known = groups.select(
        "_group", "target", (error / F.greatest(target, F.lit(1.0))).alias("error"),
        F.when(F.col("mass") > target, floor).otherwise(0.0).alias("low"),
        F.when(F.col("mass") > target, F.lit(0.0)).otherwise(F.greatest(top, F.lit(0.0))).alias("high"),
        F.ifnull(fixed, F.lit(0.0)).alias("step"), "mass", "slope",
        F.ifnull(fixed.isNotNull() | (error <= allowed), F.lit(True)).alias("done"),
    )
    known = cut_lineage(known)
    for _ in range(ROUNDS):
        if known.filter(~F.col("done")).isEmpty():
            break
        newton = F.col("step") + F.log(target / F.col("mass")) * F.col("mass") / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        # The bounds span orders of magnitude: halve them as powers once they have one sign.
        product = F.col("low") * F.col("high")
        middle = F.when(product > 0, F.signum("low") * F.sqrt(product)).otherwise((F.col("low") + F.col("high")) / 2)
        tried = F.when(F.col("done"), F.col("step")).when(F.ifnull(inside, F.lit(False)), newton).otherwise(middle)
        known = cut_lineage(_tried(wordy, column, known.withColumn("step", tried), tokens))
    return known.select("_group", "step", "error")


def _tried(wordy: DataFrame, column: str, known: DataFrame, tokens: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """``known`` after a trial of its steps; solved groups stay as they are.

    A group's own columns travel through the sum over its cells, so a round is one join and one aggregate.
    """
    group = known.select(F.struct(*known.columns).alias("_known"))
    joined = wordy.join(group, wordy[column].eqNullSafe(F.col("_known._group")))
    now, rise = tokens(F.col("multiplier") + F.when(F.col("_known.done"), 0.0).otherwise(F.col("_known.step")))
    kept = [F.any_value(F.col(f"_known.{c}")).alias(c) for c in known.columns if c != "_group"]
    seen = joined.groupBy(F.col("_known._group").alias("_group")).agg(now.alias("_mass"), rise.alias("_slope"), *kept)
    target, solved = F.col("target"), F.col("done")
    near = F.abs(F.col("_mass") - target) <= F.greatest(target, F.lit(1.0)) * TOLERANCE
    tight = F.abs(F.col("high") - F.col("low")) <= 1e-15 * F.abs(F.col("high"))
    return seen.select(
        "_group", "target", "error",
        F.when(~solved & (F.col("_mass") < target), F.col("step")).otherwise(F.col("low")).alias("low"),
        F.when(~solved & (F.col("_mass") > target), F.col("step")).otherwise(F.col("high")).alias("high"),
        "step",
        F.when(solved, F.col("mass")).otherwise(F.col("_mass")).alias("mass"),
        F.when(solved, F.col("slope")).otherwise(F.col("_slope")).alias("slope"),
        (solved | F.ifnull(near | tight, F.lit(False))).alias("done"),
    )


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sized documents, rule per source) for ``docs(doc_id, source, text)``.

    A rule holds the source's multiplier, the place up to which a document takes one more
    copy, and the places for which that is switched; ``with_copies`` applies it to any row.
    """
    sized = materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    targets = materialize(source_targets(sized), "targets")
    cells = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    solved = balance(cells, [("source", targets)]).filter("size > 0")
    found = solved.groupBy(F.col("source").alias("_source")).agg(F.min("multiplier").alias("multiplier"))
    rules = targets.join(found, targets["source"].eqNullSafe(found["_source"]), "left").select(
        "source", "source_size", "target", F.ifnull("multiplier", F.lit(0.0)).alias("multiplier")
    )
    rules = materialize(rules, "multipliers")
    placed = _placed(sized, rules)
    whole = placed.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("held"))
    # Documents of one source with equal places go together; those without a fraction have none.
    drawn = placed.filter("place is not null").groupBy("source", "place").agg(F.sum("size").alias("size"))
    counted = materialize(running_totals(drawn, ["place"], ["size"], ["source"]).select("source", "place", "size", "size_so_far"), "places")
    missing = rules.join(whole.withColumnRenamed("source", "_held"), F.col("source").eqNullSafe(F.col("_held"))).select(
        F.col("source").alias("_source"), (F.col("target") - F.col("held")).alias("missing")
    )
    missing = cut_lineage(missing)
    with_rule = counted.join(missing, F.col("source").eqNullSafe(F.col("_source")))
    off = F.abs(F.col("size_so_far") - F.col("missing"))
    best = with_rule.groupBy("_source").agg(F.min_by(F.struct("place", "size_so_far", "missing"), F.struct(off, "place")).alias("cut"))
    use = F.abs(F.col("cut.size_so_far") - F.col("cut.missing")) < F.abs(F.col("cut.missing"))
    cuts = best.select(
        F.col("_source"),
        F.when(use, F.col("cut.place")).alias("cut"),
        (F.col("cut.missing") - F.when(use, F.col("cut.size_so_far")).otherwise(0)).alias("off"),
        F.array().cast("array<double>").alias("flips"),
    )
    cuts = cut_lineage(cuts)
    for _ in range(FLIPS):
        cuts = cut_lineage(_flip(counted, cuts))
    chosen = cuts.select("_source", "cut", "flips")
    rules = rules.join(chosen, rules["source"].eqNullSafe(chosen["_source"]), "left").drop("_source")
    return sized, materialize(rules, "rules")


def draw(doc_id: Column) -> Column:
    """A hash of the id between 0 and 1, both left out."""
    return (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("mix")), 11) + 0.5) / float(2**53)


def _placed(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows(doc_id, source, size, ...)`` with ``_rule``, ``rate``, ``whole`` copies and the ``place`` among the source's fractions."""
    rule = rules.select(F.col("source").alias("_source"), F.struct(*[c for c in rules.columns if c != "source"]).alias("_rule"))
    joined = rows.join(rule, rows["source"].eqNullSafe(F.col("_source")), "left").drop("_source")
    joined = joined.withColumn("rate", rate(F.col("size"), F.col("_rule.multiplier")))
    whole = F.least(F.floor(F.col("rate") + 1e-9), F.lit(MOST)).cast("int")
    part, number = F.col("rate") - F.col("whole"), draw(F.col("doc_id"))
    place = number * (1 - part) / (part * (1 - number))
    return joined.withColumn("whole", whole).withColumn("place", F.when((part > 1e-12) & (F.col("size") > 0), place))


def _flip(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """Switch the one place per source that brings its words nearest to the target."""
    rows = counted.join(cuts, counted["source"].eqNullSafe(F.col("_source")))
    extra = F.ifnull(F.col("place") <= F.col("cut"), F.lit(False))
    # A document that takes an extra copy loses it; one that does not gains it.
    change = F.when(extra, -F.col("size")).otherwise(F.col("size"))
    left = F.col("off") - change
    may = ~F.array_contains("flips", F.col("place")) & (F.abs(left) < F.abs(F.col("off")))
    candidate = F.when(may, F.struct("place", left.alias("left")))
    # What a source has so far travels through the aggregate, which saves a join.
    kept = [F.any_value(c).alias(c) for c in ("cut", "off", "flips")]
    best = rows.groupBy("_source").agg(F.min_by(candidate, F.when(may, F.struct(F.abs(left), "place"))).alias("best"), *kept)
    better = F.col("best").isNotNull()
    return best.select(
        "_source",
        "cut",
        F.when(better, F.col("best.left")).otherwise(F.col("off")).alias("off"),
        F.when(better, F.array_append("flips", F.col("best.place"))).otherwise(F.col("flips")).alias("flips"),
    )


def with_copies(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows(doc_id, source, size, ...)`` with ``copies``, ``rate`` and the source's rule columns as ``_rule``."""
    placed = _placed(rows, rules)
    extra = F.ifnull(F.col("place") <= F.col("_rule.cut"), F.lit(False))
    switched = F.ifnull(F.array_contains("_rule.flips", F.col("place")), F.lit(False))
    return placed.withColumn("copies", F.col("whole") + (extra != switched).cast("int"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, rate) for every row of ``docs(doc_id, source, text)``."""
    sized, rules = plan(docs)
    return with_copies(sized, rules).select(
        "doc_id",
        "size",
        F.col("_rule.source_size").alias("source_size"),
        F.col("_rule.target").alias("target"),
        (F.col("copies") * F.col("size")).alias("taken"),
        "rate",
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns."""
    _, rules = plan(docs)
    given = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    counted = with_copies(given, rules).select("_row", "copies")
    return counted.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")
