"""Sharding by a minimax contiguous partition.

Documents with equal texts are one atomic group. Groups are laid out in the order of
their key (a digest of the text) and cut into at most ``n`` runs so that the largest
run is as small as it can be: a binary search finds the smallest capacity for which
filling shards greedily, one group after the other, needs no more than ``n``.

A greedy check needs, for each of the n cuts, the last group that ends within the
capacity. All groups stay in a Spark table with their running size. The driver holds
a summary: the running size at every ``FAN``-th part of the order. Where a cut falls
inside a part, the check answers from both ends of the part; only if the two answers
differ are those parts read again, each as ``FAN`` smaller parts, down to single
groups. So the driver never holds more than ``FAN`` numbers per part that a cut needs.

A group as large as the least capacity has a shard of its own. The runs before and after
it are cut again by the same search, each with as many of the other shards as make the
larger of both capacities smallest. Shards that are still empty halve the largest runs.

A document's shard follows from its key and the n - 1 cut keys, without a join. Its
slot is its place among the rows of the shard, from running totals.

Defined cases: null text is a group of its own with size 1 and checksum 0; repeated
rows are rows of one group; an empty table has no shards; of fewer groups than shards
each has a shard of its own.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import running_totals
from ledgerloom.session import materialize

SHARDS, FAN, LAW = 16, 1024, "bytes"
NULL_KEY = ""


def text_key(text: Column) -> Column:
    """Digest that equal texts share; null before all others."""
    return F.ifnull(F.md5(text), F.lit(NULL_KEY))


def text_size(text: Column) -> Column:
    return F.ifnull(F.octet_length(text), F.lit(0)).cast("long") + 1


@dataclass
class Part:
    """Groups ``low`` (exclusive) to ``high`` (inclusive) of the order and the running sizes there."""

    low: int
    high: int
    before: int
    end: int

    @property
    def whole(self) -> bool:
        return self.high - self.low <= 1


class Outline:
    """Running sizes of ``groups(place, so_far)``, known as finely as the search needs."""

    def __init__(self, groups: DataFrame) -> None:
        self.groups = groups
        most = F.max(F.struct("size", "place"))
        count, total, most = groups.agg(F.ifnull(F.max("place"), F.lit(0)), F.ifnull(F.max("so_far"), F.lit(0)), most).first()
        self.count, self.total = int(count), int(total)
        #: Size and place of the largest group.
        self.largest, self.at = (int(most["size"]), int(most["place"])) if most else (0, 0)
        self.answers: dict[int, tuple[int, list[int]]] = {}
        self.parts = [Part(0, self.count, 0, self.total)] if self.count else []
        if self.parts:
            self.refine(self.parts)

    def refine(self, parts: list[Part]) -> None:
        """Replace each part by at most ``FAN`` parts of equal length."""
        condition, step_of = F.lit(False), F.lit(1)
        for p in parts:
            inside = (F.col("place") > p.low) & (F.col("place") <= p.high)
            condition = condition | inside
            step_of = F.when(inside, F.lit(-(-(p.high - p.low) // FAN))).otherwise(step_of)
        low_of = F.lit(0)
        for p in parts:
            low_of = F.when((F.col("place") > p.low) & (F.col("place") <= p.high), F.lit(p.low)).otherwise(low_of)
        cut = F.floor((F.col("place") - low_of - 1) / step_of)
        ends = (
            self.groups.filter(condition)
            .groupBy(low_of.alias("low"), cut.alias("cut"))
            .agg(F.max("place").alias("place"), F.max("so_far").alias("so_far"))
            .collect()
        )
        found: dict[int, list[tuple[int, int]]] = {}
        for row in ends:
            found.setdefault(int(row["low"]), []).append((int(row["place"]), int(row["so_far"])))
        finer = [p for p in self.parts if p.low not in {x.low for x in parts}]
        for p in parts:
            low, before = p.low, p.before
            for place, end in sorted(found[p.low]):
                finer.append(Part(low, place, before, end))
                low, before = place, end
        self.parts = sorted(finer, key=lambda p: p.low)

    def walk(self, capacity: int, shards: int, hopeful: bool) -> tuple[bool, list[Part], list[int]]:
        """Does greedy filling fit? Parts that a cut falls into, and the places of the cuts.

        ``hopeful`` takes a cut inside a part to leave nothing unused, otherwise the cut
        moves back to the part's start.
        """
        ends = [p.end for p in self.parts]
        at, unsure, cuts = 0, [], []
        for _ in range(shards):
            reach = at + capacity
            if reach >= self.total:
                return True, unsure, cuts
            i = bisect.bisect_right(ends, reach)
            part = self.parts[i]
            if part.whole or reach == part.before:
                at = part.before
            else:
                unsure.append(part)
                at = reach if hopeful else part.before
            cuts.append(part.low)
        return False, unsure, cuts

    def smallest_capacity(self, shards: int) -> tuple[int, list[int]]:
        """The least feasible capacity and the last places of all shards but the last."""
        if shards in self.answers:
            return self.answers[shards]
        low, high = max(1, self.largest, -(-self.total // shards)), self.total
        while low < high:
            middle = (low + high) // 2
            fits = self.fits(middle, shards)
            low, high = (low, middle) if fits else (middle + 1, high)
        self.fits(low, shards, exact=True)
        self.answers[shards] = low, self.walk(low, shards, False)[2]
        return self.answers[shards]

    def fits(self, capacity: int, shards: int, exact: bool = False) -> bool:
        while True:
            sure, unsure, _ = self.walk(capacity, shards, False)
            hope, other, _ = self.walk(capacity, shards, True)
            if (sure == hope and not exact) or not (unsure or other):
                return sure
            self.refine(list({p.low: p for p in unsure + other}.values()))


def between(groups: DataFrame, low: int, high: int) -> DataFrame:
    """Groups ``low`` (exclusive) to ``high`` (inclusive), counted and summed from there on."""
    inside = groups.filter((F.col("place") > low) & (F.col("place") <= high))
    before = groups.filter(F.col("place") == low).select("so_far").first() if low else None
    so_far = F.col("so_far") - F.lit(int(before[0]) if before else 0)
    return inside.select("size", (F.col("place") - low).alias("place"), so_far.alias("so_far"))


def cut_places(groups: DataFrame, outline: Outline, shards: int) -> list[int]:
    """Last places of all runs but the last: none above the least capacity, the others as even as the largest groups let them be."""
    if shards == 1 or outline.count <= 1:
        return []
    capacity, places = outline.smallest_capacity(shards)
    if capacity > outline.largest:
        return places
    before, after = outline.at - 1, outline.count - outline.at
    left, right = between(groups, 0, before), between(groups, outline.at, outline.count)
    # A run of no groups takes no shard.
    sides = Outline(left), Outline(right)
    own = _share(*sides, shards - 1) if before and after else (shards - 1) * bool(before)
    first = [*cut_places(left, sides[0], own), before] if before else []
    second = [outline.at, *(outline.at + p for p in cut_places(right, sides[1], shards - 1 - own))] if after else []
    return first + second


def _share(left: Outline, right: Outline, shards: int) -> int:
    """How many of the shards the left run takes so that the larger of both capacities is smallest."""
    low, high = 1, shards - 1
    while low < high:
        middle = (low + high) // 2
        enough = left.smallest_capacity(middle)[0] <= right.smallest_capacity(shards - middle)[0]
        low, high = (low, middle) if enough else (middle + 1, high)
    worst = {k: max(left.smallest_capacity(k)[0], right.smallest_capacity(shards - k)[0]) for k in (max(1, low - 1), low)}
    best = min(worst, key=lambda k: (worst[k], k))
    # No run takes more shards than it has groups while the other can fill them.
    return min(left.count, max(best, shards - right.count))


def fill_empty(groups: DataFrame, cuts: list[int], count: int, shards: int) -> list[int]:
    """Cuts as they are, and further ones that halve the largest run of several groups until no shard is empty."""
    while len(cuts) + 1 < min(shards, count):
        ends = {int(r["place"]): int(r["so_far"]) for r in groups.filter(F.col("place").isin([*cuts, count])).collect()}
        runs = [(ends[b] - ends.get(a, 0), a, b) for a, b in zip([0, *cuts], [*cuts, count]) if b - a > 1]
        _, low, high = max(runs)
        part = between(groups, low, high)
        # Two shards of a run of several groups are both filled.
        cuts = sorted([*cuts, low + Outline(part).smallest_capacity(2)[1][0]])
    return cuts


def cut_keys(groups: DataFrame, shards: int) -> list[str]:
    """Last keys of all shards but the last, for ``groups(key, size, place, so_far)``."""
    outline = Outline(groups)
    if not outline.count:
        return []
    places = fill_empty(groups, cut_places(groups, outline, shards), outline.count, shards)
    rows = groups.filter(F.col("place").isin(places)).select("place", "key").collect()
    return [r["key"] for r in sorted(rows, key=lambda r: r["place"])]


def shard_of(key: Column, cuts: list[str]) -> Column:
    """How many cut keys lie before ``key``."""
    return sum((key > F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)


def measured(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        "doc_id",
        text_size(text).alias("size"),
        F.ifnull(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        text_key(text).alias("key"),
    )


def _laid_out(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows per key and id in order, with running totals; the measured rows; the cut keys."""
    rows = materialize(measured(docs), "measured")
    per_id = rows.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"))
    ordered = materialize(running_totals(per_id, ["key", "doc_id"], ["rows", "size"]).drop("rows_total", "size_total"), "ordered")
    per_key = ordered.groupBy("key").agg(F.max("size_so_far").alias("so_far"), F.sum("size").alias("size"))
    one = per_key.withColumn("one", F.lit(1))
    groups = materialize(running_totals(one, ["key"], ["one"]).select("key", "size", "so_far", F.col("one_so_far").alias("place")), "groups")
    return ordered, rows, cut_keys(groups, shards)


def _with_slots(rows: DataFrame, ordered: DataFrame, cuts: list[str]) -> DataFrame:
    """``rows`` (with ``key`` and ``doc_id``) and their ``shard`` and gapless ``slot``."""
    shard = shard_of(F.col("key"), cuts).cast("int")
    marked = ordered.withColumn("shard", shard)
    first = marked.groupBy("shard").agg(F.min(F.col("rows_so_far") - F.col("rows")).alias("first"))
    # One row per shard.
    placed = marked.join(F.broadcast(first), "shard").select(
        _row_key().alias("_at"), "shard", (F.col("rows_so_far") - F.col("rows") - F.col("first")).alias("_slot")
    )
    # Rows that repeat an id and a text take the following slots; the join has dealt them alike.
    again = F.row_number().over(Window.partitionBy("_at").orderBy("_slot"))
    joined = rows.withColumn("_at", _row_key()).join(placed, "_at")
    return joined.withColumn("slot", F.col("_slot") + again - 1).drop("_at", "_slot")


def _row_key() -> Column:
    """One text per key and id; a null id has no text."""
    return F.concat_ws(":", "key", F.col("doc_id").cast("string"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs(doc_id, text)``."""
    ordered, rows, cuts = _laid_out(docs, shards)
    return _with_slots(rows, ordered, cuts).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with all its columns and those of ``assign``."""
    ordered, _, cuts = _laid_out(docs, shards)
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    if clash := set(added + ["key"]) & set(docs.columns):
        raise ValueError(f"columns already there: {sorted(clash)}")
    text = F.col("text")
    rows = docs.select(
        "*",
        text_size(text).alias("size"),
        F.ifnull(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        text_key(text).alias("key"),
    )
    return _with_slots(rows, ordered, cuts).select(
        *docs.columns,
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
