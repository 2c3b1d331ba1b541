"""What each filter of a set removes, alone and behind every order of the others.

A document's failures are a mask with one bit a filter. Documents of one part that share
mask and label flags are one cell, so at most ``2**filters * 4`` cells a part are left of
any number of documents. Each cell folds across the array of all filter orders (a
constant of the plan): ``transform`` over the orders, ``aggregate`` along each order with
the state "not removed yet". That gives one weighted struct for each order and step (600
for five filters), and the cells of a part are merged by elementwise sums. No frame is
multiplied by the orders before it has shrunk to one row a part.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlake.session import pinned

WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(text: Column) -> dict[str, Column]:
    """Conditions that one text decides: too short, repetitive, shouting, marked up."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def document_cells(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """(part, mask, good, toxic, n): documents by failures and label flags.

    Bits 0 to 4 of ``mask`` stand for the filters A to E; E fails where a smaller id has
    the same whole text anywhere in the table, taken by its SHA-256. Rows shrink to
    (digest, id, part, mask) before anything is joined, and the joins are on the id, so
    that thousands of copies of a text do not meet in one task. A null text is empty, a
    null part is the empty string, a repeated row counts each time. A row without an id
    has no smaller id and no label: it never fails E. Several labels of an id count as
    one that holds if any does. Extra columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(own_failures(body).values())]
    rows = documents.select(
        F.col(key).cast("long").alias("id"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        reduce(Column.bitwiseOR, bits).alias("own"),
    )
    rows = pinned(rows.groupBy("id", "digest", "part", "own").agg(F.count("*").alias("n")))
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"))
    first = first.withColumn("first", F.lit(True))
    flags = (
        labels.select(F.col(key).cast("long").alias("id"), "quality", "toxic")
        .where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    )
    known = (
        rows.where("id IS NOT NULL")
        .join(flags, "id", "left")
        .join(first, ["id", "digest"], "left")
        .select(
            "part",
            F.col("own").bitwiseOR(F.when(F.col("first"), 0).otherwise(16)).alias("mask"),
            F.coalesce("good", F.lit(0)).alias("good"),
            F.coalesce("bad", F.lit(0)).alias("toxic"),
            "n",
        )
    )
    nameless = rows.where("id IS NULL").select(
        "part", F.col("own").alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n"
    )
    return known.unionByName(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def order_array(filters: str) -> Column:
    """All orders of the filters, each an array of mask bits; a constant of the plan."""
    bit = {name: 1 << i for i, name in enumerate(filters)}
    return F.array(*[F.array(*[F.lit(bit[f]) for f in order]) for order in permutations(filters)])


def zero() -> Column:
    return F.lit(0).cast("long")


def step_of(cell: Column, bit: Column, alive: Column) -> Column:
    """What one cell adds at one step: its rows, each under the counts it belongs to."""
    fails = cell["mask"].bitwiseAND(bit) != 0
    gone = alive & fails

    def weigh(holds: Column) -> Column:
        return F.when(holds, cell["n"]).otherwise(zero())

    return F.struct(
        weigh(alive & ~fails).alias("kept"),
        weigh(gone).alias("removed"),
        weigh(~alive & fails).alias("redundant"),
        weigh(cell["mask"] == bit).alias("unique_fails"),
        weigh(gone & (cell["good"] == 1)).alias("good_lost"),
        weigh(gone & (cell["toxic"] == 1)).alias("toxic_lost"),
    )


STEP = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def fold(cell: Column, orders: Column) -> Column:
    """Structs of every step of every order, in order: the cell walked through each."""

    def along(order: Column) -> Column:
        start = F.struct(F.lit(True).alias("alive"), F.array().cast(f"array<{STEP}>").alias("steps"))

        def walk(state: Column, bit: Column) -> Column:
            alive = state["alive"]
            return F.struct(
                (alive & (cell["mask"].bitwiseAND(bit) == 0)).alias("alive"),
                F.concat(state["steps"], F.array(step_of(cell, bit, alive))).alias("steps"),
            )

        return F.aggregate(order, start, walk, lambda state: state["steps"])

    return F.flatten(F.transform(orders, along))


def merged(left: Column, right: Column) -> Column:
    return F.zip_with(
        left, right, lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    )


def audit_cells(cells: DataFrame, filters: str) -> DataFrame:
    """(part, filter_order, step, counts, shapley): all orders of the filters over cells.

    ``cells`` has (part, mask, good, toxic, n); the part's cells meet in one array, which
    the masks bound. No cells, no rows; a filter that nothing fails has zeros.
    """
    many = len(filters)
    names = ["".join(order) for order in permutations(filters)]
    orders = order_array(filters)
    nothing = F.array_repeat(F.struct(*[zero().alias(c) for c in COUNTS]), len(names) * many)
    sums = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    sums = sums.select(
        "part", F.aggregate("cells", nothing, lambda total, cell: merged(total, fold(cell, orders))).alias("steps")
    )

    def removed_by(name: str) -> Column:
        at = F.lit([many * i + order.index(name) for i, order in enumerate(names)])
        return F.aggregate(at, zero(), lambda total, i: total + F.get(F.col("steps"), i)["removed"])

    rows = sums.select("part", F.array(*map(removed_by, filters)).alias("shares"), F.posexplode("steps").alias("at", "s"))
    rows = rows.withColumn("filter_order", F.get(F.lit(names), (F.col("at") / many).cast("int")))
    rows = rows.withColumn("step", (F.col("at") % many + 1).cast("int"))
    filter_at = F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1)))
    return rows.select(
        "part", "filter_order", "step", *[F.col(f"s.{c}").alias(c) for c in COUNTS],
        F.element_at("shares", filter_at).alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of the five filters A to E over whole texts, by part; cases as in ``document_cells``."""
    return audit_cells(document_cells(documents, labels, key, text, part), "ABCDE")
