"""Cell hierarchies: distinct edges, topological numbering and children lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamina.checks import StrictModeError, require_none
from lamina.durable import materialise, materialise_counted
from lamina.operators.grouping import as_array, first_seen_distinct
from lamina.operators.lookup import lookup
from lamina.operators.numbering import global_position


def union_distinct(df: DataFrame, first: str, second: str, name: str = "name") -> DataFrame:
    """Distinct values of two columns together."""
    return df.select(F.col(first).alias(name)).unionByName(df.select(F.col(second).alias(name))).distinct()


def edges(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Distinct (parent, child) pairs."""
    return df.select(F.col(parent).alias("parent"), F.col(child).alias("child")).distinct()


def top_cells(df: DataFrame, cells: DataFrame, cell: str, child: str) -> DataFrame:
    """Cells that no other cell refers to."""
    return cells.select(cell).distinct().join(df.select(F.col(child).alias(cell)), cell, "left_anti")


def first_top_shapes(shapes: DataFrame, df: DataFrame, cells: DataFrame, order_by: str) -> DataFrame:
    """Shapes of the first top cell in the given order of ``cells``."""
    tops = cells.join(df.select(F.col("RefCellName").alias("CellName")), "CellName", "left_anti")
    return shapes.join(tops.orderBy(order_by).limit(1).select("CellName"), "CellName", "left_semi")


def topological_levels(pairs: DataFrame) -> DataFrame:
    """Level of every node: leaves are 0, others one above their highest child: ``(name, level)``.

    Nodes are peeled bottom-up. Each round joins the edges that are still open with the nodes just
    finished, counts per parent the children still missing, and writes what is left; the number of
    rounds is the depth of the hierarchy. A round that finishes nothing while edges are open means
    a cycle.
    """
    open_edges = materialise(pairs)
    # the children of the first round: leaves are nodes that are nobody's parent
    sides = open_edges.select(F.explode(F.array(
        F.struct(F.col("parent").alias("name"), F.lit(1).alias("is_parent")), F.struct(F.col("child").alias("name"), F.lit(0).alias("is_parent")))).alias("s"))
    leaves = sides.groupBy("s.name").agg(F.max("s.is_parent").alias("is_parent")).where("is_parent = 0").select("name")
    finished = materialise(leaves)
    done = finished.withColumn("level", F.lit(0))
    level = 0
    while True:
        level += 1
        hits = finished.select(F.col("name").alias("child"), F.lit(True).alias("_hit"))
        joined = open_edges.join(hits, "child", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        tagged, edges_left = materialise_counted(joined, open=~F.col("_hit"))
        ready = tagged.groupBy(F.col("parent").alias("name")).agg(F.count_if(~F.col("_hit")).alias("_missing"))
        finished, nodes = materialise_counted(ready.where("_missing = 0").select("name"))
        if nodes["rows"]:
            done = done.unionByName(finished.withColumn("level", F.lit(level)))
        elif edges_left["open"]:
            raise StrictModeError("the hierarchy has a cycle; no topological order exists")
        if not edges_left["open"]:
            return done
        open_edges = tagged.where(~F.col("_hit")).drop("_hit")


def topological_numbers(pairs: DataFrame) -> DataFrame:
    """``(name, level, number)`` with numbers 1..n such that children come before parents.

    Any such numbering serves; this one orders by level, then by name.
    """
    return global_position(topological_levels(pairs), ["level", "name"], "number")


def ordering_violations(pairs: DataFrame, numbers: DataFrame) -> DataFrame:
    """Edges whose child is not numbered below its parent."""
    named = {"number": "child_number"}, {"number": "parent_number"}
    with_child = lookup(pairs, numbers, {"child": "name"}, named[0])
    return lookup(with_child, numbers, {"parent": "name"}, named[1]).where("child_number >= parent_number")


def number_instances(df: DataFrame, numbers: DataFrame, parent: str = "CellName", child: str = "RefCellName",
                     strict: bool = False) -> DataFrame:
    """Add ``CellNumber`` and ``RefCellNumber`` to instances."""
    numbered = lookup(df, numbers, {parent: "name"}, {"number": "CellNumber"}, strict)
    return lookup(numbered, numbers, {child: "name"}, {"number": "RefCellNumber"}, strict)


def child_rows(numbered: DataFrame, order_by: list[str], parent: str = "CellName") -> DataFrame:
    """Distinct children of each parent with their first place, one row per (parent, child)."""
    return first_seen_distinct(numbered, [parent], "RefCellNumber", order_by, "first_seen")


def parent_child(numbered: DataFrame, numbers: DataFrame, order_by: list[str], parent: str = "CellName") -> DataFrame:
    """The ``parentchild`` table: every node with its children in first-seen order, leaves with none."""
    seen = materialise(child_rows(numbered, order_by, parent))
    children = as_array(seen, [parent], "RefCellNumber", "first_seen", "ChildrenNum")
    nodes = numbers.select(F.col("name").alias("CellName"), F.col("number").alias("CellNumber"))
    joined = nodes.join(children.withColumnRenamed(parent, "_parent"), F.col("CellName") == F.col("_parent"), "left")
    return joined.select("CellName", F.coalesce("ChildrenNum", F.array().cast("array<bigint>")).alias("ChildrenNum"), "CellNumber")


def analyse_hierarchy(df: DataFrame, order_by: list[str], parent: str = "CellName", child: str = "RefCellName",
                      strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbers, numbered instances, parentchild table) of an instance table."""
    pairs = edges(df, parent, child)
    numbers = materialise(topological_numbers(pairs))
    if strict:
        require_none(ordering_violations(pairs, numbers), "child numbered after its parent")
    numbered = number_instances(df, numbers, parent, child)
    return numbers, numbered, parent_child(numbered, numbers, order_by, parent)
