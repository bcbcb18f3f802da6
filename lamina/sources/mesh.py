"""Meshes: Gmsh 2.2 text to node and element tables, and the solver files made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lamina.checks import require_rules
from lamina.constants import literal_rows
from lamina.durable import materialise
from lamina.operators.lookup import lookup
from lamina.operators.numbering import global_position

# Points per element type.
POINTS = {15: 1, 1: 2, 2: 3, 3: 4, 4: 4, 5: 8, 6: 6, 7: 5, 8: 3, 9: 6, 11: 10}
LINE, TRIANGLE, QUADRILATERAL = 1, 2, 3


def point_count(kind: Column) -> Column:
    """Points of an element type, -1 when unknown."""
    count = F.lit(-1)
    for k, n in POINTS.items():
        count = F.when(kind == k, F.lit(n)).otherwise(count)
    return count


SECTIONS = ("$Nodes", "$EndNodes", "$Elements", "$EndElements")


def parse_mesh(lines: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, elements) of files given as ``(file, line, value)``.

    One aggregate finds the lines of the section tags, one row per file; a line belongs to the
    section whose tags enclose it, its first line being the announced count. The split lines are
    written once; checks and both tables read them from there.
    """
    def place(tag: str) -> Column:
        return F.min(F.when(F.col("value") == tag, F.col("line"))).alias(tag)

    tags = lines.where(F.col("value").startswith("$")).groupBy("file").agg(*[place(t) for t in SECTIONS])
    n0, n1, e0, e1 = (F.col(f"`{t}`") for t in SECTIONS)
    line, fields = F.col("line"), F.split("value", r"\s+")
    in_nodes, in_elements = (line > n0) & (line < n1), (line > e0) & (line < e1)
    start = F.when(in_nodes, n0).when(in_elements, e0)
    # one row per file; a join by file would send all lines of a large file to one task
    inside = materialise(lines.join(F.broadcast(tags), "file").where(in_nodes | in_elements).select(
        "file", in_nodes.alias("_node"), (line - start - 1).alias("_i"), fields.alias("_f"),
        (F.when(in_nodes, n1 - n0).otherwise(e1 - e0) - 2).alias("_size")))

    def number(k: int, kind: str) -> Column:
        return F.get("_f", F.lit(k)).try_cast(kind)

    rows = inside.where("_i > 0")
    nodes = rows.where("_node").select(
        "file", "_i", number(0, "int").alias("id"), *[number(k, "double").alias(n) for k, n in enumerate("xyz", 1)])
    arity = point_count(number(1, "int"))
    points = F.slice(F.transform("_f", lambda t: t.try_cast("int")), F.lit(6), F.greatest(arity, F.lit(0)))
    elements = rows.where("NOT _node").select(
        "file", "_i", *[number(k, "int").alias(n) for k, n in enumerate(("id", "type", "tags", "tag1", "tag2"))],
        F.when(arity > 0, points).alias("nodes"), arity.alias("_arity"))
    if strict:
        require_rules(tags, {f"has {t}": F.col(f"`{t}`").isNotNull() for t in SECTIONS})
        require_rules(inside, {
            "count": (F.col("_i") > 0) | (number(0, "bigint") == F.col("_size")),
            "ids 1..n": (F.col("_i") == 0) | (number(0, "int") == F.col("_i")),
            "coordinates": ~F.col("_node") | (F.col("_i") == 0) | (number(1, "double") + number(2, "double") + number(3, "double")).isNotNull(),
            "element": F.col("_node") | (F.col("_i") == 0) | ((number(2, "int") == 2) & (arity > 0) & (F.size("_f") >= arity + 5)),
        })
    return nodes.drop("_i"), elements.drop("_i", "tags", "_arity")


def faces(elements: DataFrame, kind: int) -> DataFrame:
    """Elements of one type renumbered from 1, with one column per node."""
    picked = global_position(elements.where(F.col("type") == kind), ["id"], "n")
    return picked.select("n", *[F.get("nodes", F.lit(k)).alias(f"node{k + 1}") for k in range(POINTS[kind])])


def boundary(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Line elements with ``fixed``: whether the first end lies on x = +-1 or y = +-1."""
    ends = elements.where(F.col("type") == LINE).select("id", F.get("nodes", F.lit(0)).alias("node1"), F.get("nodes", F.lit(1)).alias("node2"))
    placed = lookup(ends, nodes, {"node1": "id"}, {"x": "_x", "y": "_y"})
    on_edge = (F.abs("_x") == 1.0) | (F.abs("_y") == 1.0)
    return placed.withColumn("fixed", F.coalesce(on_edge, F.lit(False))).drop("_x", "_y")


def boundary_edges(elements: DataFrame, nodes: DataFrame, fixed: bool) -> DataFrame:
    """Fixed (or free) boundary edges renumbered from 1."""
    picked = boundary(elements, nodes).where(F.col("fixed") == fixed)
    return global_position(picked, ["id"], "n").select("n", "node1", "node2")


# Header lines of the solver files.
HEADERS = {
    "coordinates": ["% Input-file for vertices generated from MESH", "% Node-number X Y"],
    "element3": ["% Input-file of triangles generated from MESH file.", "% Element-number / 1-node / 2-node/ 3-node"],
    "element4": ["% Input-file of parallelograms generated from MESH file.", "% Element-number / 1-node / 2-node/ 3-node / 4-node"],
    "dirichlet": ["% Input-file for Dirichlet BC generated from MESH.", "% Dirichlet-Edge-count / 1-Node / 2-Node"],
    "neumann": ["% Input-file for Neumann BC generated from MESH.", "% Neumann-Edge-count / 1-Node / 2-Node"],
}


def solver_tables(nodes: DataFrame, elements: DataFrame) -> dict[str, DataFrame]:
    """The five solver tables, each led by its row number."""
    return {
        "coordinates": nodes.select(F.col("id").alias("n"), "x", "y"),
        "element3": faces(elements, TRIANGLE),
        "element4": faces(elements, QUADRILATERAL),
        "dirichlet": boundary_edges(elements, nodes, True),
        "neumann": boundary_edges(elements, nodes, False),
    }


def solver_lines(name: str, table: DataFrame) -> DataFrame:
    """Numbered text lines of one solver file, headers first."""
    text = F.concat_ws("\t", *[F.col(c).cast("string") for c in table.columns])
    body = table.select((F.col("n") + len(HEADERS[name])).cast("bigint").alias("line"), text.alias("value"))
    head = literal_rows(table.sparkSession, [(k, h) for k, h in enumerate(HEADERS[name], 1)], "line bigint, value string")
    return head.unionByName(body)
