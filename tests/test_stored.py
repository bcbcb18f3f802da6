"""Stored structures: versioned tables, box index, growing dictionary; lattices and exact interval ends."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.functions.scalars import general_text
from lamina.operators import arrays, lookup, numbering, spatial_index
from lamina.sources import ordered_text, tables
from tests.conftest import rows

BOX = "id bigint, xmin double, ymin double, xmax double, ymax double"


def test_failed_job_leaves_the_published_table(spark, tmp_path):
    base = f"file://{tmp_path}"
    tables.publish(spark.range(5).toDF("k"), base, "t")
    broken = tables.read_published(spark, base, "t").select(F.when(F.col("k") < 3, F.col("k")).otherwise(F.raise_error(F.lit("midway"))).alias("k"))
    with pytest.raises(Exception, match="midway"):
        tables.publish(broken, base, "t")
    assert rows(tables.read_published(spark, base, "t")) == [(k,) for k in range(5)]
    before = tables.read_published(spark, base, "t")
    tables.publish(before.where("k > 2"), base, "t")
    assert rows(before) == [(k,) for k in range(5)] and rows(tables.read_published(spark, base, "t")) == [(3,), (4,)]


def scanned(df):
    """Files and rows that the scan of the stored boxes read."""
    df.collect()
    metrics, nodes = {}, [df._jdf.queryExecution().executedPlan().executedPlan()]
    while nodes:
        node = nodes.pop()
        for get in ("plan", "executedPlan"):
            if node.getClass().getSimpleName().endswith(("QueryStageExec", "AdaptiveSparkPlanExec")) and hasattr(node, get):
                try:
                    nodes.append(getattr(node, get)())
                    break
                except Exception:  # not every node has both
                    continue
        if node.getClass().getSimpleName() == "FileSourceScanExec" and "leaf" in node.output().toString():
            for name in ("numFiles", "numOutputRows"):
                metrics[name] = max(metrics.get(name, 0), node.metrics().apply(name).value())
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return metrics


def test_index_reads_what_a_window_needs(spark, tmp_path):
    r = random.Random(8)
    boxes = [(k, x, y, x + r.uniform(0, 4), y + r.uniform(0, 4)) for k in range(3000) for x, y in [(r.uniform(0, 1000), r.choice([r.uniform(0, 1000), 500.0]))]]
    boxes += [(9000, 0.0, 0.0, 1000.0, 1000.0), (9001, None, 0.0, 1.0, 1.0)]
    path = str(tmp_path / "index")
    spatial_index.write_index(spark.createDataFrame(boxes, BOX), "id", path, leaf_rows=50, part_leaves=1)
    windows = [(1, 100.0, 100.0, 120.0, 130.0), (2, 990.0, 480.0, 1010.0, 510.0), (3, -50.0, -50.0, -10.0, -10.0), (4, None, 0.0, 1.0, 1.0)]
    found = spatial_index.search_index(spark, path, spark.createDataFrame(windows, BOX.replace("id", "w", 1)), "w", ["id"])
    want = [(b[0], w[0]) for b in boxes for w in windows if None not in (b + w) and b[1] <= w[3] and w[1] <= b[3] and b[2] <= w[4] and w[2] <= b[4]]
    assert rows(found, "id", "w") == sorted(want)
    parts = spark.read.parquet(f"{path}/nodes").select("part").distinct().count()
    read = scanned(found)
    assert read["numFiles"] <= parts / 3 and read["numOutputRows"] < len(boxes) / 3


def test_lattice_against_expansion(spark):
    r = random.Random(9)
    step = lambda: r.choice([0.0, 1.0, -1.0, 0.1, -2.5, 3.3])
    data = [(k, x, y, x + r.choice([0.0, 0.5, 2.0]), y + 1.0, r.randrange(1, 6), r.randrange(1, 5), step(), step()) for k in range(120) for x, y in [(r.randrange(20) / 2, r.randrange(20) / 2)]]
    windows = [(k, x, y, x + r.choice([0.0, 0.3, 3.0]), y + 2.0) for k in range(12) for x, y in [(r.randrange(30) / 2 - 3, r.randrange(30) / 2 - 3)]]
    placed = spark.createDataFrame(data, BOX + ", Columns bigint, Rows bigint, DX double, DY double")
    hits = arrays.array_hits(placed, spark.createDataFrame(windows, BOX.replace("id", "w", 1)), "id", "w")
    want = [(a[0], w[0], c, d) for a in data for w in windows for c in range(a[5]) for d in range(a[6])
            if a[1] + c * a[7] <= w[3] and w[1] <= a[3] + c * a[7] and a[2] + d * a[8] <= w[4] and w[2] <= a[4] + d * a[8]]
    assert rows(arrays.expand_hits(hits), "id", "w", "column", "row") == sorted(want)


def test_dictionary_grows_as_one_batch_would(spark):
    r = random.Random(10)
    data = [(k, r.choice("abcdefghijklmnop")) for k in range(60)] + [(60, None)]
    df = spark.createDataFrame(data, "ord int, v string")
    known = df.select("v", F.lit(0).cast("bigint").alias("id")).limit(0)
    for low, high in ((0, 7), (7, 8), (8, 61)):
        known = numbering.grow_dictionary(known, df.where(F.col("ord").between(low, high - 1)), "v", ["ord"])
    assert rows(known) == rows(numbering.dictionary_encode(df.where("v IS NOT NULL"), "v", ["ord"]))


@pytest.mark.parametrize("limit", [0, 1000])
def test_interval_ends_beyond_double_precision(spark, limit):
    big = 9007199254740992
    values = spark.createDataFrame([(big,), (big + 1,), (big + 2,)], "z bigint")
    table = spark.createDataFrame([(1, big + 1, big + 2, "a")], "ord int, lo bigint, hi bigint, n string")
    got = lookup.interval_lookup(values, "z", table, "lo", "hi", "n", "ord", "name", literal_limit=limit)
    assert sorted(got.collect()) == [(big, None), (big + 1, "a"), (big + 2, None)]


def test_general_text_in_scientific_form(spark):
    df = spark.createDataFrame([(1e20,), (2.5e-7,), (1.25e15,), (3.0,)], "v double")
    assert [x[0] for x in df.select(general_text(F.col("v"))).collect()] == ["1e+20", "2.5e-07", "1.25e+15", "3"]


def test_ordered_text_parts_join_to_the_file(spark, tmp_path):
    r = random.Random(5)
    lines = [(k, "x" * r.randrange(40) + "é" * (k % 3) if k % 50 else "") for k in range(900)]
    path = f"{tmp_path}/text"
    df = spark.createDataFrame(r.sample(lines, len(lines)), "k int, value string").repartition(5)
    ordered_text.write_ordered(df, path, ["k"], parts=4)
    listed = ordered_text.manifest(path)
    whole = "".join(f"{v}\n" for _, v in lines).encode()
    data = b"".join((tmp_path / "text" / p["name"]).read_bytes() for p in listed["parts"])
    assert data == whole and listed["size"] == len(whole) and listed["lines"] == 900 and len(listed["parts"]) > 1
    for p in listed["parts"]:
        assert whole[p["offset"]:p["offset"] + p["size"]] == (tmp_path / "text" / p["name"]).read_bytes()
        assert whole[:p["offset"]].count(b"\n") == p["first_line"] - 1
    assert rows(ordered_text.read_ordered(spark, path), "line", "value") == [(k + 1, v) for k, v in lines]


def test_ordered_text_of_nothing_and_failing_writes(spark, tmp_path):
    ordered_text.write_ordered(spark.createDataFrame([], "k int, value string"), f"{tmp_path}/none", ["k"])
    assert ordered_text.read_ordered(spark, f"{tmp_path}/none").collect() == []
    bad = spark.range(50).select(F.col("id").alias("k"), F.when(F.col("id") < 40, "x").otherwise(F.raise_error(F.lit("midway")).cast("string")).alias("value"))
    with pytest.raises(Exception, match="midway"):
        ordered_text.write_ordered(bad, f"{tmp_path}/bad", ["k"], parts=2)
    assert not (tmp_path / "bad" / ordered_text.MANIFEST).exists()


def test_ordered_text_works_out_each_line_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        calls.add(1)
        return f"line {n}"

    lines = spark.range(40).select(F.col("id").alias("at"), text("id").alias("value"))
    ordered_text.write_ordered(lines, f"{tmp_path}/text", ["at"])
    assert calls.value == 40
    assert sorted(map(tuple, ordered_text.read_ordered(spark, f"{tmp_path}/text").collect())) == [(n + 1, f"line {n}") for n in range(40)]
