"""Numbering against plain Python, with hot groups and many ties."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.checks import StrictModeError
from lamina.operators import numbering
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows, a third of them in one group."""
    rng = random.Random(7)
    data = [("hot" if k % 3 == 0 else f"g{rng.randrange(40)}", rng.randrange(100), k) for k in range(3000)]
    return spark.createDataFrame(data, "g string, v bigint, ord bigint").repartition(7), data


def expected_inum(data):
    seen, out = {}, []
    for g, v, ord_ in sorted(data, key=lambda r: r[2]):
        seen[g] = seen.get(g, 0) + 1
        out.append((g, ord_, seen[g]))
    return sorted(out)


def test_global_position_is_dense_and_ordered(spark, skewed):
    df, data = skewed
    got = rows(numbering.global_position(df, ["v", "ord"], "p"), "p", "v", "ord")
    assert got == [(k, v, o) for k, (v, o) in enumerate(sorted((v, o) for _, v, o in data), 1)]


def test_position_in_group_of_light_and_hot_groups(spark, skewed):
    df, data = skewed
    got = rows(numbering.position_in_group(df, ["g"], ["ord"], "inum"), "g", "ord", "inum")
    assert got == expected_inum(data)


def test_running_total(spark, skewed):
    df, data = skewed
    got = {o: t for o, t in rows(numbering.running_total(df, "v", ["ord"], "t"), "ord", "t")}
    total = 0
    for _, v, o in sorted(data, key=lambda r: r[2]):
        assert got[o] == total
        total += v


def test_running_total_by_group(spark, skewed):
    df, data = skewed
    got = {o: t for o, t in rows(numbering.running_total(df, "v", ["ord"], "t", ["g"]), "ord", "t")}
    totals = {}
    for g, v, o in sorted(data, key=lambda r: r[2]):
        assert got[o] == totals.get(g, 0)
        totals[g] = totals.get(g, 0) + v


def test_dictionary_is_a_bijection_in_first_seen_order(spark, skewed):
    df, data = skewed
    got = rows(numbering.dictionary_encode(df, "g", ["ord"]), "id", "g")
    first = list(dict.fromkeys(g for g, _, _ in sorted(data, key=lambda r: r[2])))
    assert got == [(k, g) for k, g in enumerate(first, 1)]


def test_permutation_check(spark):
    ok = spark.range(1, 11).withColumnRenamed("id", "n")
    assert numbering.require_permutation(ok, "n").count() == 10
    for broken in (ok.where("n <> 4"), ok.union(ok.limit(1)), ok.select((F.col("n") + 1).alias("n"))):
        with pytest.raises(StrictModeError):
            numbering.require_permutation(broken, "n")


def test_empty_input(spark):
    empty = spark.createDataFrame([], "g string, v bigint, ord bigint")
    assert numbering.global_position(empty, ["ord"]).count() == 0
    assert numbering.position_in_group(empty, ["g"], ["ord"]).count() == 0


def test_few_groups_do_not_gather_the_table(spark, skewed):
    df, data = skewed
    numbered = numbering.position_in_group(df, ["g"], ["ord"])
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert rows(numbered, "g", "ord", "inum") == sorted(expected_inum(data))
