import random

import pytest

from lamina.checks import StrictModeError, require_columns
from lamina.operators import lookup
from tests.conftest import rows

DIELECTRICS = [("FOX", 0.0, 120.0), ("PSG", 120.0, 936.1), ("NILD2", 936.1, 1376.1), ("NILD3", 1376.1, 2006.1), ("NILD4", 2006.1, 2786.1),
               ("NILD5", 2786.1, 4021.1), ("NILD6", 4021.1, 5371.1), ("PI1", 5371.1, 11883.4)]


@pytest.fixture(scope="module")
def layers(spark):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(DIELECTRICS)], "ord int, name string, zmin double, zmax double")


@pytest.mark.parametrize("limit", [1000, 3])
def test_interval_lookup(spark, layers, limit):
    z = spark.createDataFrame([(0.0,), (120.0,), (500.0,), (3000.0,), (5500.0,), (12000.0,), (None,), (500.0,)], "z double")
    got = lookup.interval_lookup(z, "z", layers, "zmin", "zmax", "name", "ord", "name", literal_limit=limit).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, [
        (0.0, "FOX"), (120.0, "PSG"), (500.0, "PSG"), (3000.0, "NILD5"), (5500.0, "PI1"), (12000.0, None), (None, None), (500.0, "PSG")]))


@pytest.mark.parametrize("limit", [1000, 1])
def test_first_of_overlapping_intervals(spark, limit):
    dim = spark.createDataFrame([(1, "a", 0.0, 10.0), (2, "b", 5.0, 15.0), (3, "c", 2.0, 3.0)], "ord int, name string, lo double, hi double")
    z = spark.createDataFrame([(2.5,), (7.0,), (12.0,), (15.0,)], "z double")
    got = rows(lookup.interval_lookup(z, "z", dim, "lo", "hi", "name", "ord", "n", literal_limit=limit).where("n is not null"), "z", "n")
    assert got == [(2.5, "a"), (7.0, "a"), (12.0, "b")]


def test_large_interval_table_equals_brute_force(spark):
    rng = random.Random(9)
    spans = [(k, f"i{k}", float(lo), float(lo + rng.choice([1, 2, 5, 300]))) for k, lo in enumerate(rng.randrange(0, 400) for _ in range(120))]
    spans += [(k + 200, f"same{k}", 50.0, 51.0) for k in range(60)] + [(900, "empty", 3.0, 3.0)]
    dim = spark.createDataFrame(spans, "ord int, name string, lo double, hi double")
    values = [rng.randrange(-40, 1500) / 2 for _ in range(300)] + [50.5] * 100
    z = spark.createDataFrame([(v,) for v in values], "z double")
    want = sorted((v, next((n for _, n, lo, hi in sorted(spans) if lo <= v < hi), "-")) for v in values)
    got = lookup.interval_lookup(z, "z", dim, "lo", "hi", "name", "ord", "n", literal_limit=5)
    assert rows(got.fillna("-"), "z", "n") == want


def test_lookup_strict_and_lenient(spark):
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    dim = spark.createDataFrame([("a", 1)], "name string, n int")
    assert rows(lookup.lookup(df, dim, {"k": "name"}, {"n": "n"}).fillna(0)) == [("a", 1), ("z", 0)]
    with pytest.raises(StrictModeError, match="not found"):
        lookup.lookup(df, dim, {"k": "name"}, {"n": "n"}, strict=True)
    with pytest.raises(StrictModeError, match="repeats"):
        lookup.lookup(df.where("k = 'a'"), dim.union(dim), {"k": "name"}, {"n": "n"}, strict=True)


def test_name_numbers_last_wins_and_missing_left_out(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 3, 3), ("b", None, 4)], "name string, number bigint, ord int")
    assert rows(lookup.name_numbers(df, "name", "number", ["ord"])) == [("a", 2)]
    assert tuple(lookup.dropped_rows(df, "name", "number").first()) == (2, 2)


def test_first_match_keeps_table_order(spark):
    df = spark.createDataFrame([(1, "c"), (2, "c")], "x int, cell string")
    dim = spark.createDataFrame([(1, "c", "late", 9), (1, "c", "early", 3), (1, "d", "other", 1)], "x int, cell string, name string, ord int")
    got = rows(lookup.first_match(df, dim, {"x": "x", "cell": "cell"}, "name", ["ord"], "name").fillna("-"))
    assert got == [(1, "c", "early"), (2, "c", "-")]


def test_pick_group_and_columns(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    assert lookup.pick_group(df, "k", "a").count() == 1
    with pytest.raises(StrictModeError):
        lookup.pick_group(df, "k", "b")
    with pytest.raises(StrictModeError, match="missing columns"):
        require_columns(df, ["k", "w"])


def test_strict_lookup_checks_keys_only(spark):
    df = spark.createDataFrame([(1, "a", "wide"), (2, "b", "wide"), (2, None, "wide")], "k int, name string, more string")
    table = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "n string, k2 int, v int")
    on = {"k": "k2", "name": "n"}
    with pytest.raises(StrictModeError, match="not found") as seen:
        lookup.lookup(df, table, on, {"v": "v"}, strict=True)
    assert "'k': 2, 'name': None" in str(seen.value) and "wide" not in str(seen.value)
    got = lookup.lookup(df.where("name IS NOT NULL"), table, on, {"v": "v"}, strict=True)
    assert rows(got, "k", "v") == [(1, 10), (2, 20)]
