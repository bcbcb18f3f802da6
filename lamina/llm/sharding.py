"""Sharding by balanced label propagation over links between documents with equal texts.

Every document starts in a shard by hash. In each round the documents of a text vote for shards, and those elsewhere ask to move
up that ranking, to the first shard that isn't full. They move in units of bounded size, and each shard lets in as many as
leave it or still fit. Documents with links may fill a shard's whole share, as those without give way later. Rounds end
when nobody may move. A last pass evens out the counts: what a shard has beyond its share, documents without links first, goes to
the shards that lack some; all others stay where the rounds have put them. Only DataFrame functions run here.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from lamina.durable import materialise
from lamina.operators.numbering import global_position

ROUNDS = 30  # guards against an endless loop; rounds end when they settle
UNITS = 32  # units that a shard's share holds at least: a text with more documents moves in parts
_LOTS = 1_000_000


def _by_shard(values: list, of: str = "shard") -> Column:
    """The value of each row's shard."""
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col(of) + 1)


def _units() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("units") - 1))


def _propagate(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """``rows`` (row, text, unit, units, shard), all with links, after rounds of moves under quotas."""
    quota = total // shards
    for turn in range(ROUNDS):
        votes = rows.groupBy("text", "shard").agg(F.count(F.lit(1)).alias("votes"), F.max("units").alias("units"))
        choice = F.struct((-F.col("votes")).alias("votes"), F.xxhash64("text", "shard").alias("lot"), "shard")
        ranked = votes.groupBy("text").agg(F.sort_array(F.collect_list(choice)).alias("ranked"), F.max("units").alias("units"))  # an entry for each shard at most
        ranked = ranked.select("text", "ranked", _units().alias("unit"))
        counted = dict(rows.groupBy("shard").count().collect())  # a row for each shard
        loads = [counted.get(k, 0) for k in range(shards)]
        full = [k for k in range(shards) if loads[k] >= quota]
        # the own shard ends the search, so nobody moves down the ranking
        fits = lambda e: (e["shard"] == F.col("shard")) | ~e["shard"].isin(full)
        wish = F.element_at(F.filter("ranked", fits), 1)["shard"]
        asked = materialise(rows.join(ranked, ["text", "unit"]).select(*rows.columns, wish.alias("wish")))
        moves = asked.where("wish <> shard").groupBy("shard", "wish").count().collect()  # at most shards * shards rows
        if not moves:
            return rows
        flow = {(a, b): n for a, b, n in moves}
        inward = [sum(n for (_, to), n in flow.items() if to == b) for b in range(shards)]
        let, going = F.lit(0.0), 0.0
        for (a, b), n in flow.items():
            share = min(1.0, (min(n, flow.get((b, a), 0)) + max(0, quota - loads[b]) * n / inward[b]) / n)
            going += share * n
            let = F.when((F.col("shard") == a) & (F.col("wish") == b), share).otherwise(let)
        if going < 1:
            return rows
        lot = F.pmod(F.xxhash64("text", "unit", F.lit(turn)), F.lit(_LOTS)) / _LOTS
        rows = materialise(asked.select("row", "text", "unit", "units", F.when(lot < let, F.col("wish")).otherwise(F.col("shard")).alias("shard")))
    return rows


def _even_out(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """``(row, shard, slot)`` of ``rows`` (row, text, unit, linked, shard) with counts at most one apart."""
    counted = dict(rows.groupBy("shard").count().collect())  # a row for each shard
    counts = [counted.get(k, 0) for k in range(shards)]
    larger = sorted(range(shards), key=lambda k: -counts[k])[:total % shards]
    shares = [total // shards + (k in larger) for k in range(shards)]
    before = lambda values: [0, *accumulate(values)][:shards]
    # inside a shard, documents without links come last; those behind its share are the surplus, numbered over all shards
    placed = global_position(rows.select("row", "shard", (~F.col("linked")).alias("single"), "text", "unit"), ["shard", "single", "text", "unit", "row"], "pos")
    inside = F.col("pos") - 1 - _by_shard(before(counts))
    surplus = before([max(0, n - most) for n, most in zip(counts, shares)])
    placed = placed.select("row", "shard", inside.alias("inside"), (inside - _by_shard(shares) + _by_shard(surplus)).alias("extra"))
    stays = F.col("inside") < _by_shard(shares)
    lacks = [max(0, most - n) for n, most in zip(counts, shares)]
    into = F.col("shard")
    for k, (start, lack) in enumerate(zip(before(lacks), lacks)):
        into = F.when(F.col("extra").between(start, start + lack - 1), k).otherwise(into)
    placed = placed.select("row", "inside", "extra", stays.alias("stays"), F.when(stays, F.col("shard")).otherwise(into).cast("int").alias("shard"))
    slot = F.when(F.col("stays"), F.col("inside")).otherwise(_by_shard(counts) + F.col("extra") - _by_shard(before(lacks)))
    return placed.select("row", "shard", slot.cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``rows``: shards hold equally many documents, or one more. ``slot`` numbers a shard's
    documents from 0; ``grown_shard`` is null, as it belongs to another law. A null text counts as
    empty. Repeated rows and ids, and null ids, are documents like any other; texts of any length are read whole. Votes that tie are
    decided by a hash. An empty table gives no rows. Other columns are not used.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    compact = materialise(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("text")))
    total = compact.count()
    units = F.ceil(F.col("members") * shards * UNITS / max(1, total)).cast("bigint")
    groups = materialise(compact.groupBy("text").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("text", units.alias("units")))
    hot = groups.where("units > 1")  # fewer than shards * UNITS texts, as each has more than that part of all rows
    start = F.pmod(F.xxhash64(F.lit("start"), "row"), F.lit(shards)).cast("int")
    rows = compact.select("row", "text", start.alias("shard")).join(F.broadcast(hot), "text", "left")
    rows = rows.select("row", "text", "shard", F.pmod(F.xxhash64("row"), F.coalesce("units", F.lit(1))).cast("bigint").alias("unit"))
    spread = groups.select("text", "units", _units().alias("unit"))
    rows = materialise(rows.join(spread, ["text", "unit"], "left"))
    linked = _propagate(rows.where("units IS NOT NULL").select("row", "text", "unit", "units", "shard"), shards, total)
    columns = ["row", "text", "unit", "shard"]
    both = linked.select(*columns, F.lit(True).alias("linked")).unionByName(rows.where("units IS NULL").select(*columns, F.lit(False).alias("linked")))
    placed = _even_out(both, shards, total)
    return compact.join(placed, "row").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(sharded: DataFrame, text_col: str) -> DataFrame:
    """One row: texts of several documents, and how many of them lie in more than one shard."""
    per = sharded.groupBy(text_col).agg(F.count(F.lit(1)).alias("members"), F.min("shard").alias("low"), F.max("shard").alias("high")).where("members > 1")
    return per.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("low") < F.col("high")).alias("cut"))
