"""URL rules as a sort-merge range join.

A host is written backwards, label by label, with a dot behind each (``com.example.www.``): a rule for
a host and its subdomains then covers one interval of keys, and intervals nest or are apart. Keys of
rules and of the distinct hosts are dealt out by range and sorted; one sweep carries the stack of the
rules whose intervals are open. The stack belongs to the rule host that opened last: the rule hosts it
lies in, itself included. A host closes what it lies beyond by comparing prefixes. Range partitions
are joined by one row each, the stack at their end. Path prefixes are tested on the few rules of the
stack. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lamina.durable import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """Per rule host: its key and all rules of the hosts it lies in, itself included."""
    hosts = rules.groupBy(host_key(F.col("host")).alias("key")).agg(F.sort_array(F.collect_set(F.struct("host", "path", "verdict"))).alias("own"))
    labels = F.split("key", r"\.")  # the last one is empty
    above = hosts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.concat(F.array_join(F.slice(labels, 1, k), "."), F.lit(".")))).alias("outer"))
    opened = above.join(hosts.select(F.col("key").alias("outer"), "own"), "outer")
    return opened.groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))


def sweep(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, fitting)``: the rules whose host is ``host`` or a parent of it, for distinct ``hosts``."""
    parts = int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host")
    events = points.unionByName(_stacks(rules).withColumn("kind", F.lit(0)), allowMissingColumns=True)
    # written once: a range exchange samples its bounds anew whenever it is planned again
    events = materialise(events.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    ends = events.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("last"))
    every = events.select("part").distinct().join(ends, "part", "left")  # one row for each range partition
    carried = every.select("part", F.last("last", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("open", F.last("stack", True).over(inside)).where("kind = 1")
    swept = swept.join(F.broadcast(carried), "part").withColumn("open", F.coalesce("open", "carried"))  # a row per partition
    open_now = F.filter("open", lambda r: F.startswith(F.col("key"), host_key(r["host"])))
    return swept.select("host", open_now.alias("fitting"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns of these names are replaced).

    ``rules`` has ``host``, ``path``, ``verdict``; hosts are lower-cased and rules with a null are
    passed over. A rule fits its host and all subdomains when the path starts with the rule's. The
    longest host + path wins; of equal length the longer host, then block before allow. Without a rule
    ``rule`` is null and the verdict is ``otherwise``. A null url, or one without ``://``, has empty host
    and path and fits no rule. Repeated pages are judged one by one; a host with very many pages is one
    row of the sweep, and its pages are joined back to it.
    """
    mine = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in mine]
    judged = pages.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    rules = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
    fitting = sweep(judged.select("host").where("host <> ''").distinct(), rules)
    judged = judged.join(fitting, "host", "left")
    fits = F.filter(F.coalesce("fitting", F.array().cast(fitting.schema["fitting"].dataType)), lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(fits, lambda r: F.struct(
        (F.length(r["host"]) + F.length(r["path"])).alias("size"), F.length(r["host"]).alias("deep"), (r["verdict"] == "block").alias("strict"),
        F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))
    best = F.array_max(ranked)
    return judged.select(*kept, "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(otherwise)).alias("verdict"))
