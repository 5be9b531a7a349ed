"""URL filters: captures joined with the list entries valid at their fetch time.

List events (list, pattern, day, action) become validity intervals: an entry
holds from its addition to the pattern's next event on that list. A capture is
listed by every pattern that is its host or a parent domain of it and whose
interval covers the fetch day.

Captures are reduced to distinct (host, day) pairs before the join, so a host
with many captures costs its number of days only. Defined cases: a capture
without a host or day, or without entries, is not listed; several events of a
pattern on a day count in the order remove, add; repeated rows are kept; empty
tables give empty or unlisted results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/:?#@]+?)\.*(?:[:/?#]|$)"


def host_of(url: str) -> F.Column:
    """Host of a URL, with or without a scheme before ``//``; no user, port or last dots."""
    host = F.regexp_extract(F.lower(F.col(url)), HOST, 1)
    return F.when(host != "", host)


def intervals(events: DataFrame) -> DataFrame:
    """(list, pattern, start, stop) of additions; stop is null while the entry holds."""
    order = Window.partitionBy("list", "pattern").orderBy("day", F.desc("action"))
    return (events.where("pattern is not null and day is not null")
            .select("list", "pattern", "day", "action").distinct()
            .withColumn("stop", F.lead("day").over(order))
            .where("action = 'add' and (stop is null or stop > day)")
            .select("list", "pattern", F.col("day").alias("start"), "stop"))


def listed(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``captures`` (page_id, host, day) with n_entries, lists and blocked."""
    pairs = captures.select("host", "day").where("host is not null and day is not null").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = pairs.withColumn("pattern", F.explode(suffixes))
    active = (keyed.join(intervals(events), "pattern")
              .where((F.col("start") <= F.col("day"))
                     & (F.col("stop").isNull() | (F.col("day") < F.col("stop"))))
              .groupBy("host", "day").agg(
                  F.count("*").alias("n_entries"),
                  F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists")))
    return (captures.select("page_id", "host", "day").join(active, ["host", "day"], "left")
            .select("page_id", "host", "day",
                    F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"),
                    F.coalesce("lists", F.lit("")).alias("lists"),
                    F.col("n_entries").isNotNull().alias("blocked")))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no fetch time: the day follows the page number."""
    return pages.select("page_id", host_of("url").alias("host"),
                        (F.col("page_id") * 37 % 365).alias("day"))


def page_list_events(pages: DataFrame) -> DataFrame:
    """List events derived from the hosts of the pages table (host without its first service
    label): two thirds are listed, all are taken off again, some return."""
    bare = F.regexp_replace(host_of("url"), "^(www|m|blog)\\.", "")
    k = (pages.select(bare.alias("pattern"), "page_id").where("pattern is not null")
         .groupBy("pattern").agg(F.min("page_id").alias("k")).where("k % 3 < 2")
         .withColumn("list", F.when(F.col("k") % 3 == 0, "spam").otherwise("adult")))
    add, gone = F.col("k") % 200, F.col("k") % 200 + 60 + F.col("k") % 90
    one = F.array(F.struct(add.alias("day"), F.lit("add").alias("action")),
                  F.struct(gone.alias("day"), F.lit("remove").alias("action")))
    back = F.array(F.struct((gone + 20).alias("day"), F.lit("add").alias("action")))
    return k.select("list", "pattern", F.explode(
        F.when(F.col("k") % 2 == 0, F.concat(one, back)).otherwise(one)).alias("e")).select(
        "list", "pattern", "e.day", "e.action")


ORACLE = f"""
with p as (select page_id, page_id * 37 % 365 as day,
             nullif(regexp_extract(lower(url), '{HOST}', 1), '') as host from pages),
k as (select regexp_replace(host, '^(www|m|blog)\\.', '') as pattern, min(page_id) as k
      from p where host is not null group by 1 having min(page_id) % 3 < 2),
e as (select case when k % 3 = 0 then 'spam' else 'adult' end as list, pattern,
        k % 200 as start, k % 200 + 60 + k % 90 as stop from k
      union all
      select case when k % 3 = 0 then 'spam' else 'adult' end, pattern,
        k % 200 + 60 + k % 90 + 20, null from k where k % 2 = 0)
select p.page_id, p.host, p.day, count(e.pattern) as n_entries,
  coalesce(string_agg(distinct e.list, ',' order by e.list), '') as lists,
  count(e.pattern) > 0 as blocked
from p left join e on (p.host = e.pattern or ends_with(p.host, '.' || e.pattern))
  and e.start <= p.day and (e.stop is null or p.day < e.stop)
group by p.page_id, p.host, p.day"""
