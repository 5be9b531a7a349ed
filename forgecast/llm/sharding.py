"""Sharding by fixed virtual slots: DataFrame and SQL functions only.

Rows are hashed into ``SLOTS`` virtual slots once and for all; equal rows are numbered
and spread by number. A versioned map says which shard holds a slot; rebalancing adds a
version that edits the map: slots are visited by falling bytes; each stays on its shard
while that stays under an even share of all bytes and else goes to the least loaded
shard. With ``map_path`` the versions are kept there: a later run starts from the latest
one and adds the next.

Law ``bytes``: shard sizes differ by about the bytes of a small slot, however often a row
is repeated; one row isn't split. Defined cases: a null text has no bytes (size 16) and the
checksum 0; a null id is hashed like others; ties are broken by slot number; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forgecast.llm.graph import Scratch

SLOTS = 4096
SHARDS = 40
ROW_BYTES = 16
#: equal rows that one task numbers
COPIES = 1 << 16

_SLOT = "struct<slot:int,shard:int,bytes:bigint>"


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))


def slotted(groups: DataFrame, slots: int = SLOTS, copies: int = COPIES) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row, from rows with their number n.

    Equal rows are told apart by their number only, so it doesn't matter which is which.
    More than ``copies`` of them are numbered in several tasks.
    """
    row = ["doc_id", "size", "text_crc32"]
    few = groups.where(F.col("n") <= copies).select(
        *row, F.explode(F.expr("sequence(0L, n - 1)")).alias("copy"))
    many = (groups.where(F.col("n") > copies)
            .select(*row, "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {copies})")).alias("part"))
            .repartition(*row, "part")
            .select(*row, F.explode(F.expr(
                f"sequence(part * {copies}, least(n, (part + 1) * {copies}) - 1)")).alias("copy")))
    return few.union(many).select(*row, F.pmod(
        F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots)).cast("int").alias("virtual_slot"))


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1: slots dealt out in turn."""
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("slot"),
        (F.col("id") % shards).cast("int").alias("shard"))


def rebalance(current: DataFrame, load: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map (version, slot, shard), given (slot, bytes).

    The fold runs over one array of all slots, whose number is a fixed parameter.
    """
    slots = current.join(load, "slot", "left").select(
        "version", F.struct((-F.coalesce("bytes", F.lit(0))).alias("order"), "slot",
                            "shard", F.coalesce("bytes", F.lit(0)).alias("bytes")).alias("s"))
    one = slots.groupBy().agg(
        (F.max("version") + 1).alias("version"), F.sum("s.bytes").alias("total"),
        F.array_sort(F.collect_list("s")).alias("sorted"))
    one = one.withColumn("share", F.ceil(F.col("total") / shards)).withColumn(
        "slots", F.expr(f"cast(transform(sorted, x -> named_struct('slot', x.slot, 'shard', "
                        f"x.shard, 'bytes', x.bytes)) as array<{_SLOT}>)"))
    state = f"struct<load:array<bigint>,done:array<{_SLOT}>>"
    zero = f"cast(named_struct('load', array_repeat(0L, {shards}), 'done', array()) as {state})"
    add = ("transform(acc.load, (v, i) -> if(i = {at}, v + x.bytes, v))")
    put = "concat(acc.done, array(named_struct('slot', x.slot, 'shard', {at}, 'bytes', x.bytes)))"
    at = (f"if(x.shard >= 0 and x.shard < {shards} and acc.load[x.shard] + x.bytes <= share, "
          "x.shard, cast(array_position(acc.load, array_min(acc.load)) - 1 as int))")
    one = one.withColumn("last", F.expr(
        f"aggregate(slots, {zero}, (acc, x) -> cast(named_struct('load', {add.format(at=at)}, "
        f"'done', {put.format(at=at)}) as {state}))"))
    return one.select("version", F.explode("last.done").alias("s")).select(
        "version", "s.slot", "s.shard")


def latest_map(spark: SparkSession, map_path: str) -> DataFrame | None:
    """The greatest version kept in ``map_path``, None if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(map_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not len(fs.listStatus(path)):
        return None
    maps = spark.read.parquet(map_path)
    last = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == last).select("version", "slot", "shard")


def keep_map(version: DataFrame, map_path: str) -> None:
    """Store one version beside the others; storing it again replaces it."""
    number = version.agg(F.max("version")).first()[0]
    (version.select("slot", "shard").coalesce(1)  # a fixed number of rows
     .write.mode("overwrite").parquet(f"{map_path}/version={number}"))


def shard_rows(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS,
               map_path: str | None = None) -> DataFrame:
    """Every row with its shard and its position in it, by the next version of the map."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    groups = scratch.store(sized_rows(docs).groupBy("doc_id", "size", "text_crc32").agg(
        F.count("*").alias("n")), "groups")
    rows = slotted(groups, slots)
    load = scratch.store(rows.groupBy(F.col("virtual_slot").alias("slot")).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows")), "load")
    current = latest_map(spark, map_path) if map_path else None
    if current is None:
        current = scratch.store(first_map(spark, slots, shards), "first")
        if map_path:
            keep_map(current, map_path)
    version = scratch.store(rebalance(current, load, shards), "map")
    if map_path:
        keep_map(version, map_path)
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    now = scratch.store(
        version.join(load, "slot", "left")
        .withColumn("ahead", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .select(F.col("slot").alias("virtual_slot"), "shard", "ahead"), "now")
    place = F.row_number().over(
        Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (rows.withColumn("place", place)
            .join(F.broadcast(now), "virtual_slot")  # one row per slot: a fixed number
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("ahead") + F.col("place") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"))
