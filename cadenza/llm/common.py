"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (tests on one
    machine) a temporary folder that is set for the session. On a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cadenza.shared.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("cadenza.shared.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives
    lost executors and lets several consumers read the same rows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to be a column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) with null texts as empty ones; every other column is left out,
    so that extra columns never clash with an operator's own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_mod(col, n: int):
    """crc32(id as text) mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


#: Bits that one row of a bitmap holds, bits for each key, and most bits of a bitmap.
ROW_BITS, KEY_BITS, MOST_BITS = 32_768, 12, 1 << 28


def bitmap(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(bucket, bits) and its size: a bitmap in which the slots of the keys (long) are set, in DataFrame functions only. It has KEY_BITS for each key and no
    more than MOST_BITS (32 MB), so it can be broadcast whatever the table holds; past that it only lets more through."""
    size = min(MOST_BITS, -(-max(1, KEY_BITS * keys.count()) // ROW_BITS) * ROW_BITS)
    slot = F.pmod(F.xxhash64(key), F.lit(size))
    return keys.select(F.floor(slot / ROW_BITS).cast("int").alias("_bucket"), (slot % ROW_BITS).alias("_slot")).groupBy("_bucket").agg(F.bitmap_construct_agg("_slot").alias("_bits")), size


def with_bit(rows: DataFrame, key: str, found: tuple[DataFrame, int], name: str) -> DataFrame:
    """Adds `name`: whether the bitmap may hold the row's key; never wrong for one that it holds."""
    bits, size = found
    at, place, held = spare(rows, "_bucket", "_slot", "_bits")
    slot = F.pmod(F.xxhash64(key), F.lit(size))
    sides = F.broadcast(bits.select(F.col("_bucket").alias(at), F.col("_bits").alias(held)))
    marked = rows.withColumns({at: F.floor(slot / ROW_BITS).cast("int"), place: (slot % ROW_BITS).cast("int")}).join(sides, at, "left")
    byte = F.conv(F.hex(F.substring(held, F.floor(F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(F.call_function("shiftright", byte, (F.col(place) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return marked.withColumn(name, on).drop(at, place, held)


def connected_components(links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """links (a long, b long) -> (node, component): the smallest node reachable.

    Alternating large-star and small-star steps. Neighbour minima are aggregated and joined back
    instead of gathering a node's neighbours, so a hub's edges stay spread over tasks. Each round
    is written to the shared folder. Empty input gives an empty result; self-loops and repeated
    links are harmless. Raises if `most_rounds` rounds (enough for paths of about 2^60) don't settle it.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    for _ in range(most_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u is tied to the least of u and its neighbours
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u's smaller neighbours and u itself are tied to the least of them
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(small.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, name)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.countDistinct("u").alias("k")).first()
        if state["n"] == state["k"] and before is not None and (state["n"], state["s"]) == before:
            break
        before = (state["n"], state["s"])
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
