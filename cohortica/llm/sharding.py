"""Sharding by vector bin packing.

Every group of equal texts is a vector (bytes, words, rows).  Heavy groups are
items of their own, light ones are hashed into a fixed number of cells, so the
driver packs a bounded list: at most ``3 * cells`` heavy groups (each holds over
1/cells of one total) and ``cells`` cells.  Items are placed in descending
size, each on the shard where the dot product of the item with the residual
capacity is highest; items then move until the bytes are even.

Nulls and edge cases: a null text counts as an empty one (size 1, crc 0) and
null, empty and repeated rows are packed like any other; a null doc_id sorts
first inside its slot bucket; an empty table gives an empty result.  Extra
columns of the input are not read, so their names cannot clash.  A group is
never split: one that exceeds a fair share keeps its shard to itself and the
law can then hold only for the rest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortica.llm import common

CELLS = 4096
#: Bytes of two shards may differ by this part of a fair share, as far as groups allow.
EVEN = 0.001
#: Slots are numbered in this many hash buckets of each shard.
SLOT_BUCKETS = 1024


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of ``vectors`` (items x dimensions).

    Capacity is an equal share of each dimension.  An item goes where its dot
    product with the residual capacity is highest; ties go to the lower shard.
    The first dimension is the law: items then move until it is even, since one
    item may fill a shard in another (many copies of a short text).
    """
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total, 1) * shards
    order = np.lexsort((np.arange(len(share)), -share.max(axis=1)))
    residual = np.ones((shards, share.shape[1]))
    out = np.zeros(len(share), dtype=np.int64)
    for i in order:
        best = int(np.argmax(residual @ share[i]))
        out[i] = best
        residual[best] -= share[i]
    return level(vectors[:, 0], out, shards)


def level(sizes: np.ndarray, at: np.ndarray, shards: int) -> np.ndarray:
    """``at`` (shard of each item) with items moved until the shards' ``sizes`` are even or no move makes them more so."""
    at, load = at.copy(), np.bincount(at, weights=sizes, minlength=shards)
    near = load.sum() / shards * EVEN
    while True:
        low = int(np.argmin(load))
        for high in np.argsort(-load, kind="stable"):
            gap = load[high] - load[low]
            if gap <= near:
                return at
            own = np.flatnonzero((at == high) & (sizes > 0) & (sizes < gap))
            if len(own):
                break
        else:
            return at
        half = own[sizes[own] * 2 <= gap]
        item = half[np.argmax(sizes[half])] if len(half) else own[np.argmin(sizes[own])]
        at[item] = low
        load[[high, low]] += (-sizes[item], sizes[item])


def _facts(docs: DataFrame, id_col: str, text_col: str, order: tuple[Column, ...]) -> DataFrame:
    text = common.text_or_empty(text_col)
    data = F.encode(text, "utf-8")
    return docs.select(
        F.struct(*order).alias("order"),
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        common.count_space_words(text).alias("words"),
        F.crc32(data).alias("text_crc32"),
        F.md5(data).alias("group_key"),
    ).withColumn("cell", F.conv(F.substring("group_key", 1, 8), 16, 10).cast("long") % CELLS)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", order: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    Slots follow ``order`` (columns of ``docs`` that order its rows, such as a training order); without it, a hash.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    facts = common.materialize(_facts(docs, id_col, text_col, order or (F.lit(0),)), "shard-facts")
    total = facts.agg(F.sum("size").alias("b"), F.sum("words").alias("w"), F.count("*").alias("r")).first()
    item = facts.groupBy("group_key", "cell").agg(F.sum("size").alias("b"), F.sum("words").alias("w"), F.count("*").alias("r"))
    heavy = (
        (F.col("b") * CELLS > (total.b or 0)) | (F.col("w") * CELLS > (total.w or 0)) | (F.col("r") * CELLS > total.r)
    )
    packed = (
        item.withColumn("heavy", F.when(heavy, F.col("group_key")))
        .groupBy(F.col("heavy"), F.when(F.col("heavy").isNull(), F.col("cell")).alias("cell"))
        .agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("r").alias("r"))
        .collect()  # at most 4 * CELLS rows, see the module text
    )
    packed.sort(key=lambda x: (x.heavy is None, x.heavy or "", x.cell or 0))
    places = pack(np.array([[x.b, x.w, x.r] for x in packed], dtype=float).reshape(-1, 3), shards)
    rows = [(x.heavy, x.cell, int(s)) for x, s in zip(packed, places, strict=True)]
    by_group = spark.createDataFrame([(k, s) for k, _, s in rows if k is not None], "group_key string, heavy_shard int")
    by_cell = spark.createDataFrame([(c, s) for k, c, s in rows if k is None], "cell long, cell_shard int")
    placed = (
        facts.join(F.broadcast(by_group), "group_key", "left")
        .join(F.broadcast(by_cell), "cell", "left")
        .select(
            "doc_id", "size", "text_crc32", "order", F.coalesce("heavy_shard", "cell_shard").alias("shard"),
            F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)).alias("bucket"),
        )
    )
    if order:  # buckets are ranges of the order
        ranges = min(SLOT_BUCKETS, common.task_count(spark))
        placed = common.materialize(placed.repartitionByRange(ranges, "order").withColumn("bucket", F.spark_partition_id().cast("long")), "shard-ordered")
    return _slots(placed, spark).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _slots(placed: DataFrame, spark) -> DataFrame:
    """Numbers the rows of a shard without a gap: rank in a hash bucket plus the rows of the buckets before it."""
    counts = placed.groupBy("shard", "bucket").count().collect()  # shards * SLOT_BUCKETS rows at most
    starts, before = [], {}
    for x in sorted(counts, key=lambda x: (x.shard, x.bucket)):
        starts.append((x.shard, x.bucket, before.get(x.shard, 0)))
        before[x.shard] = before.get(x.shard, 0) + x["count"]
    offsets = spark.createDataFrame(starts, "shard int, bucket long, start long")
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("order", "doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("rank", rank)
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long"))
    )
