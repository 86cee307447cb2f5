"""Benchmark decontamination by exact similarity of item-sized windows, in DataFrame functions only.

Words are lower-cased runs of letters, digits and characters beyond ASCII;
shingles are five of them (an item with fewer words is one shingle).

1. A similarity of 0.8 needs a common shingle, so only texts that hold one of
   the items' shingles are windowed.  Equal texts are searched once.
2. Each such place implies a start of the item in the text.  A window before the
   least or after the largest implied start holds no place that the window there
   lacks, so every start between them is windowed, wherever the item was edited.
   Of w and m shingles with similarity 0.8, 4/9 (w + m) are common: windows that
   hold fewer of the item's shingles are left out, without loss.
3. These are verified by exact weighted Jaccard similarity (sum of the smaller
   counts over sum of the larger).  The best one's 64-bit SimHash, weighted by how
   often a shingle occurs, is compared with the item's and their distance reported.

This departs from the dealt method, in which blocks of a SimHash propose the
candidates: it can't give right results here.  Two sets with similarity 0.8 have
64-bit fingerprints about 10 bits apart, but of 5 shingles with 4 common ones 51
in 10,000 pairs are over 20 apart.  A radius that loses none (about 32) is that
of unrelated texts, so its blocks would propose every pair.  The count of common
shingles in step 2 is exact and leaves fewer windows.

Nulls and edge cases: a null or wordless text, and such an item, matches
nothing; a text shorter than an item is one window; repeated items and rows are
reported each; a null doc_id is reported as null.  Empty tables give an empty
result.  Only id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortica.llm import common

SHINGLE = 5
#: Size check of the benchmark: up to so many shingles are a literal set and a broadcast table; more are joined by shuffle, with the same result.
MOST_LITERALS = 100_000


def simhash(shingles: str) -> Column:
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (a, b) -> a | if(2 * size(filter({shingles}, x -> shiftright(x, b) & 1L = 1L)) > size({shingles}), shiftleft(1L, b), 0L))"
    )


def _starts() -> Column:
    """Every start from ``low`` to ``high`` whose window of ``width`` holds ``least`` of the sorted ``places``, each once.

    The window's first place is the i-th: it starts after the place before, and early enough to end no sooner than the
    last of ``least`` places.  Starts beyond the text's ends are moved to them.
    """
    return F.expr(
        """flatten(transform(
            transform(sequence(0, size(places) - least), i -> struct(
              greatest(least(greatest(low, 0), size - width), if(i = 0, 0, get(places, i - 1) + 1), get(places, i + least - 1) - width + 1) as a,
              least(greatest(least(high, size - width), 0), get(places, i)) as b)),
            x -> if(x.a <= x.b, sequence(x.a, x.b), cast(array() as array<int>))))"""
    )


def _counted(shingles: str) -> Column:
    """Each shingle with its number among its equals: sets of these compare as multisets."""
    return F.expr(f"transform({shingles}, (x, i) -> xxhash64(x, size(filter(slice({shingles}, 1, i), y -> y = x))))")


def _items(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return bench.select(F.col(item_col).alias("item_id"), common.plain_words(F.col(text_col)).alias("words")).withColumn("span", F.size("words")).where("span > 0")


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start_word, hamming: the best window of each row for each item it holds."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _key(text_col).alias("key"))
    return rows.join(_found(docs, bench, item_col, text_col), "key").select("doc_id", "item_id", "similarity", "start_word", "hamming")


def _key(text_col: str) -> Column:
    return F.md5(F.encode(common.text_or_empty(text_col), "utf-8"))


def _found(docs: DataFrame, bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """key, item_id, similarity, start_word, hamming: the best window of each text, by its key, for each item it holds."""
    keyed = docs.select(F.col(text_col).alias("text"), _key(text_col).alias("key"))
    items = common.materialize(_items(bench, item_col, text_col), "decontam-items")
    found, tables = None, []
    for (n,) in items.select(F.least("span", F.lit(SHINGLE)).alias("n")).distinct().orderBy("n").collect():  # SHINGLE rows at most
        part, held = _search(keyed, items.where(F.least("span", F.lit(SHINGLE)) == n), n)
        tables.append(held)
        found = part if found is None else found.unionByName(part)
    if found is None:
        none = docs.sparkSession.createDataFrame([], "key string, item_id long, similarity double, start_word int, hamming int")
        found = none.withColumn("item_id", F.col("item_id").cast(bench.schema[item_col].dataType))
    found = common.materialize(found, "decontam-found")
    common.discard(items, *tables)
    return found


def _search(keyed: DataFrame, items: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The best windows for items that have ``n`` words a shingle, and the table they are found in."""
    items = items.withColumn("shingles", common.shingle_hashes("words", n)).drop("words").withColumn("passage", F.md5(F.array_join(F.col("shingles").cast("array<string>"), " ")))
    passages = items.select("passage", "shingles").dropDuplicates(["passage"]).withColumn("item_print", simhash("shingles"))
    postings = passages.select(F.explode("shingles").alias("shingle")).distinct()
    literals = [x.shingle for x in postings.limit(MOST_LITERALS + 1).collect()]
    small = len(literals) <= MOST_LITERALS
    split = common.once(keyed, "words", common.plain_words(F.col("text")))
    if small:
        held = common.once(split, "shingles", common.shingle_hashes("words", n), lambda s: F.exists(s, lambda x: x.isin(literals))).select("key", "shingles")
    else:
        hashed = common.once(split, "shingles", common.shingle_hashes("words", n)).select("key", "shingles")
        keys = hashed.select("key", F.explode("shingles").alias("shingle")).join(postings, "shingle", "left_semi").select("key").distinct()
        held = hashed.join(keys, "key", "left_semi")
    held = common.materialize(held.dropDuplicates(["key"]), "decontam-held")
    places = held.select("key", F.size("shingles").alias("size"), F.posexplode("shingles").alias("place", "shingle"))
    spread = passages.select("passage", F.size("shingles").alias("wide"), F.posexplode("shingles").alias("at", "shingle"))
    spread = spread.groupBy("passage", "wide", "shingle").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    if small:
        spread, passages = F.broadcast(spread), F.broadcast(passages)
    windows = (
        places.join(spread, "shingle")
        .groupBy("key", "passage", "size", "wide")
        .agg(F.sort_array(F.collect_list("place")).alias("places"), F.min(F.col("place") - F.col("last")).alias("low"), F.max(F.col("place") - F.col("first")).alias("high"))
        .withColumn("width", F.least("size", "wide"))
        .withColumn("least", F.ceil(4 * (F.col("width") + F.col("wide")) / 9).cast("int"))
        .where("size(places) >= least")
        .select("key", "passage", "width", F.explode(_starts()).alias("start_word"))
        .join(held, "key")
        .select("key", "passage", "start_word", F.slice("shingles", F.col("start_word") + 1, F.col("width")).alias("window"))
    )
    same = F.size(F.array_intersect(_counted("window"), _counted("shingles")))
    best = (
        windows.join(passages, "passage")
        .withColumn("same", same)
        .withColumn("all", F.size("window") + F.size("shingles") - F.col("same"))
        .where("5 * same >= 4 * all")
        .groupBy("key", "passage")
        .agg(F.max(F.struct((F.col("same") / F.col("all")).alias("similarity"), (-F.col("start_word")).alias("s"), "window", "item_print")).alias("best"))
        .select("key", "passage", "best.similarity", (-F.col("best.s")).alias("start_word"), F.bit_count(simhash("best.window").bitwiseXOR(F.col("best.item_print"))).alias("hamming"))
    )
    found = (
        best.join(items.select("item_id", "passage").distinct(), "passage")
        .groupBy("key", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), "hamming")).alias("best"))
        .select("key", "item_id", "best.similarity", (-F.col("best.s")).alias("start_word"), "best.hamming")
    )
    return found, held


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item; ``id_col`` decides nothing, ids may be null or repeated."""
    gone = _found(docs, bench, item_col, text_col).select(F.col("key").alias("_leaked")).distinct()
    return docs.join(gone, _key(text_col) == F.col("_leaked"), "left_anti")
