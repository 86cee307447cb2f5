"""Helpers the operators of this folder share."""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints/cohortica"
#: Bytes of an Arrow batch that a Python worker gets at once.
BATCH_BYTES = 4 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def workspace(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    os.makedirs(LOCAL_CHECKPOINTS, exist_ok=True)
    return f"file://{LOCAL_CHECKPOINTS}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{workspace(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Removes tables of :func:`materialize` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = hadoop(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts are bounded by bytes, not by rows alone; a smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, "67108864b").rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def trim() -> None:
    """Gives memory that a Python worker has freed back to the machine: workers live on between tasks."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, parts: int = 1000) -> DataFrame:
    """``left`` with the columns of ``right`` (one row a key; ``weight``: about how often ``left`` has it), null where it has none.

    Keys of over 1/parts of all weight, fewer than ``parts`` by that bound, are joined by broadcast, and their rows are
    dealt anyhow in the join of the others, so that no task gets all rows of one key.
    """
    right = materialize(right, "hot-keys")
    whole = right.agg(F.sum(weight)).first()[0] or 0
    named = [c for c in right.columns if c != key]
    hot = right.where(F.col(weight) * parts > whole).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in named])
    rest = right.where(F.col(weight) * parts <= whole).select(F.col(key).alias("_rest"), F.lit(0).cast("long").alias("_zero"), *[F.col(c).alias(f"_rest_{c}") for c in named])
    first = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    deal = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(F.xxhash64(*left.columns).bitwiseOR(F.lit(1))).cast("long")
    both = first.withColumn("_deal", deal).join(rest, (F.col(key) == F.col("_rest")) & (F.col("_deal") == F.col("_zero")), "left")
    return both.select(*left.columns, *[F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in named])


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, nothing else; plain ASCII texts take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def count_space_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def task_count(spark: SparkSession) -> int:
    """Tasks for a shuffle that moves whole texts."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Everything but ASCII letters, digits and what lies beyond ASCII parts words.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def plain_words(text: Column) -> Column:
    """Array of the words of an ASCII-lower-cased text; empty for a null text or one without words."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BREAK), ""), F.array().cast("array<string>"))


def shingle_hashes(words: str, n: int) -> Column:
    """Hash of each run of ``n`` words of an array column, in order; empty if it has fewer words."""
    return F.when(F.size(words) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(n)]))
    )


def string_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def once(df: DataFrame, name: str, value: Column, keep=None) -> DataFrame:
    """``df`` with a column that is evaluated once a row, whatever reads it; ``keep(x)`` drops rows.

    Filters over a projection are pushed below it with its expressions put in
    their place, which would split a text again for every use of its words; a
    generator of one element stops that.
    """
    one = F.array(value)
    return df.select("*", F.explode(one if keep is None else F.filter(one, keep)).alias(name))
