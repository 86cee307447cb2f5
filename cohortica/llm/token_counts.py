"""Token counts by an exact histogram of encoded lengths.

Every whole text is encoded, documents are aggregated by length, and suffix sums
over the histogram answer totals, quantiles and truncated totals for every
context limit.  The sums are taken in two levels (spans of ``SPAN`` lengths,
then lengths inside one), so no task holds the whole histogram.

Nulls and edge cases: a null or empty text has length 0 and is counted;
repeated rows are counted each; an empty table gives an empty histogram.  Only
the text is read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortica.llm import common

SPAN = 1024


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """One column, n_tokens: the encoded length of every row's whole text.

    ``path`` is a vocabulary of byte-pair ranks that every executor has (with the
    library that ships it), ``pattern`` the regular expression that cuts words.
    """
    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    common.bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path, pattern).encode_ordinary
        for part in parts:
            yield pd.Series([len(encode(t)) if t else 0 for t in part], dtype="int64")

    return docs.select(count(F.col(text_col)).alias("n_tokens"))


def histogram(counts: DataFrame) -> DataFrame:
    """n_tokens, n_docs; written once, so that no reader of it encodes the texts again."""
    return common.materialize(counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "token-histogram")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length taken as a context limit: documents of it, over it, tokens in longer ones, truncated total, quantile."""
    rows = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / SPAN).alias("span"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    spans = rows.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per SPAN lengths
    whole = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select(
        "span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"),
        F.sum("d").over(whole).alias("all_d"), F.sum("t").over(whole).alias("all_t"),
    )
    inside = Window.partitionBy("span").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = rows.join(spans, "span").select(
        "n_tokens", "n_docs", "all_d", "all_t", (F.col("d") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_over"),
        (F.col("t") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("tokens_over"),
    )
    return over.select(
        "n_tokens", "n_docs", "docs_over", "tokens_over", F.col("all_t").alias("tokens_total"),
        (F.col("all_t") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("all_d") - F.col("docs_over")) / F.col("all_d")).alias("quantile"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """docs, docs over, total and truncated total for each context limit, seen among the lengths or not."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    stats = [
        F.struct(F.lit(x).cast("long").alias("context_limit"), F.coalesce(F.sum(d), F.lit(0)).alias("docs"),
                 F.coalesce(F.sum(F.when(n > x, d)), F.lit(0)).alias("docs_over"), F.coalesce(F.sum(n * d), F.lit(0)).alias("tokens_total"),
                 F.coalesce(F.sum(F.least(n, F.lit(x)) * d), F.lit(0)).alias("truncated_total"))
        for x in limits
    ]
    return hist.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least each share of the documents does not exceed."""
    least = [F.struct(F.lit(q).alias("share"), F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return sums.agg(F.array(*least).alias("q")).select(F.inline("q"))
