"""Token counts: an exact histogram of encoded lengths; suffix sums answer for every context limit.

One aggregate brings the corpus down to a row per distinct length. Suffix sums
run over blocks of lengths, so that no task holds the whole histogram.

Defined results
    null or empty text      length 0, counted like any other
    repeated rows           counted as often as they occur
    empty table             an empty histogram
    very long text          one row of the histogram with a large length
    other columns           not read, so their nulls and names do not matter
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.tokens import default_path, library_encoder

BLOCK = 1024


def lengths(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(n_tokens): the encoded length of every row's text."""
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(path)
        for batch in batches:
            texts = batch.column(0)
            yield pa.record_batch([pa.array([len(encode(t)) if (t := x.as_py()) else 0 for x in texts], pa.int64())], ["n_tokens"])

    return df.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(count, "n_tokens long")


def histogram(lengths_of: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): documents per exact length; combined in the tasks before the shuffle."""
    return lengths_of.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with, for each length taken as a context limit, what it keeps and what it cuts.

    docs_longer, tokens_longer: documents over the limit and their tokens;
    truncated_tokens: tokens left when every document is cut at the limit;
    docs_within_ppm: documents that fit, in millionths, which answers quantiles.
    """
    blocks = hist.withColumn("block", F.expr(f"n_tokens DIV {BLOCK}"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    per_block = (
        blocks.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("k"))
        .select("block", _or_zero(F.sum("d").over(later)).alias("d_after"), _or_zero(F.sum("k").over(later)).alias("k_after")))
    totals = hist.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("all_tokens"))
    per_block = per_block.select(
        "*", F.lit(1).alias("one")).join(totals.withColumn("one", F.lit(1)), "one").drop("one")
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    summed = blocks.join(per_block, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (_or_zero(F.sum("n_docs").over(within)) + F.col("d_after")).alias("docs_longer"),
        (_or_zero(F.sum(F.col("n_docs") * F.col("n_tokens")).over(within)) + F.col("k_after")).alias("tokens_longer"))
    return summed.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_tokens"),
        F.expr("((all_docs - docs_longer) * 1000000) DIV all_docs").alias("docs_within_ppm"))


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row for any limit, also one that no document's length equals: n_docs, docs_longer, truncated_tokens.

    The largest length within the limit has all that is needed; below the
    smallest length every document is cut.
    """
    best = sums.where(F.col("n_tokens") <= limit).agg(F.max(F.struct("n_tokens", "docs_longer", "tokens_longer", "truncated_tokens")).alias("b"))
    total = sums.agg(F.sum("n_docs").alias("n_docs"))
    longer = F.coalesce(F.col("b.docs_longer"), F.col("n_docs"), F.lit(0))
    whole = F.coalesce(F.col("b.truncated_tokens") - F.col("b.n_tokens") * F.col("b.docs_longer"), F.lit(0))
    joined = best.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one")
    return joined.select(
        F.lit(limit).cast("long").alias("context_limit"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), longer.alias("docs_longer"),
        (whole + limit * longer).alias("truncated_tokens"))


def quantile(sums: DataFrame, ppm: int) -> DataFrame:
    """(n_tokens): the smallest length that at least `ppm` millionths of the documents do not exceed."""
    return sums.where(F.col("docs_within_ppm") >= ppm).agg(F.min("n_tokens").alias("n_tokens"))


def _or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0).cast("long"))
