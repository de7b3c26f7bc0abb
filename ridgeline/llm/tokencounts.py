"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blank, map_rows, written

#: The pre-tokeniser of the public byte-level vocabulary: fixed pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Lengths that one block of the two-level suffix sum holds.
BLOCK = 1024


def encoded(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = (), pattern: str = PATTERN) -> DataFrame:
    """keep and n_tokens (long) for each row: the number of ids that the byte-level vocabulary gives the whole text. Null is empty.

    Texts of any length are whole; repeated rows are rows each; columns not in keep are ignored; no rows give no rows.
    vocabulary is the path of a rank file (base64 token, rank) that the driver can read; its ranks are broadcast."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    slim = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], blank(docs[text]).alias("text"))
    schema = ", ".join([f"{x.name} {x.dataType.simpleString()}" for x in slim.schema if x.name != "text"] + ["n_tokens bigint"])

    def make():
        import tiktoken

        code = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=shipped.value, special_tokens={})

        def f(part):
            return part | {"n_tokens": [len(code.encode_ordinary(t)) for t in part["text"]]}

        return f

    out = map_rows(slim, make, schema)
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def length_histogram(lengths: DataFrame, n: str = "n_tokens") -> DataFrame:
    """One row for each length that occurs: n_tokens, docs, tokens; docs_ge and tokens_ge over this and longer documents;
    docs_le (so the quantile q is the least length with docs_le >= q * all); truncated_total, the tokens left when every
    document is cut to this length. Null lengths count 0. Suffix sums run within blocks of BLOCK lengths, and over the
    blocks' totals, so no task holds more than a block or a row a block. No rows give no rows."""
    size = F.coalesce(F.col(n), F.lit(0)).cast("long")
    bars = lengths.groupBy(size.alias("n_tokens")).agg(F.count("*").alias("docs")).withColumn("tokens", F.col("docs") * F.col("n_tokens")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    bars = written(bars, "lengths")  # a row a length, so that texts are encoded once
    blocks = bars.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("after_docs"), F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("after_tokens"), F.sum("bd").over(Window.partitionBy()).alias("all_docs"), F.sum("bt").over(Window.partitionBy()).alias("all_tokens"))
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = bars.join(blocks, "block").withColumn("docs_ge", F.sum("docs").over(down) + F.col("after_docs")).withColumn("tokens_ge", F.sum("tokens").over(down) + F.col("after_tokens"))
    return out.select(
        "n_tokens", "docs", "tokens", "docs_ge", "tokens_ge", (F.col("all_docs") - F.col("docs_ge") + F.col("docs")).alias("docs_le"),
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")).alias("truncated_total"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, fits (documents no longer than the limit) and truncated_total for any context limits, from the histogram alone."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    cut = F.least("n_tokens", "limit")
    pairs = histogram.select("n_tokens", "docs").join(F.broadcast(asked))
    return pairs.groupBy("limit").agg(F.sum(F.when(F.col("n_tokens") <= F.col("limit"), F.col("docs")).otherwise(0)).alias("fits"), F.sum(cut * F.col("docs")).alias("truncated_total"))


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The least length that a share q of the documents doesn't exceed; None over no documents."""
    total = histogram.agg(F.sum("docs")).first()[0]
    return histogram.where(F.col("docs_le") >= q * total).agg(F.min("n_tokens")).first()[0] if total else None
