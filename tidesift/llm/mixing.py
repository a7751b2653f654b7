"""Documents of several sources mixed so that each source has a target share of the tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesift.session import ship_package, small_side, spread

#: A vocabulary file of a public tokenizer, by default where the machine keeps them. The driver reads it; it is sent to the
#: executors with the job.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed values: how texts are cut before byte pairs are merged
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source and n_tokens of each document; 0 for null and empty texts."""
    ship_package(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = Path(tokenizer).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(SparkFiles.get(name))
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "n_tokens"]
            )

    return spread(docs.select("doc_id", "source", F.col(text).alias("_text"))).mapInArrow(
        run, "doc_id bigint, source string, n_tokens bigint"
    )


def mixing_rates(sizes: DataFrame, weights: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """One row per source of either side: source, target_share, max_repeats, n_docs, n_tokens, share (the target among
    the sources that have tokens), rate (how often each of its documents is used on average).

    total_tokens is what the mixture should hold. By default it is the largest total at which no source needs more than
    max_repeats uses of a document, so that every source reaches its share exactly in expectation. With a larger total
    a source that runs out is used max_repeats times, and falls short. Sources without a weight, null among them, and
    weights without documents have rate 0.
    """
    have = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    both = weights.select("source", "target_share", "max_repeats").join(have, "source", "full_outer")
    usable = (F.coalesce("n_tokens", F.lit(0)) > 0) & (F.coalesce("target_share", F.lit(0.0)) > 0) & (F.col("max_repeats") > 0)
    # one row per source, so the totals are a small aggregate that every row gets
    whole = both.where(usable).agg(F.sum("target_share").alias("_shares"))
    shared = both.crossJoin(F.broadcast(whole)).withColumn(
        "share", F.when(usable, F.col("target_share") / F.col("_shares")).otherwise(0.0)
    )
    if total_tokens is None:
        most = shared.where("share > 0").agg(F.min(F.col("max_repeats") * F.col("n_tokens") / F.col("share")).alias("_total"))
    else:
        most = shared.agg(F.lit(float(total_tokens)).alias("_total"))
    rate = F.least(F.col("share") * F.col("_total") / F.col("n_tokens"), F.col("max_repeats").cast("double"))
    return shared.crossJoin(F.broadcast(most)).select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        "share",
        F.when(F.col("share") > 0, rate).otherwise(0.0).alias("rate"),
    )


def _used(docs: DataFrame, rates: DataFrame, seed: int) -> tuple[DataFrame, Column]:
    """The documents of the sources that are used, with their rate, and how often each is used."""
    used = docs.join(small_side(rates.where("rate > 0").select("source", F.col("rate").alias("_rate"))), "source")
    whole = F.floor("_rate")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return used, (whole + F.when(drawn < F.col("_rate") - whole, 1).otherwise(0)).cast("int")


def mixture(sizes: DataFrame, rates: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, n_tokens and n_copies (at least 1) of the documents that are used.

    A document is used floor(rate) times, and once more where the hash of its id and the seed falls below the fraction:
    the same choice on every run and in every partition, never more than max_repeats.
    """
    used, copies = _used(sizes, rates, seed)
    return used.select("doc_id", "source", "n_tokens", copies.alias("n_copies")).where("n_copies > 0")


def copies_of(docs: DataFrame, rates: DataFrame, seed: int = 7) -> DataFrame:
    """The mixture written out: one row per use of a document, with copy_no from 1 after the document's columns (in place of
    a column of that name). How often a document is used follows from its id and source alone, so no text is moved."""
    used, copies = _used(docs, rates, seed)
    columns = [c for c in docs.columns if c != "copy_no"]
    none = F.array().cast("array<int>")
    return used.select(*columns, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(none)).alias("copy_no"))


def shares_reached(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """Per source: target_share, share, n_docs and n_tokens it has, rate, used_docs, used_tokens and reached (its share
    of all used tokens)."""
    used = mixed.groupBy("source").agg(
        F.count("*").alias("used_docs"), F.sum(F.col("n_tokens") * F.col("n_copies")).alias("used_tokens")
    )
    whole = used.agg(F.sum("used_tokens").alias("_all"))
    return (
        rates.join(used, "source", "left")
        .crossJoin(F.broadcast(whole))
        .select(
            "source",
            "target_share",
            "share",
            "max_repeats",
            "n_docs",
            "n_tokens",
            "rate",
            F.coalesce("used_docs", F.lit(0)).alias("used_docs"),
            F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
            (F.coalesce("used_tokens", F.lit(0)) / F.col("_all")).alias("reached"),
        )
    )
