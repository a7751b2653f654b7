"""Files whose bytes are known, by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.schema import as_findings
from tidesift.session import small_side


def with_digest(files: DataFrame) -> DataFrame:
    """The files with sha256, lower-case hexadecimal, of their bytes; null for null content."""
    return files.withColumn("sha256", F.sha2("content", 256))


def last_signatures(signatures: DataFrame) -> DataFrame:
    """One signature per value: the last one by ordinal."""
    keep = F.max_by(F.struct(*[c for c in signatures.columns if c != "value"]), "ordinal")
    return signatures.groupBy("value").agg(keep.alias("_s")).select("value", "_s.*")


def digest_findings(files: DataFrame, signatures: DataFrame) -> DataFrame:
    """A critical finding per file whose digest a signature has, whatever severity the signature names.

    Null content matches nothing; each delivery of a file gives its own finding; a value with several signatures
    matches the last. Only path and digest reach the join, never the bytes.
    """
    known = last_signatures(signatures)
    hits = with_digest(files).select("target", "rel_path", "sha256").join(small_side(known), F.col("sha256") == F.col("value"))
    return as_findings(
        hits,
        "L0",
        "hash",
        severity=F.lit("critical"),
        category=F.lit("known_malware"),
        title=F.concat(F.lit("File is known by its digest: "), "sig_id", F.lit(" ("), "sig_name", F.lit(")")),
        file=F.col("rel_path"),
        explanation=F.concat(
            F.lit("Its bytes are those of a catalogued sample. Categories: "), F.array_join("category", ", "), F.lit(".")
        ),
        references=F.coalesce("references", F.array().cast("array<string>")),
    )


def digest_groups(files: DataFrame) -> DataFrame:
    """Per digest that more than one file has: n_files, n_targets, n_owners and first_file_id."""
    owner = F.split("target", "/")[0]
    return (
        with_digest(files)
        .where("sha256 is not null")
        .groupBy("sha256")
        .agg(
            F.count("*").alias("n_files"),
            F.count_distinct("target").alias("n_targets"),
            F.count_distinct(owner).alias("n_owners"),
            F.min("file_id").alias("first_file_id"),
        )
        .where("n_files > 1")
    )
