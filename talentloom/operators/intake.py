"""From files to records: ids, create rows, text gates, bulk intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talentloom import rules
from talentloom.functions.text import file_suffix, strip_ws


def record_id(*parts: Column) -> Column:
    """Deterministic id in UUID form from what identifies an upload; the same file gives the same id."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    pieces = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *pieces)


def stored_name(id_: Column, name: Column) -> Column:
    """Name under which an upload is kept: id and last suffix."""
    return F.concat(id_, file_suffix(name))


def moment(as_of: str | None) -> Column:
    """A fixed point in time, or the time of the micro-batch when none is given."""
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def create_records(files: DataFrame, as_of: str | None) -> DataFrame:
    """New rows with status ``processing``; needs path, file_name, file_size, file_type."""
    return (
        files.withColumn("id", record_id(F.col("path"), F.col("file_size")))
        .withColumn("processing_status", F.lit(rules.PROCESSING))
        .withColumn("uploaded_at", moment(as_of))
        .withColumn("stored_name", stored_name(F.col("id"), F.col("file_name")))
    )


def needs_ocr(df: DataFrame, text: str = "raw_text", min_chars: int = rules.MIN_TEXT_CHARS) -> DataFrame:
    """Add ``needs_ocr``: the text without outer white space is shorter than ``min_chars``."""
    return df.withColumn("needs_ocr", F.length(strip_ws(F.coalesce(F.col(text), F.lit("")))) < min_chars)


def text_gate(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``processing_status``: no text at all → ``parse_failed``; blank text passes."""
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    return df.withColumn("processing_status", F.when(empty, rules.PARSE_FAILED).otherwise(rules.AI_PROCESSING))


def bulk_accept(df: DataFrame, batch: str, file: str, max_files: int = rules.BULK_LIMIT) -> DataFrame:
    """Add ``accepted`` and ``reason``: per batch the first ``max_files`` files by ``file`` are taken, files of equal name one by one.

    Files of a batch with one name are numbered. The accepted files are found by a
    ranked limit, which Spark applies in every task before the shuffle, and marked
    by a null-safe join on batch, file and number. A huge batch is spread by its
    files and never sorted as a whole; files without a batch form one.
    """
    same = Window.partitionBy(batch, file).orderBy(F.xxhash64(*df.columns))
    numbered = df.withColumn("_copy", F.row_number().over(same))
    rank = F.row_number().over(Window.partitionBy(batch).orderBy(file, "_copy"))
    first = (
        numbered.select(batch, file, "_copy").withColumn("_rank", rank).filter(F.col("_rank") <= max_files)
        .select(*[F.col(c).alias(f"_first_{k}") for k, c in enumerate((batch, file, "_copy"))], F.lit(True).alias("accepted"))
    )
    accepted = F.coalesce("accepted", F.lit(False))
    place = [F.col(c).eqNullSafe(F.col(f"_first_{k}")) for k, c in enumerate((batch, file, "_copy"))]
    return (
        numbered.join(first, place, "left").drop("_copy", "_first_0", "_first_1", "_first_2")
        .withColumn("accepted", accepted)
        .withColumn("reason", F.when(~F.col("accepted"), F.lit(f"Batch exceeds the limit of {max_files} files")))
    )


def bulk_report(judged: DataFrame, batch: str) -> DataFrame:
    """Total, accepted and rejected files per batch."""
    return judged.groupBy(batch).agg(
        F.count("*").alias("total_files"),
        F.count_if("accepted").alias("accepted_files"),
        F.count_if(~F.col("accepted")).alias("rejected_files"),
    )


def bulk_rejections(judged: DataFrame, batch: str, file: str) -> DataFrame:
    """One row per rejected file with its reason."""
    return judged.filter(~F.col("accepted")).select(batch, F.col(file).alias("file"), "reason")


def check_intake(submitted: DataFrame, accepted: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """(problem, n) for accepted ∪ rejected = submitted; no rows when the books balance.

    One aggregation over the union of the three sides, in place of set operations
    with a shuffle each.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        flags = [F.lit(int(name == s)).alias(s) for s in ("submitted", "accepted", "rejected")]
        return df.select(F.col(key).alias("key"), *flags)

    seen = (
        side(submitted, "submitted")
        .unionByName(side(accepted, "accepted"))
        .unionByName(side(rejected, "rejected"))
        .groupBy("key")
        .agg(*[F.sum(s).alias(s) for s in ("submitted", "accepted", "rejected")])
    )
    judged = F.col("accepted") + F.col("rejected")
    problem = (
        F.when((F.col("submitted") > 0) & (judged == 0), "lost")
        .when((F.col("submitted") == 0) & (judged > 0), "unknown")
        .when((F.col("accepted") > 0) & (F.col("rejected") > 0), "both")
        .when(judged > F.col("submitted"), "repeated")
    )
    return seen.select(problem.alias("problem")).filter("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))
