"""Stored records: lookups, gates, assembly, overwrite, patch, delete, versions, status.

Lookups by id are left joins from the id set; no join carries a broadcast hint,
Spark broadcasts a side only when its measured size allows it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from talentloom import rules, schemas
from talentloom.functions.text import is_uuid
from talentloom.operators.intake import stored_name

NOT_FOUND, NOT_READY, NO_RESULT, OK, INVALID_ID = "not_found", "not_ready", "no_result", "ok", "invalid_id"


def one_per_id(df: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """One row per id: the one of the highest ``version``; without one, or on a tie, always the same row whatever the order of rows."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(c) for c in rest])
    order = F.struct(*([F.col(version)] if version else []), F.to_json(row))
    return df.groupBy(key).agg(F.max_by(row, order).alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in rest])


def check_uuid(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``id_outcome``: ok or invalid_id."""
    return df.withColumn("id_outcome", F.when(is_uuid(F.col(id_col)), OK).otherwise(INVALID_ID))


def _found(ids: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    hit = table.select("id", *columns, F.lit(True).alias("_found"))
    return ids.select("id").join(hit, "id", "left")


def lookup_status(resumes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, status, outcome for a set of ids."""
    hit = _found(ids, resumes, ["processing_status"])
    return hit.select(
        "id",
        F.col("processing_status").alias("status"),
        F.when(F.col("_found"), OK).otherwise(NOT_FOUND).alias("outcome"),
    )


def _gate(status: str) -> Column:
    done = F.col(status).eqNullSafe(rules.COMPLETED)
    return F.when(F.col("_found").isNull(), NOT_FOUND).when(~done, NOT_READY).otherwise(OK)


def retrieve(resumes: DataFrame, ids: DataFrame) -> DataFrame:
    """Full rows for a set of ids with ``outcome`` and ``status``; row data only where the outcome is ok."""
    data = [c for c in resumes.columns if c not in ("id", "processing_status")]
    hit = _found(ids, resumes, ["processing_status", *data]).withColumn("outcome", _gate("processing_status"))
    return hit.select(
        "id", "outcome", F.col("processing_status").alias("status"),
        *[F.when(F.col("outcome") == OK, F.col(c)).alias(c) for c in data],
    )


def resume_analytics(resumes: DataFrame, ids: DataFrame) -> DataFrame:
    """Only the enhancements, with the same gate; nothing else of a record is read."""
    hit = _found(ids, resumes, ["processing_status", "ai_enhancements"]).withColumn("outcome", _gate("processing_status"))
    return hit.select(
        "id", "outcome", F.col("processing_status").alias("status"),
        F.when(F.col("outcome") == OK, F.col("ai_enhancements")).alias("ai_enhancements"),
    )


def assemble_record(resumes: DataFrame) -> DataFrame:
    """Nested record from the flat row: a missing section is null, a missing list is empty."""
    doc = F.col("structured_data")

    def listed(name: str) -> Column:
        return F.coalesce(doc[name], F.array().cast(schemas.DOC[name].dataType)).alias(name)

    return resumes.select(
        "id",
        F.struct("file_name", "file_size", "uploaded_at", "processed_at").alias("metadata"),
        doc["personalInfo"].alias("personalInfo"),
        doc["summary"].alias("summary"),
        listed("experience"),
        listed("education"),
        doc["skills"].alias("skills"),
        listed("certifications"),
        F.col("ai_enhancements").alias("aiEnhancements"),
    )


def select_sections(records: DataFrame, include: list[str]) -> DataFrame:
    """Chosen sections of assembled records; an unknown name is an error."""
    unknown = sorted(set(include) - set(schemas.SECTIONS))
    if unknown:
        raise ValueError(f"unknown sections: {unknown}")
    return records.select("id", *[s for s in schemas.SECTIONS if s in include])


def ready_for_match(resumes: DataFrame) -> DataFrame:
    """Completed records which hold structured data."""
    return resumes.filter((F.col("processing_status") == rules.COMPLETED) & F.col("structured_data").isNotNull())


def match_payload(records: DataFrame) -> DataFrame:
    """Record for a match: without metadata, keyed by id."""
    body = [c for c in records.columns if c not in ("id", "metadata")]
    return records.select("id", F.struct(*body, "id").alias("payload"))


def split_enhancements(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Take ``aiEnhancements`` out of the record into its own column."""
    return (
        df.withColumn("ai_enhancements", F.col(doc)["aiEnhancements"])
        .withColumn("structured_data", F.col(doc).dropFields("aiEnhancements"))
        .drop(doc)
    )


def merge_block(df: DataFrame, name: str, blocks: DataFrame, version: str | None = None) -> DataFrame:
    """Put one enrichment block (id, block) in ``ai_enhancements``; of several blocks for an id, the one of the highest ``version``.

    A record without a block keeps its place with a null block; one without any
    enhancements and without a block stays as it is.
    """
    old = F.col("ai_enhancements")
    fields = F.struct(*[
        (F.col("_block") if f.name == name else old[f.name]).alias(f.name) for f in schemas.ENHANCEMENTS.fields
    ])
    merged = F.when(old.isNotNull() | F.col("_block").isNotNull(), fields)
    side = one_per_id(blocks, version=version).select("id", F.col("block").alias("_block"))
    return df.join(side, "id", "left").withColumn("ai_enhancements", merged).drop("_block")


def lookup_match_status(matches: DataFrame, ids: DataFrame) -> DataFrame:
    """match_id, status, outcome for a set of match ids."""
    hit = _found(ids, matches, ["status"])
    return hit.select(
        F.col("id").alias("match_id"), "status", F.when(F.col("_found"), OK).otherwise(NOT_FOUND).alias("outcome")
    )


def retrieve_match(matches: DataFrame, ids: DataFrame) -> DataFrame:
    """Match results with the outcomes not_found, not_ready, no_result, ok, tested in that order."""
    hit = _found(ids, matches, ["status", "match_result"])
    outcome = (
        F.when(F.col("_found").isNull(), NOT_FOUND)
        .when(~F.col("status").eqNullSafe(rules.COMPLETED), NOT_READY)
        .when(F.col("match_result").isNull(), NO_RESULT)
        .otherwise(OK)
    )
    return hit.withColumn("outcome", outcome).select(
        F.col("id").alias("match_id"), "status", "outcome",
        F.when(F.col("outcome") == OK, F.col("match_result")).alias("match_result"),
    )


def complete_matches(matches: DataFrame, results: DataFrame, as_of: str, version: str | None = None) -> DataFrame:
    """Enter results (match_id, result JSON text or null, error) in their match rows.

    A result completes the row; without one it fails and keeps ``{"error": …}``.
    Results for unknown matches have no effect. Of several results for a match the
    one of the highest ``version`` counts, without versions one that completes it.
    """
    if version is None:
        results, version = results.withColumn("_version", F.col("result").isNotNull()), "_version"
    side = one_per_id(results, "match_id", version).select(F.col("match_id").alias("id"), "result", "error", F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    good = F.col("result").isNotNull()
    failure = F.to_json(F.struct(F.coalesce("error", F.lit("")).alias("error")))
    return (
        matches.join(side, "id", "left")
        .withColumn("status", F.when(hit & good, rules.COMPLETED).when(hit, rules.FAILED).otherwise(F.col("status")))
        .withColumn("match_result", F.when(hit & good, F.col("result")).when(hit, failure).otherwise(F.col("match_result")))
        .withColumn("completed_at", F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("completed_at")))
        .drop("result", "error", "_hit")
    )


class StatusChange(NamedTuple):
    resumes: DataFrame
    status_events: DataFrame


def advance_status(resumes: DataFrame, changes: DataFrame, as_of: str, version: str | None = None) -> StatusChange:
    """Apply (id, status[, raw_text]) changes, one per id; processed_at is set on every change, also on failures."""
    now = F.lit(as_of).cast("timestamp")
    changes = one_per_id(changes, version=version)
    with_text = "raw_text" in changes.columns
    side = changes.select(
        "id", F.col("status").alias("_status"), *([F.col("raw_text").alias("_text")] if with_text else [])
    )
    hit = F.col("_status").isNotNull()
    out = (
        resumes.join(side, "id", "left")
        .withColumn("processing_status", F.coalesce("_status", "processing_status"))
        .withColumn("processed_at", F.when(hit, now).otherwise(F.col("processed_at")))
    )
    if with_text:
        out = out.withColumn("raw_text", F.when(hit, F.col("_text")).otherwise(F.col("raw_text")))
    events = changes.join(resumes.select("id"), "id", "left_semi").select("id", "status", now.alias("ts"))
    return StatusChange(out.drop("_status", "_text"), events)


def matches_with_resume(matches: DataFrame, resumes: DataFrame) -> DataFrame:
    """Match rows beside the record they refer to."""
    side = resumes.select(F.col("id").alias("resume_id"), *[F.col(c).alias(f"resume_{c}") for c in resumes.columns if c != "id"])
    return matches.join(side, "resume_id", "inner")


class Deleted(NamedTuple):
    remaining: DataFrame
    deleted: DataFrame
    files: DataFrame


def delete_records(resumes: DataFrame, ids: DataFrame) -> Deleted:
    """Rows that stay, rows that go, and the stored files to remove with them."""
    keys = ids.select("id")
    gone = resumes.join(keys, "id", "left_semi")
    files = gone.select("id", stored_name(F.col("id"), F.col("file_name")).alias("stored_name"))
    return Deleted(resumes.join(keys, "id", "left_anti"), gone, files)


def delete_outcome(resumes: DataFrame, ids: DataFrame) -> DataFrame:
    """What a caller is told per id."""
    hit = _found(ids, resumes, [])
    return hit.select("id", F.when(F.col("_found"), rules.DELETED).otherwise(rules.UNKNOWN_RESUME).alias("message"))


class ForeignKeys(NamedTuple):
    blocked: DataFrame
    orphans: DataFrame
    matches_left: DataFrame


def fk_violations(matches: DataFrame, resumes: DataFrame, deletes: DataFrame, cascade: bool = False) -> ForeignKeys:
    """Deletes that matches still refer to, matches whose record is gone already, matches after the delete.

    With ``cascade`` no delete is blocked and the matches of deleted records go as well.
    """
    refs = matches.select(F.col("resume_id").alias("id"))
    orphans = matches.join(resumes.select(F.col("id").alias("resume_id")), "resume_id", "left_anti")
    if cascade:
        left = matches.join(deletes.select(F.col("id").alias("resume_id")), "resume_id", "left_anti")
        return ForeignKeys(deletes.limit(0), orphans, left)
    return ForeignKeys(deletes.join(refs, "id", "left_semi"), orphans, matches)


def overwrite_records(resumes: DataFrame, updates: DataFrame, as_of: str, version: str | None = None) -> DataFrame:
    """Replace structured_data and ai_enhancements by id; absent enhancements become null, unknown ids do nothing, one update per id counts."""
    side = one_per_id(updates, version=version).select(
        "id", F.col("structured_data").alias("_doc"),
        (F.col("ai_enhancements") if "ai_enhancements" in updates.columns
         else F.lit(None).cast(resumes.schema["ai_enhancements"].dataType)).alias("_ai"),
        F.lit(True).alias("_hit"),
    )
    hit = F.col("_hit").isNotNull()

    def choose(new: Column, old: str) -> Column:
        return F.when(hit, new).otherwise(F.col(old))

    return (
        resumes.join(side, "id", "left")
        .withColumn("structured_data", choose(F.col("_doc"), "structured_data"))
        .withColumn("ai_enhancements", choose(F.col("_ai"), "ai_enhancements"))
        .withColumn("processing_status", choose(F.lit(rules.COMPLETED), "processing_status"))
        .withColumn("processed_at", choose(F.lit(as_of).cast("timestamp"), "processed_at"))
        .drop("_doc", "_ai", "_hit")
    )


def overwrite_outcome(resumes: DataFrame, updates: DataFrame) -> DataFrame:
    """ok or not_found per update."""
    return lookup_status(resumes, updates).select("id", "outcome")


def _patched(old: Column, new: Column, dtype) -> Column:
    """Every leaf given in ``new`` replaces the one in ``old``; structs are walked, lists replaced whole."""
    if hasattr(dtype, "fields"):
        inner = F.struct(*[_patched(old[f.name], new[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(new.isNull(), old).otherwise(inner)
    return F.coalesce(new, old)


def _patched_rows(old: Column, new: Column, item, keys: tuple[str, ...]) -> Column:
    """Rows with a known key are patched in place, rows with a new key follow at the end."""
    def same(a: Column, b: Column) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & a[k].eqNullSafe(b[k])
        return out

    def patch(row: Column) -> Column:
        hit = F.get(F.filter(new, lambda n: same(n, row)), F.lit(0))
        return F.coalesce(_patched(row, hit, item), row)

    added = F.filter(new, lambda n: ~F.exists(old, lambda row: same(n, row)))
    whole = F.concat(F.transform(old, patch), added)
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(whole)


def patch_records(resumes: DataFrame, patches: DataFrame, as_of: str, keys: tuple[str, ...] = ("title", "company", "start_date"),
                  version: str | None = None) -> DataFrame:
    """Change only the given fields of structured_data; experience rows are matched by ``keys``, so two stints of one title stay apart.

    One join on id, one patch per id; the lists are patched inside the row, without exploding them.
    """
    side = one_per_id(patches, version=version).select("id", F.col("structured_data").alias("_new"), F.lit(True).alias("_hit"))
    old, new, hit = F.col("structured_data"), F.col("_new"), F.col("_hit").isNotNull()

    def section(field) -> Column:
        if field.name == "experience":
            return _patched_rows(old[field.name], new[field.name], field.dataType.elementType, keys)
        return _patched(old[field.name], new[field.name], field.dataType)

    merged = F.struct(*[section(f).alias(f.name) for f in schemas.DOC.fields])
    return (
        resumes.join(side, "id", "left")
        .withColumn("processed_at", F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("processed_at")))
        .withColumn("structured_data", F.when(hit & new.isNotNull(), merged).otherwise(old))
        .drop("_new", "_hit")
    )


def latest_status(status_events: DataFrame, key: str = "resume_id") -> DataFrame:
    """Status of the latest event per record, by (ts, event_id).

    An aggregate with map-side combine: a record with very many events sends one
    row per task, and nothing is sorted per record.
    """
    order = F.struct("ts", "event_id")
    return status_events.groupBy(key).agg(
        F.max_by("status", order).alias("status"), F.max("ts").alias("ts"), F.count("*").alias("n_events")
    )


def merge_versions(ai_rows: DataFrame, manual_rows: DataFrame, version: str = "version") -> DataFrame:
    """Union of model-made and manual rows; per id the highest version wins, a manual row on a tie."""
    both = ai_rows.withColumn("origin", F.lit("ai")).unionByName(
        manual_rows.withColumn("origin", F.lit("manual")), allowMissingColumns=True
    )
    row = F.struct(*[c for c in both.columns if c != "id"])
    return both.groupBy("id").agg(F.max_by(row, F.struct(version, "origin")).alias("_row")).select("id", "_row.*")
