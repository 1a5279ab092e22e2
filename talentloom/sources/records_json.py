"""JSON form of nested records, prompts for an outside model, landed model answers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F, types as T

from talentloom import schemas

_JSON = {"ignoreNullFields": "false"}

INSTRUCTIONS = {
    "parse": "Read the resume text and return one JSON object which follows the schema. Return JSON only.",
    "bias": "List wording in the resume text that may lead to unfair screening (gender, age, origin, family). "
            "Return one JSON object which follows the schema.",
    "anonymize": "Return the JSON record unchanged, with every field of personalInfo.name and personalInfo.contact "
                 "replaced by [REDACTED].",
    "salary": "Estimate a salary range for the record, in the currency of its country (USD when redacted). "
              "Return one JSON object which follows the schema.",
    "career": "Name 3 to 5 next job titles and 2 to 3 skills to learn for the record. "
              "Return one JSON object which follows the schema.",
    "match": "Score the candidate record against the job by category. Return one JSON object which follows the schema.",
}


def prompt_head(kind: str) -> str:
    """Instruction and JSON schema, the same for every record of a kind."""
    shape = schemas.json_schema(schemas.RESPONSE[kind], schemas.REQUIRED[kind])
    return f"{INSTRUCTIONS[kind]}\nSchema:\n{json.dumps(shape)}\nInput:\n"


def build_prompts(df: DataFrame, kind: str, payload: Column, id_col: str = "id") -> DataFrame:
    """(id, kind, prompt): one prompt per record with its whole payload."""
    if kind not in INSTRUCTIONS:
        raise ValueError(f"kind must be one of {sorted(INSTRUCTIONS)}")
    return df.select(
        F.col(id_col).alias("id"),
        F.lit(kind).alias("kind"),
        F.concat(F.lit(prompt_head(kind)), F.coalesce(payload, F.lit(""))).alias("prompt"),
    )


def record_json(record: Column) -> Column:
    """JSON text of a nested record; absent fields appear as null."""
    return F.to_json(record, _JSON)


def to_record_json(df: DataFrame, record: str = "structured_data") -> DataFrame:
    return df.withColumn(record, record_json(F.col(record)))


def from_record_json(df: DataFrame, record: str = "structured_data", schema: T.DataType = schemas.DOC) -> DataFrame:
    return df.withColumn(record, F.from_json(record, schema))
