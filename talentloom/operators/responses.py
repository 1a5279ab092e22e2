"""Answers of an outside model, landed as text: clean, parse, validate, merge.

A text is parsed once, to a VARIANT. Everything else is read from that: the fields of
a kind as text, the kind of every leaf as it was written, and explicit nulls.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F, types as T

from talentloom import rules, schemas
from talentloom.functions.dates import parse_ts
from talentloom.functions.text import is_uuid, strip_fence
from talentloom.functions.values import as_array, empty_strings, lenient_int, let


def parse_json(df: DataFrame, kind: str, text: str = "response") -> DataFrame:
    """Add ``answer`` (the object as VARIANT), ``raw`` (the fields of the kind as read) and ``parse_ok``.

    The text is parsed as the first of two items of a list; the second is a hash of
    the text, so nothing of the text can end the list before it. Of a repeated key
    the last value counts; VARIANT refuses such objects, so they are read by the
    fields of the kind and written anew.
    """
    body = F.col(text)
    end = F.xxhash64(body).cast("string")
    listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), end, F.lit('"]')))
    whole = (F.try_variant_get(F.col("_listed"), "$[1]", "string") == F.xxhash64(body).cast("string")) & body.rlike(r"^\s*\{")
    bare = F.regexp_replace(body, r'"(?:[^"\\]|\\.)*"', "")
    strict = body.rlike(r"^\s*\{[\s\S]*\}\s*$") & (F.json_array_length(F.concat(F.lit("["), body, F.lit(",0]"))) == 2) & ~bare.contains("'")
    again = F.to_json(F.from_json(body, schemas.RAW_RESPONSE[kind], {"allowSingleQuotes": "false"}))
    object_ = F.when(whole, F.try_variant_get(F.col("_listed"), "$[0]", "variant")).when(
        F.col("_listed").isNull() & body.rlike(_TWO_KEYS) & strict, F.try_parse_json(again))
    read = df.withColumn("_listed", listed).withColumn("answer", object_).drop("_listed")
    raw = F.try_variant_get("answer", "$", schemas.RAW_RESPONSE[kind].simpleString())
    return read.withColumn("parse_ok", F.col("answer").isNotNull()).withColumn("raw", F.when(F.col("answer").isNotNull(), raw))


#: A key that stands in a text twice; a cheap test before a text that VARIANT refuses is looked at again.
_TWO_KEYS = r'("[^"\\]*"\s*:)[\s\S]*\1'


def _explicit_null(answer: Column, path: str) -> Column:
    """The answer holds this field with the value null."""
    return F.coalesce(F.is_variant_null(F.try_variant_get(answer, path, "variant")), F.lit(False))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _absent(value: Column) -> Column:
    """A field that is missing or null."""
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))


def _is_list(value: Column, fits) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    return let(items, lambda held: held.isNotNull() & F.coalesce(F.forall(held, fits), F.lit(True)))


def _is_text(value: Column) -> Column:
    return F.coalesce(_kind(value) == "STRING", F.lit(False))


def _is_number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string").try_cast("double").isNotNull()


def _leaf_fits(value: Column, dtype: T.DataType, path: str) -> Column:
    """Whether a leaf that is there was written as its type asks; numbers and flags are left to the checks of their text."""
    if path.endswith("improvementAreas.missing"):  # one text or a list of them
        return _is_text(value) | _is_list(value, _is_text)
    if isinstance(dtype, T.StringType):
        return _is_text(value)
    if isinstance(dtype, T.ArrayType):
        return _is_list(value, _is_text)
    if isinstance(dtype, T.MapType):
        held = F.try_variant_get(value, "$", "map<string,variant>")
        if isinstance(dtype.valueType, T.DoubleType):
            return let(held, lambda m: m.isNotNull() & F.coalesce(F.forall(F.map_values(m), _is_number), F.lit(True)))
        return held.isNotNull()
    return F.lit(True)


def _types_fit(value: Column, dtype: T.DataType, kind: str, path: str = "") -> Column:
    """Whether every leaf below a struct, or the structs of a list, fits; what is missing or null fits unless it must not be null."""
    if isinstance(dtype, T.StructType):
        strict = schemas.NOT_NULL[kind].get(path, [])

        def field(f: T.StructField) -> Column:
            at = f"{path}.{f.name}".lstrip(".")
            inner = value[f.name]
            if isinstance(f.dataType, T.StructType) or (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)):
                return _types_fit(inner, f.dataType, kind, at)
            null = F.lit(False) if f.name in strict else F.lit(True)
            return F.when(inner.isNull(), True).when(F.is_variant_null(inner), null).otherwise(_leaf_fits(inner, f.dataType, at))

        fits = functools.reduce(lambda a, b: a & b, [field(f) for f in dtype.fields])
        return F.when(value.isNull(), True).otherwise(fits)
    items = F.forall(value, lambda item: item.isNotNull() & _types_fit(item, dtype.elementType, kind, path))
    return F.coalesce(items, F.lit(True))


def _holders(dtype: T.StructType, path: str = "") -> list[tuple[str, T.DataType]]:
    """Paths of the structs and lists of structs that do not stand in a list."""
    out = []
    for f in dtype.fields:
        at = f"{path}.{f.name}".lstrip(".")
        if isinstance(f.dataType, T.StructType):
            out += [(at, f.dataType), *_holders(f.dataType, at)]
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out.append((at, f.dataType))
    return out


def _well_formed(kind: str, answer: Column, given: tuple[str, ...] = ()) -> Column:
    """Objects and lists where the kind has them, texts and lists of texts where it asks for text; nulls where they may be.

    Top-level fields that are ``given`` from elsewhere are not looked at.
    """
    dtype = T.StructType([f for f in schemas.CHECKED[kind].fields if f.name not in given])

    def holder(form: Column, path: str, held: T.DataType) -> Column:
        # what could be read in its form is an object or a list; only the others are looked up by their path
        read = functools.reduce(lambda value, name: value[name], path.split("."), form)
        return F.when(read.isNotNull(), True).otherwise(looked_up(path, held))

    def looked_up(path: str, held: T.DataType) -> Column:
        parent, _, name = path.rpartition(".")
        null = F.lit(False) if name in schemas.NOT_NULL[kind].get(parent, []) else F.lit(True)
        shallow = "map<string,variant>" if isinstance(held, T.StructType) else "array<variant>"
        value = F.try_variant_get(answer, f"$.{path}", "variant")
        return F.when(value.isNull(), True).when(F.is_variant_null(value), null).otherwise(F.try_variant_get(answer, f"$.{path}", shallow).isNotNull())

    form = F.try_variant_get(answer, "$", schemas.leaves_as_variant(dtype).simpleString())
    return let(form, lambda value: functools.reduce(lambda a, b: a & b, [*[holder(value, p, d) for p, d in _holders(dtype)], _types_fit(value, dtype, kind)]))


def _all_have(rows: Column, *fields: str) -> Column:
    def whole(row: Column) -> Column:
        out = row.isNotNull()
        for f in fields:
            out = out & row[f].isNotNull()
        return out

    return F.coalesce(F.forall(rows, whole), F.lit(True))


def _optional_int(text: Column) -> Column:
    """True when absent or readable as int."""
    return text.isNull() | lenient_int(text).isNotNull()


def _optional_number(text: Column) -> Column:
    return text.isNull() | text.try_cast("double").isNotNull()


def _flag(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("true", "1", "yes", "on", "y", "t"), True).when(low.isin("false", "0", "no", "off", "n", "f"), False)


def _optional_flag(text: Column) -> Column:
    return text.isNull() | _flag(text).isNotNull()


def _valid(kind: str, r: Column, given: tuple[str, ...] = ()) -> Column:
    """Required fields are there, numbers and flags can be read."""
    if kind == "anonymize":
        return F.lit(True)  # any JSON object will do
    if kind == "parse":
        name = r["personalInfo"]["name"]
        ok = (
            (name.isNull() | name["full"].isNotNull())
            & _all_have(r["experience"], "title", "company")
            & _all_have(r["education"], "degree", "institution")
            & _all_have(r["skills"]["technical"], "category")
            & _all_have(r["skills"]["languages"], "language")
            & _all_have(r["certifications"], "name")
        )
        scores = r["aiEnhancements"]
        fits = F.map_values(scores["industryFit"])
        return (
            ok & F.coalesce(F.forall(r["education"], lambda e: _optional_number(e["gpa"])), F.lit(True))
            & F.coalesce(F.forall(r["experience"], lambda e: _optional_flag(e["current"])), F.lit(True))
            & _optional_int(scores["qualityScore"]) & _optional_int(scores["completenessScore"])
            & F.coalesce(F.forall(fits, lambda v: v.try_cast("double").isNotNull()), F.lit(True))
        )
    if kind == "bias":
        return _optional_flag(r["biasDetected"]) & _all_have(r["findings"], "category", "finding", "suggestion")
    if kind == "salary":
        return r["comments"].isNotNull() & _optional_int(r["min"]) & _optional_int(r["max"])
    if kind == "career":
        return r["comments"].isNotNull()
    if kind == "match":
        m = r["matchingResults"]
        ok = is_uuid(r["matchId"]) & r["jobTitle"].isNotNull()
        if "resumeId" not in given:
            ok = ok & is_uuid(r["resumeId"])
        ok = ok & lenient_int(m["overallScore"]).isNotNull() & m["confidence"].try_cast("double").isNotNull()
        ok = ok & m["recommendation"].isNotNull() & m["gapAnalysis"].isNotNull()
        for c in schemas.RAW_RESPONSE["match"]["matchingResults"].dataType["categoryScores"].dataType.names:
            part = m["categoryScores"][c]
            ok = ok & lenient_int(part["score"]).isNotNull() & lenient_int(part["weight"]).isNotNull() & part["details"].isNotNull()
        for f in ("candidateExpectation", "jobSalaryRange", "alignment"):
            ok = ok & m["salaryAlignment"][f].isNotNull()
        for g in ("criticalGaps", "improvementAreas"):
            ok = ok & _all_have(m["gapAnalysis"][g], "category", "missing", "impact", "suggestion")
        meta = r["metadata"]
        return (
            ok & r["explanation"]["summary"].isNotNull() & meta["matchedAt"].isNotNull()
            & meta["processingTime"].try_cast("double").isNotNull() & meta["algorithm"].isNotNull()
        )
    raise ValueError(f"unknown kind {kind}")


def _listed(rows: Column, answer: Column, path: str, dtype) -> Column:
    """A missing list is empty, an explicit null stays null."""
    return F.when(rows.isNull() & ~_explicit_null(answer, path), F.array().cast(dtype)).otherwise(rows)


def _strings(value: Column) -> Column:
    return F.coalesce(value, empty_strings())


def _scores(e: Column, answer: Column) -> Column:
    fit = F.transform_values(e["industryFit"], lambda _, v: v.try_cast("double"))
    none = F.create_map().cast("map<string,double>")
    return F.struct(
        lenient_int(e["qualityScore"]).alias("qualityScore"), lenient_int(e["completenessScore"]).alias("completenessScore"),
        _listed(e["suggestions"], answer, "$.aiEnhancements.suggestions", schemas.STRINGS).alias("suggestions"),
        F.when(fit.isNull() & ~_explicit_null(answer, "$.aiEnhancements.industryFit"), none).otherwise(fit).alias("industryFit"),
    )


def _typed(kind: str, r: Column, answer: Column, as_of: str) -> Column:
    if kind == "parse":
        experience = F.transform(r["experience"], lambda e: e.withField("current", F.coalesce(_flag(e["current"]), F.lit(False)))
                                 .withField("achievements", _strings(e["achievements"]))
                                 .withField("technologies", _strings(e["technologies"])))
        education = F.transform(r["education"], lambda e: e.withField("gpa", e["gpa"].try_cast("double"))
                                .withField("honors", _strings(e["honors"])))
        technical = F.transform(r["skills"]["technical"], lambda t: t.withField("items", _strings(t["items"])))
        certifications = F.transform(r["certifications"], lambda c: F.struct(
            c["name"].alias("name"), c["issuer"].alias("issuer"),
            F.coalesce(c["issueDate"], c["issue_date"]).alias("issueDate"),
            F.coalesce(c["expiryDate"], c["expiry_date"]).alias("expiryDate"),
            F.coalesce(c["credentialId"], c["credential_id"]).alias("credentialId"),
        ))
        skills = F.when(r["skills"].isNotNull(), F.struct(
            _listed(technical, answer, "$.skills.technical", schemas.arr(schemas.TECHNICAL)).alias("technical"),
            _listed(r["skills"]["soft"], answer, "$.skills.soft", schemas.STRINGS).alias("soft"),
            _listed(r["skills"]["languages"], answer, "$.skills.languages", schemas.arr(schemas.LANGUAGE)).alias("languages"),
        ))
        years = r["summary"]["yearsOfExperience"].try_cast("double")
        return F.struct(
            r["personalInfo"].alias("personalInfo"),
            F.when(r["summary"].isNotNull(), r["summary"].withField("yearsOfExperience", years)).alias("summary"),
            _listed(experience.cast(schemas.arr(schemas.ROLE)), answer, "$.experience", schemas.arr(schemas.ROLE)).alias("experience"),
            _listed(education.cast(schemas.arr(schemas.DEGREE)), answer, "$.education", schemas.arr(schemas.DEGREE)).alias("education"),
            skills.alias("skills"),
            _listed(certifications, answer, "$.certifications", schemas.arr(schemas.CERTIFICATION)).alias("certifications"),
            F.when(r["aiEnhancements"].isNotNull(), _scores(r["aiEnhancements"], answer)).alias("aiEnhancements"),
        ).cast(schemas.PARSED)
    if kind == "bias":
        return F.struct(
            F.coalesce(_flag(r["biasDetected"]), F.lit(False)).alias("biasDetected"),
            F.coalesce(r["findings"], F.array().cast(schemas.arr(schemas.FINDING))).alias("findings"),
        )
    if kind == "salary":
        return F.struct(
            lenient_int(r["min"]).alias("min"), lenient_int(r["max"]).alias("max"),
            F.coalesce(r["currency"], F.lit(rules.DEFAULT_CURRENCY)).alias("currency"), r["comments"].alias("comments"),
        )
    if kind == "career":
        return F.struct(
            _strings(r["suggestedNextRoles"]).alias("suggestedNextRoles"),
            _strings(r["improvementAreas"]).alias("improvementAreas"), r["comments"].alias("comments"),
        )
    if kind == "match":
        m = r["matchingResults"]
        parts = schemas.RAW_RESPONSE["match"]["matchingResults"].dataType["categoryScores"].dataType.names
        scores = F.struct(*[
            F.struct(
                lenient_int(m["categoryScores"][c]["score"]).alias("score"),
                lenient_int(m["categoryScores"][c]["weight"]).alias("weight"),
                m["categoryScores"][c]["details"].alias("details"),
            ).alias(c) for c in parts
        ])
        areas = F.transform(m["gapAnalysis"]["improvementAreas"], lambda g: g.withField("missing", as_array(g["missing"])))
        results = (
            m.withField("overallScore", lenient_int(m["overallScore"]))
            .withField("confidence", m["confidence"].try_cast("double"))
            .withField("categoryScores", scores)
            .withField("gapAnalysis", m["gapAnalysis"].withField("improvementAreas", areas))
        )
        meta = (
            r["metadata"].withField("matchedAt", parse_ts(r["metadata"]["matchedAt"], as_of))
            .withField("processingTime", r["metadata"]["processingTime"].try_cast("double"))
        )
        return r.withField("matchingResults", results).withField("metadata", meta)
    return r


def validate(df: DataFrame, kind: str, as_of: str = "1970-01-01", given: tuple[str, ...] = ()) -> DataFrame:
    """Add ``valid`` and ``record``: required fields present, every leaf of its type, defaults filled, unknown fields dropped."""
    fits = F.lit(True) if kind == "anonymize" else _well_formed(kind, F.col("answer"), given) & _valid(kind, F.col("raw"), given)  # any object will do there
    checked = df.withColumn("valid", F.col("parse_ok") & F.coalesce(fits, F.lit(False)))
    return checked.withColumn("record", F.when(F.col("valid"), _typed(kind, F.col("raw"), F.col("answer"), as_of)))


def _error() -> Column:
    return F.when(~F.col("parse_ok"), "not a JSON object").when(~F.col("valid"), "required fields missing or wrong")


def ingest_responses(df: DataFrame, kind: str, text: str = "response", as_of: str = "1970-01-01") -> DataFrame:
    """(…, response) → (…, valid, error, record): fence off, strict JSON, required fields, defaults."""
    cleaned = df.withColumn(text, strip_fence(F.col(text)))
    return validate(parse_json(cleaned, kind, text), kind, as_of).withColumn("error", _error()).drop("answer", "raw", "parse_ok", text)


BLOCKS = {"bias": "biasReport", "anonymize": "anonymizedData", "salary": "salaryEstimate", "career": "careerProgression"}


def apply_failure_policy(responses: DataFrame, attempt: str = "attempt") -> DataFrame:
    """(id, kind, attempt, response) → one row per id with status, structured_data and ai_enhancements.

    A bad main answer (kind ``parse``) fails the record; a bad or missing block
    is null and the record goes on. All answers of a record meet in a single
    aggregation (last attempt per kind) instead of a join per block.
    """
    kinds = ["parse", *BLOCKS]
    latest = responses.groupBy("id").agg(*[
        F.max_by(F.when(F.col("kind") == k, F.col("response")), F.when(F.col("kind") == k, F.col(attempt))).alias(f"_{k}")
        for k in kinds
    ])
    out = latest
    for k in kinds:
        read = ingest_responses(out.withColumnRenamed(f"_{k}", "response"), k)
        out = read.withColumnRenamed("record", f"_{k}_record").withColumnRenamed("valid", f"_{k}_valid").drop("error")
    good, main = F.col("_parse_valid"), F.col("_parse_record")
    blocks = {block: F.col(f"_{k}_record") for k, block in BLOCKS.items()}
    enhancements = F.struct(*[
        (blocks[f.name] if f.name in blocks else main["aiEnhancements"][f.name]).cast(f.dataType).alias(f.name)
        for f in schemas.ENHANCEMENTS.fields
    ])
    return out.select(
        "id",
        F.when(good, rules.COMPLETED).otherwise(rules.AI_FAILED).alias("processing_status"),
        F.when(good, main.dropFields("aiEnhancements")).alias("structured_data"),
        F.when(good, enhancements).alias("ai_enhancements"),
    )


_ECHOED = ("resumeId", "jobTitle", "company")


def override_echoed(answers: DataFrame, inputs: DataFrame) -> DataFrame:
    """Take resumeId, jobTitle and company from the inputs, never from the answer; processingTime is measured.

    ``answers``: match_id, raw, started_at, finished_at. ``inputs``: match_id, resume_id, job_title, company.
    """
    side = inputs.select("match_id", "resume_id", "job_title", F.col("company").alias("_company"))
    seconds = F.round((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6, 3)
    raw = F.col("raw")
    meta = F.coalesce(raw["metadata"], F.struct(*[
        F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.RAW_RESPONSE["match"]["metadata"].dataType.fields
    ]))
    fixed = (
        raw.withField("resumeId", F.col("resume_id").cast("string"))
        .withField("jobTitle", F.col("job_title")).withField("company", F.col("_company"))
        .withField("metadata", meta.withField("processingTime", seconds.cast("string")))
    )
    return answers.join(side, "match_id", "inner").withColumn("raw", fixed).drop("resume_id", "job_title", "_company")


def ingest_matches(answers: DataFrame, inputs: DataFrame, as_of: str, text: str = "response") -> DataFrame:
    """(match_id, response, started_at, finished_at) → (match_id, valid, error, record): parsed, keys of the inputs put in, checked.

    The answer's own matchId must be a UUID; resumeId, jobTitle, company and the
    measured processingTime come from the inputs, so what it says there is not looked at.
    """
    parsed = parse_json(answers.withColumn(text, strip_fence(F.col(text))), "match", text)
    return validate(override_echoed(parsed, inputs), "match", as_of, _ECHOED).withColumn("error", _error()).select("match_id", "valid", "error", "record")
