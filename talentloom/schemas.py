"""Fixed schemas of the nested records as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B, D, L, TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.LongType(), T.TimestampType()


def obj(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


def arr(item: T.DataType) -> T.ArrayType:
    return T.ArrayType(item)


STRINGS = arr(S)
ADDRESS = obj(street=S, city=S, state=S, zipCode=S, country=S)
CONTACT = obj(email=S, phone=S, address=ADDRESS, linkedin=S, website=S)
NAME = obj(first=S, last=S, full=S)
PERSONAL_INFO = obj(name=NAME, contact=CONTACT)
SUMMARY = obj(text=S, careerLevel=S, industryFocus=S, yearsOfExperience=D)
ROLE = obj(title=S, company=S, location=S, start_date=S, end_date=S, current=B, duration=S, description=S,
           achievements=STRINGS, technologies=STRINGS)
DEGREE = obj(degree=S, field=S, institution=S, location=S, graduation_date=S, gpa=D, honors=STRINGS)
TECHNICAL = obj(category=S, items=STRINGS)
LANGUAGE = obj(language=S, proficiency=S)
SKILLS = obj(technical=arr(TECHNICAL), soft=STRINGS, languages=arr(LANGUAGE))
CERTIFICATION = obj(name=S, issuer=S, issueDate=S, expiryDate=S, credentialId=S)
DOC = obj(personalInfo=PERSONAL_INFO, summary=SUMMARY, experience=arr(ROLE), education=arr(DEGREE),
          skills=SKILLS, certifications=arr(CERTIFICATION))

FINDING = obj(category=S, finding=S, suggestion=S)
BIAS_REPORT = obj(biasDetected=B, findings=arr(FINDING))
SALARY_ESTIMATE = obj(min=I, max=I, currency=S, comments=S)
CAREER = obj(suggestedNextRoles=STRINGS, improvementAreas=STRINGS, comments=S)
ENHANCEMENTS = obj(qualityScore=I, completenessScore=I, suggestions=STRINGS, industryFit=T.MapType(S, D),
                   biasReport=BIAS_REPORT, salaryEstimate=SALARY_ESTIMATE, anonymizedData=DOC,
                   careerProgression=CAREER)
# Scores a parse answer may carry itself; the other blocks have answers of their own.
PARSE_SCORES = ("qualityScore", "completenessScore", "suggestions", "industryFit")
PARSED = T.StructType(DOC.fields + [T.StructField("aiEnhancements", T.StructType([ENHANCEMENTS[n] for n in PARSE_SCORES]))])
SECTIONS = ("metadata", "personalInfo", "summary", "experience", "education", "skills", "certifications",
            "aiEnhancements")

RESUMES = obj(id=S, file_name=S, file_size=L, file_type=S, processing_status=S, uploaded_at=TS, processed_at=TS,
              raw_text=S, structured_data=DOC, ai_enhancements=ENHANCEMENTS)
JOB = obj(job_id=S, title=S, company=S, location=S, type=S, experience=obj(minimum=I, preferred=I, level=S),
          description=S, requirements=obj(required=STRINGS, preferred=STRINGS),
          skills=obj(required=STRINGS, preferred=STRINGS), salary=obj(min=I, max=I, currency=S),
          benefits=STRINGS, industry=S)
BINARY_FILE = T.StructType([
    T.StructField("path", S), T.StructField("modificationTime", TS), T.StructField("length", L),
    T.StructField("content", T.BinaryType()),
])

# ---- answers of an outside model ---------------------------------------------
# Numbers and flags are read as text first: from_json gives null for "5" or 3.0
# in an int field, while the record model accepts both. Certification dates come
# under either of two names, so both are read.
_GAP = obj(category=S, missing=S, impact=S, suggestion=S)
_SCORE = obj(score=S, weight=S, details=T.MapType(S, S))
RAW_RESPONSE = {
    "parse": obj(
        personalInfo=PERSONAL_INFO,
        summary=obj(text=S, careerLevel=S, industryFocus=S, yearsOfExperience=S),
        experience=arr(obj(title=S, company=S, location=S, start_date=S, end_date=S, current=S, duration=S,
                           description=S, achievements=STRINGS, technologies=STRINGS)),
        education=arr(obj(degree=S, field=S, institution=S, location=S, graduation_date=S, gpa=S, honors=STRINGS)),
        skills=SKILLS,
        certifications=arr(obj(name=S, issuer=S, issueDate=S, issue_date=S, expiryDate=S, expiry_date=S,
                               credentialId=S, credential_id=S)),
        aiEnhancements=obj(qualityScore=S, completenessScore=S, suggestions=STRINGS, industryFit=T.MapType(S, S)),
    ),
    "anonymize": DOC,
    "bias": obj(biasDetected=S, findings=arr(FINDING)),
    "salary": obj(min=S, max=S, currency=S, comments=S),
    "career": CAREER,
    "match": obj(
        matchId=S, resumeId=S, jobTitle=S, company=S,
        matchingResults=obj(
            overallScore=S, confidence=S, recommendation=S,
            categoryScores=obj(skillsMatch=_SCORE, experienceMatch=_SCORE, educationMatch=_SCORE,
                               roleAlignment=_SCORE, locationMatch=_SCORE),
            strengthAreas=STRINGS,
            gapAnalysis=obj(criticalGaps=arr(_GAP), improvementAreas=arr(_GAP)),
            salaryAlignment=obj(candidateExpectation=S, jobSalaryRange=S, marketRate=S, alignment=S),
            competitiveAdvantages=STRINGS,
        ),
        explanation=obj(summary=S, keyFactors=STRINGS, recommendations=STRINGS),
        metadata=obj(matchedAt=S, processingTime=S, algorithm=S, confidenceFactors=T.MapType(S, D)),
    ),
}
_TYPED_SCORE = obj(score=I, weight=I, details=T.MapType(S, S))
MATCH_ANSWER = obj(
    matchId=S, resumeId=S, jobTitle=S, company=S,
    matchingResults=obj(
        overallScore=I, confidence=D, recommendation=S,
        categoryScores=obj(skillsMatch=_TYPED_SCORE, experienceMatch=_TYPED_SCORE, educationMatch=_TYPED_SCORE,
                           roleAlignment=_TYPED_SCORE, locationMatch=_TYPED_SCORE),
        strengthAreas=STRINGS, gapAnalysis=obj(criticalGaps=arr(_GAP), improvementAreas=arr(_GAP)),
        salaryAlignment=obj(candidateExpectation=S, jobSalaryRange=S, marketRate=S, alignment=S), competitiveAdvantages=STRINGS,
    ),
    explanation=obj(summary=S, keyFactors=STRINGS, recommendations=STRINGS),
    metadata=obj(matchedAt=S, processingTime=D, algorithm=S, confidenceFactors=T.MapType(S, D)),
)
RESPONSE = {"parse": PARSED, "anonymize": DOC, "bias": BIAS_REPORT, "salary": SALARY_ESTIMATE, "career": CAREER, "match": MATCH_ANSWER}
# What an answer must hold to be valid, by kind and path; the same fields that validation asks for.
REQUIRED = {
    "parse": {"personalInfo.name": ["full"], "experience": ["title", "company"], "education": ["degree", "institution"],
              "skills.technical": ["category"], "skills.languages": ["language"], "certifications": ["name"]},
    "anonymize": {},
    "bias": {"findings": ["category", "finding", "suggestion"]},
    "salary": {"": ["comments"]},
    "career": {"": ["comments"]},
    "match": {
        "": ["matchId", "resumeId", "jobTitle", "matchingResults", "explanation", "metadata"],
        "matchingResults": ["overallScore", "confidence", "recommendation", "categoryScores", "gapAnalysis", "salaryAlignment"],
        **{f"matchingResults.categoryScores.{c}": ["score", "weight", "details"] for c in
           ("skillsMatch", "experienceMatch", "educationMatch", "roleAlignment", "locationMatch")},
        "matchingResults.categoryScores": ["skillsMatch", "experienceMatch", "educationMatch", "roleAlignment", "locationMatch"],
        "matchingResults.gapAnalysis.criticalGaps": ["category", "missing", "impact", "suggestion"],
        "matchingResults.gapAnalysis.improvementAreas": ["category", "missing", "impact", "suggestion"],
        "matchingResults.salaryAlignment": ["candidateExpectation", "jobSalaryRange", "alignment"],
        "explanation": ["summary"], "metadata": ["matchedAt", "processingTime", "algorithm"],
    },
}

# Types that the leaves of an answer are checked for; times are read leniently, and certification dates come under either name.
_METADATA = MATCH_ANSWER["metadata"].dataType
CHECKED = RESPONSE | {
    "parse": T.StructType([T.StructField("certifications", RAW_RESPONSE["parse"]["certifications"].dataType) if f.name == "certifications" else f for f in PARSED.fields]),
    "match": T.StructType([T.StructField("metadata", T.StructType([_METADATA["algorithm"], _METADATA["confidenceFactors"]])) if f.name == "metadata" else f
                           for f in MATCH_ANSWER.fields]),
}
# Fields that may be left out of an answer but not be null, by kind and path.
NOT_NULL = {
    "parse": {"skills.technical": ["items"]}, "anonymize": {}, "bias": {"": ["biasDetected", "findings"]}, "salary": {"": ["currency"]},
    "career": {"": ["suggestedNextRoles", "improvementAreas"]},
    "match": {"matchingResults": ["strengthAreas", "competitiveAdvantages"], "matchingResults.gapAnalysis": ["criticalGaps", "improvementAreas"],
              "explanation": ["keyFactors", "recommendations"]},
}


def leaves_as_variant(dtype: T.DataType) -> T.DataType:
    """A record type whose leaves, lists of leaves and maps are VARIANT: one read of an answer gives all its fields as they were written."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, leaves_as_variant(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return T.ArrayType(leaves_as_variant(dtype.elementType))
    return T.VariantType()


_JSON_NAMES = {"string": "string", "int": "integer", "bigint": "integer", "double": "number", "boolean": "boolean"}


def json_schema(dtype: T.DataType, required: dict[str, list[str]] | None = None, path: str = "") -> dict:
    """JSON-schema form of a record type, for the prompt data set; ``required`` lists mandatory fields by path."""
    required = required or {}
    if isinstance(dtype, T.StructType):
        inner = {f.name: json_schema(f.dataType, required, f"{path}.{f.name}".lstrip(".")) for f in dtype.fields}
        return {"type": "object", "properties": inner} | ({"required": required[path]} if path in required else {})
    if isinstance(dtype, T.ArrayType):
        return {"type": "array", "items": json_schema(dtype.elementType, required, path)}
    if isinstance(dtype, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(dtype.valueType, required, path)}
    return {"type": _JSON_NAMES[dtype.simpleString()]}
