"""Constants of the engine: limits, status names, word lists, weights, patterns.

Every rule that decides a result lives here, so that operators, tests and SQL
oracles read the same values. Patterns keep to the syntax shared by Java regex
and RE2 unless a comment says otherwise.
"""

from __future__ import annotations

# ---- intake limits (fixed values) -----------------------------------------
MAX_FILE_BYTES = 10 * 1024 * 1024
BULK_LIMIT = 50
MIN_TEXT_CHARS = 100
REQUESTS_PER_HOUR = 1000
STUCK_AFTER_SECONDS = 120
STEP_SHARES = (10, 50, 100)

# ---- messages (fixed values) -----------------------------------------------
TOO_LARGE = "File size exceeds the %gMB limit. File size: %.2f MB"
DELETED = "Resume deleted successfully"
UNKNOWN_RESUME = "Resume not found"

# ---- media types (fixed values) --------------------------------------------
MEDIA_PDF = "application/pdf"
MEDIA_DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MEDIA_DOC = "application/msword"
MEDIA_TEXT = "text/plain"
MEDIA_IMAGE_PREFIX = "image/"
MEDIA_BY_SUFFIX = {
    "pdf": MEDIA_PDF,
    "docx": MEDIA_DOCX,
    "doc": MEDIA_DOC,
    "txt": MEDIA_TEXT,
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
}
MEDIA_UNKNOWN = "application/octet-stream"
SUPPORTED_SUFFIXES = ("pdf", "docx", "doc", "txt", "jpg", "png")

# ---- status names (fixed values) -------------------------------------------
PENDING = "pending"
PROCESSING = "processing"
AI_PROCESSING = "ai_processing"
COMPLETED = "completed"
FAILED = "failed"
PARSE_FAILED = "parse_failed"
AI_FAILED = "ai_failed"
SAVE_FAILED = "save_failed"
QUEUE_FAILED = "queue_failed"
FAILURE_STATUSES = (PARSE_FAILED, AI_FAILED, SAVE_FAILED, QUEUE_FAILED, FAILED)
TERMINAL_STATUSES = (COMPLETED, *FAILURE_STATUSES)
STEP_PROGRESS = {PROCESSING: STEP_SHARES[0], AI_PROCESSING: STEP_SHARES[1], **{s: STEP_SHARES[2] for s in TERMINAL_STATUSES}}

# ---- text ------------------------------------------------------------------
WHITESPACE = " \t\n\r\f\x0b"
REDACTED = "[REDACTED]"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}([ ./-]?\(?[0-9]{1,4}\)?){2,6}"
PROFILE_PATTERN = r"(https?://)?(www\.)?(linkedin\.com|github\.com)/[A-Za-z0-9_/.-]+"
LINKEDIN_PATTERN = r"(https?://)?(www\.)?linkedin\.com/[A-Za-z0-9_/.-]+"
WEBSITE_PATTERN = r"https?://[A-Za-z0-9_/.-]+"
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
WORD_SPLIT = r"[^\p{L}\p{N}_]+"

# ---- bias words (fixed values) ---------------------------------------------
BIAS_WORDS = {
    "Gender": ["he", "she", "his", "her", "him", "hers", "himself", "herself"],
    "Age": ["years old", "young", "aged"],
    "Ethnicity": ["nationality", "ethnic", "native of", "born in"],
    "Marital": ["married", "single", "divorced", "spouse", "children"],
}
BIAS_SUGGESTION = {
    "Gender": "Use neutral wording instead of gendered pronouns.",
    "Age": "Leave out age words and old graduation years.",
    "Ethnicity": "Leave out origin and nationality.",
    "Marital": "Leave out marital and family status.",
}
OLD_GRADUATION_YEARS = 10


def whole_words(phrase: str) -> str:
    """Pattern of a phrase between word boundaries; Java regex and RE2 read it alike."""
    return rf"(^|[^\p{{L}}\p{{N}}_]){phrase}($|[^\p{{L}}\p{{N}}_])"


# ---- stop words per language (fixed values) --------------------------------
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "it", "with", "as", "on", "are", "this", "by"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "ein", "eine", "von", "zu", "den", "für", "auf", "sich"],
    "es": ["el", "los", "las", "y", "que", "del", "una", "por", "con", "para", "se", "un", "es", "no", "lo"],
    "fr": ["le", "la", "les", "et", "des", "une", "est", "dans", "pour", "que", "qui", "du", "un", "sur", "pas"],
}

# ---- industry terms (fixed values) -----------------------------------------
INDUSTRY_TERMS = {
    "technology": ["software", "cloud", "python", "kubernetes", "api", "backend", "microservices", "sql"],
    "finance": ["banking", "trading", "audit", "portfolio", "ledger", "insurance", "tax", "treasury"],
    "healthcare": ["patient", "clinical", "hospital", "nursing", "medical", "pharma", "therapy", "diagnosis"],
    "consulting": ["strategy", "stakeholder", "advisory", "transformation", "workshop", "roadmap", "client", "engagement"],
}

# ---- headings of a resume -------------------------------------------------------
SECTION_NAMES = {
    "summary": ("summary", "profile", "objective", "about me"),
    "experience": ("experience", "employment", "work history", "career history"),
    "education": ("education", "academic background", "qualifications"),
    "skill": ("skill", "competenc"),
    "certification": ("certif", "licenses"),
}
HEADING_WORDS = ("professional summary", "executive summary", "career summary", "summary", "profile", "objective", "about me", "work experience",
                 "professional experience", "experience", "employment history", "employment", "work history", "career history", "education",
                 "academic background", "technical skills", "core skills", "key skills", "skills", "competencies", "certifications", "certificates",
                 "licenses and certifications")
SPOKEN_LANGUAGES = ("arabic", "bengali", "bulgarian", "cantonese", "chinese", "croatian", "czech", "danish", "dutch", "english", "estonian", "farsi",
                    "finnish", "french", "german", "greek", "hebrew", "hindi", "hungarian", "indonesian", "irish", "italian", "japanese", "korean",
                    "latvian", "lithuanian", "malay", "mandarin", "norwegian", "persian", "polish", "portuguese", "punjabi", "romanian", "russian",
                    "serbian", "slovak", "spanish", "swahili", "swedish", "tamil", "thai", "turkish", "ukrainian", "urdu", "vietnamese", "welsh")

# ---- scores ----------------------------------------------------------------
COMPLETENESS_WEIGHTS = (
    ("full_name", 10, "Add your full name."),
    ("email", 10, "Add an e-mail address."),
    ("phone", 5, "Add a phone number."),
    ("address", 5, "Add an address."),
    ("summary", 10, "Add a professional summary."),
    ("experience", 25, "Add work experience."),
    ("education", 15, "Add education."),
    ("skills", 15, "Add technical skills."),
    ("certifications", 5, "Add certifications."),
)
CATEGORY_WEIGHTS = {"skills": 35, "experience": 25, "education": 15, "role": 15, "location": 10}
DEGREE_WORDS = {
    1: r"associate (?:of|in|degree)|associate'?s degree|associate's|a\.?a\.?s?\.?",
    2: r"bachelor|bachelors|bachelor's|b\.?s\.?c?\.?|b\.?a\.?|b\.?eng\.?|b\.?tech\.?|b\.?b\.?a\.?|licence",
    3: r"master (?:of|in|degree)|masters|master's|m\.?s\.?c?\.?|m\.?a\.?|m\.?eng\.?|m\.?b\.?a\.?|m\.?tech\.?",
    4: r"doctor of|doctorate|doctoral|phd|ph\.d\.?|d\.?phil\.?|dr\.?",
}
RECOMMENDATIONS = (
    (40, "Poor Match"),
    (55, "Weak Match"),
    (70, "Moderate Match"),
    (80, "Good Match"),
    (90, "Strong Match"),
)
BEST_RECOMMENDATION = "Excellent Match"
CURRENCIES = {
    "usa": "USD", "united states": "USD", "canada": "CAD", "united kingdom": "GBP", "uk": "GBP",
    "india": "INR", "germany": "EUR", "france": "EUR", "spain": "EUR", "italy": "EUR",
    "netherlands": "EUR", "ireland": "EUR", "japan": "JPY", "australia": "AUD", "switzerland": "CHF",
}
DEFAULT_CURRENCY = "USD"
COMPARABLES_MIN_ROWS = 5
NEXT_ROLES = 5
IMPROVEMENT_AREAS = 3
SKILL_TREND_BAND = 0.10
SALARY_TREND_BAND = 0.05
TIMEFRAMES = {"30d": 30, "90d": 90, "1y": 365, "all": None}
MATCH_ALGORITHM = "rules-1"

# ---- words that tell the lines of a resume apart (patterns of Java, case aside) ---
HEADINGS = {
    "summary": (r"(?:professional |executive |career |personal )?(?:summary|profile|objective|statement)", "about(?: me)?"),
    "work": (r"(?:professional |work |relevant |career )?(?:experience|employment|history)", r"(?:employment|work|career) (?:history|experience)", "positions(?: held)?"),
    "school": (r"education(?:al)?(?: (?:background|history))?(?: (?:and|&) (?:training|qualifications))?", r"academic (?:background|history|qualifications)", "qualifications", "studies"),
    "skill": (r"(?:technical |core |key |soft |professional |it |computer )?(?:skills|competenc(?:ies|es)|expertise)(?: (?:and|&) \w+)?", "technologies", "tools",
              "(?:spoken )?languages", "skills summary", "areas of expertise"),
    "cert": (r"(?:professional )?(?:certifications?|certificates|licen[cs]es)(?: (?:and|&) (?:certifications?|certificates|licen[cs]es|training))?",),
    "other": ("references", "interests", "hobbies", "publications", "(?:personal )?projects", "awards(?: and honou?rs)?", "honou?rs(?: and awards)?", "volunteering",
              "volunteer (?:work|experience)", "memberships?", "activities", "additional information", "patents"),
}
#: Single words, in lower case, without points and apostrophes.
TITLE_WORDS = ("engineer", "developer", "programmer", "architect", "manager", "analyst", "scientist", "accountant", "auditor", "bookkeeper", "clerk", "assistant",
               "associate", "consultant", "adviser", "advisor", "director", "officer", "president", "vp", "head", "lead", "leader", "supervisor", "coordinator",
               "specialist", "administrator", "technician", "operator", "designer", "writer", "editor", "teacher", "lecturer", "professor", "researcher", "nurse",
               "physician", "pharmacist", "therapist", "chef", "cook", "driver", "mechanic", "electrician", "salesperson", "representative", "cashier", "recruiter",
               "planner", "buyer", "controller", "treasurer", "economist", "lawyer", "attorney", "paralegal", "intern", "trainee", "apprentice", "founder", "ceo", "cto",
               "cfo", "coo", "tester", "librarian")
FIRM_WORDS = ("inc", "ltd", "limited", "llc", "llp", "plc", "gmbh", "ag", "corp", "corporation", "company", "co", "group", "holdings", "partners", "solutions",
              "technologies", "labs", "systems", "consulting", "bank", "industries", "services", "agency", "studio", "studios", "analytics", "hospital", "council",
              "ministry", "store", "stores", "insurance", "software", "logistics", "foundation", "sons")
SCHOOL_WORDS = ("university", "college", "institute", "school", "academy", "polytechnic", "universität", "université", "universite", "università", "universidad",
                "hochschule", "école", "lycée", "akademie")
DEGREE_MARKS = ("bachelor", "bachelors", "master", "masters", "doctor", "doctorate", "phd", "mba", "bsc", "msc", "beng", "meng", "btech", "mtech", "associates", "diploma",
                "degree", "licence", "licenciatura", "abitur", "levels", "baccalaureate")
SHORT_DEGREES = ("ba", "ma", "bs", "ms", "bba", "aa", "aas", "associate")
CERTIFICATE_WORDS = ("certified", "certificate", "certification", "chartered", "licensed", "license", "cpa", "cfa", "pmp", "cissp", "ccna", "acca", "itil", "scrum",
                     "practitioner")
ISSUE_WORDS = ("issued", "issuer", "expires", "expire", "expiry", "credential", "valid", "awarded", "obtained", "earned", "renewed")
NOTE_WORDS = ("gpa", "honors", "honours", "laude", "distinction", "deans", "thesis", "graduated", "grade", "coursework", "modules", "dissertation")
