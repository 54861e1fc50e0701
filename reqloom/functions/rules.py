"""Rule engines over requirement texts. A rule's first pattern found decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqloom.functions.regexlib import any_of, first_label, java, let, matches
from reqloom.functions.text import strip

# Obligation patterns with their confidence.
MANDATORY = ((r"\bmandatory\b", 95), (r"\bnon-?negotiable\b", 95), (r"\bshall\b", 88), (r"\bmust\b", 88), (r"\brequired\b", 85), (r"\bwill\s+be\s+(evaluated|scored|assessed|rated)", 80), (r"\bessential\b", 75), (r"\bcritical\b", 70), (r"\bnecessary\b", 65))
OPTIONAL = (
    (r"\bthis\s+(is\s+)?optional\b", 95), (r"\boptional(ly)?:", 95), (r"\(optional\)", 95), (r"\bnot\s+required\b", 95), (r"\bnot\s+mandatory\b", 95), (r"\bis\s+not\s+required\b", 95),
    (r"\bnot\s+essential\b", 90), (r"\b(need|require)s?\s+not\b", 85), (r"\bnice\s+to\s+have\b", 90), (r"\bbonus\b", 85), (r"\bpreferred\s+but\s+not\s+required", 95),
    (r"\bvalue[\s-]?added\b", 80), (r"if\s+(applicable|available)\s*[.?]?\s*$", 85), (r"where\s+(applicable|possible)\s*[.?]?\s*$", 80), (r"\b(vendors?|respondents?|proposers?)\s+may\s", 75),
)
OPTIONAL_CONTENT = (
    r"\b(describe|explain|detail|list|what\s+are)\b.{0,30}\b(optional|recommended)", r"\boptional\s+(fields?|settings?|features?|parameters?|configurations?)\b",
    r"\brecommended\s+(settings?|configurations?|approach|process|system|server|hardware|software)\b", r"\b(screenshots?|images?|diagrams?|examples?).{0,15}if\s+possible",
    r"if\s+possible.{0,15}(screenshots?|images?|diagrams?|examples?)", r"\bwhat\s+(is|are)\s+(the\s+)?recommended\b", r"\brecommended\s+(when|for|to|if)\b", r"\b(include|provide|add|attach).{0,20}if\s+(applicable|available|possible)\b",
)
SECTION_OPTIONAL = ((r"\boptional\s+(requirement|section|item)", 95), (r"\bpreferred\s+(qualification|requirement)", 90), (r"\bnice\s+to\s+have", 90), (r"\bdesired\s+(qualification|requirement)", 85), (r"\bvalue[\s-]added", 80))
SECTION_MANDATORY = ((r"\bmandatory\s+(requirement|section|item)", 95), (r"\brequired\s+(requirement|section|item)", 90), (r"\bmust\s+have", 85), (r"\bminimum\s+requirement", 85))
DEFAULT_OBLIGATION = 75


def obligation(text: Column, section: Column | None = None) -> Column:
    """Signed confidence: positive for mandatory, negative for optional."""
    t = strip(text)
    about_content = any_of(text, OPTIONAL_CONTENT)
    by_text = first_label(t, MANDATORY, DEFAULT_OBLIGATION)
    optional = first_label(t, tuple((p, -c) for p, c in OPTIONAL), 0)
    out = let(optional, lambda found: F.when((found != 0) & ~about_content, found).otherwise(by_text))
    if section is None:
        return out
    s = F.coalesce(section, F.lit(""))
    by_section = first_label(s, (*((p, -c) for p, c in SECTION_OPTIONAL), *SECTION_MANDATORY), 0)
    return let(by_section, lambda found: F.when(found != 0, found).otherwise(out))


# Words and patterns of the domains.
STRONG_LEGAL = ("gdpr", "hipaa", "pci", "dpa", "nda", "indemnity", "indemnification", "liability", "subprocessor", "data controller", "data processor")
LEGAL_WORDS = (
    "regulation", "compliance", "GDPR", "privacy", "terms", "liability", "security", "certification", "audit", "ISO", "SOC", "HIPAA", "PCI", "breach", "incident", "retention", "deletion",
    "processor", "controller", "DPA", "indemnity", "warranty", "confidential", "NDA", "contract", "agreement", "legal", "policy", "indemnification", "governing law", "jurisdiction",
    "subprocessor", "data protection", "data processing", "personal data",
)
PROCESS_WORDS = (
    "how", "process", "approach", "steps", "methodology", "procedure", "workflow", "timeline", "phase", "stage", "onboarding", "implementation", "migration", "transition", "training", "support",
    "escalation", "deployment", "rollout", "project", "plan", "schedule", "documentation", "testing", "acceptance", "deliverable", "governance", "handover", "handoff", "setup", "configuration",
    "lifecycle", "sprint", "iteration", "agile", "waterfall", "scrum", "kickoff", "kick-off", "milestone", "checkpoint", "go-live", "cutover", "change management", "risk management",
    "quality assurance", "sequence", "order", "flow",
)
STRONG_PROCESS = (
    r"\b(describe|explain|outline|detail|provide)\s+(your|the|a)?\s*(process|approach|methodology|steps|timeline|procedure|workflow)", r"\b(how)\s+(do|does|will|would|can|should)\s+(you|your|the|we)",
    r"\bhow\s+(you|your|the|we)\s+(will|would|can|handle|manage|approach)", r"\b(what)\s+(is|are)\s+(your|the)\s*(process|approach|methodology|procedure|steps)",
)
HOW = ("how you", "how your", "how the", "how will", "how would", "how do", "how does", "how can")


def word_pattern(word: str) -> str:
    """Several words are found anywhere, one word only as a whole."""
    return word.lower() if " " in word else rf"\b{word.lower()}\b"


def words_found(text: Column, tokens: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text in lower case holds. tokens: its distinct runs of word characters, which single words are looked up in."""
    low = [w.lower() for w in words]
    plain = [w for w in low if w.isidentifier()]
    found = F.size(F.array_intersect(tokens, F.array(*map(F.lit, plain))))
    for w in low:
        if w not in plain:
            found = found + (F.contains(text, F.lit(w)) if " " in w else F.contains(text, F.lit(w)) & matches(text, word_pattern(w), False)).cast("int")
    return found


def domain(text: Column) -> Column:
    def named(x: Column) -> Column:
        t, tokens = x["t"], x["tokens"]
        legal = (words_found(t, tokens, STRONG_LEGAL) > 0) | (words_found(t, tokens, LEGAL_WORDS) >= 2)
        process = (words_found(t, tokens, PROCESS_WORDS) > 0) | (F.contains(t, F.lit("how")) & any_of(t, ("^how ", " how ", *HOW), False)) | any_of(t, STRONG_PROCESS)
        return F.when(legal, "LEGAL").when(process, "PROCESS").otherwise("FEATURE")

    low = F.lower(text)
    return let(F.struct(low.alias("t"), F.array_distinct(F.split(low, "[^a-z0-9_]+")).alias("tokens")), named)


# Signals of written answers, of attestations, and of regulations.
WRITTEN = (
    r"\b(describe|explain|detail|demonstrate|outline|discuss|elaborate)\b", r"\b(provide approach|specify how|show how|detail how)\b", r"\b(or equivalent|if applicable|as appropriate|may propose)\b",
    r"\b(alternative|exception|deviation|variance)\b", r"\b(methodology|approach|strategy|plan for)\b", r"\b(how will|how do|how does|how would|how is|how are|what is your)\b",
    r"\?[^?]*\bhow\s+(is|are|do|does|will|would|can)\b[^?]*\?",
)
ATTEST = (
    r"\b(must hold|must maintain|must be certified|must be licensed|must be registered)\b", r"\b(must have|shall possess|is required to be|shall maintain|shall hold)\b",
    r"\b(must submit by|shall deliver|responses due|due by|deadline)\b", r"\b(must comply with|shall comply with|in accordance with|pursuant to)\b",
    r"\b(must use format|shall include \d+ copies|shall provide \d+)\b", r"\b(must be|shall be|is required to be)\s+(bonded|insured|incorporated)\b",
    r"\b(contractor shall|offeror shall|vendor shall|respondent shall)\s+(maintain|hold|provide|submit)\b", r"\b(certify|attest|warrant|represent)\s+(that|compliance)\b",
    r"\b(accept|agree to|acknowledge)\s+(all|the)?\s*(terms|conditions|requirements)\b", r"\bis\s+(the|your|it)\s+.{0,80}\s+compliant\b", r"\bare\s+(you|your)\s+.{0,40}\s+(certified|compliant|registered|licensed)\b",
    r"\b(does|do)\s+(the|your|it)\s+.{0,60}\s+(comply|meet|conform)\s+(with|to)\b", r"\bfully\s+\w*\s*(compliant|compatible|certified)\b", r"\b(compliant|compatible)\s+with\s+.{0,30}\s+(standard|specification|requirement)",
    r"^does\s+(the|your)\s+\w+\s+(provide|support|have|offer|allow|enable|include)\b", r"^does\s+(the|your)\s+(solution|system|product|platform|software|tool|wcms|cms)\b",
    r"^do\s+you\s+(have|offer|provide|support|work)\b", r"^is\s+(the|your)\s+\w+\s+(able|capable)\b", r"^are\s+there\b", r"^is\s+there\b", r"^are\s+your\s+\w+",
)
CAN_QUESTION, CAN_EXPLAIN = r"^can\s+.+\?$", r"^can\s+.{0,30}(describe|explain|how\s+(do|would|will)|what\s+is\s+your)"
REGULATION = (r"\b(FAR|DFAR|CFR|USC|U\.S\.C\.|Section \d+)\b", r"\b([A-Z]{2,4}\s+\d+[\.\-]\d+)", r"\b(Public Law|P\.L\.|Executive Order|E\.O\.)\s*\d+")
REGULATION_EXACT = (r"\b(ADA|HIPAA|FERPA|SOX|PCI|GDPR)\b",)
ATTEST_CONFIDENCE = (("written", 0.9), ("both", 0.95), ("attest", 0.8), ("regulation", 0.7), ("none", 0.6))


def attestation(text: Column) -> Column:
    """written, both, attest, regulation or none: which signals decide. both, attest and regulation allow an attestation."""
    attest = any_of(text, ATTEST) | (matches(text, CAN_QUESTION) & ~matches(text, CAN_EXPLAIN))
    regulation = any_of(text, REGULATION) | any_of(text, REGULATION_EXACT, False)
    return F.when(any_of(text, WRITTEN), "written").when(attest & regulation, "both").when(attest, "attest").when(regulation, "regulation").otherwise("none")


# Statements of compliance by topic.
STATEMENTS = (
    (r"\b(insurance|liability|coverage|bonded)\b", "maintains the required insurance coverage as specified and will provide certificate of insurance upon request."),
    (r"\b(license|licensed|certification|certified|registered)\b", "holds all required licenses and certifications as specified."),
    (r"\b(terms|conditions)\b", "accepts all terms and conditions as stated without exception."),
    (r"\b(conflict of interest|conflict)\b", "certifies that no conflict of interest exists with respect to this solicitation."),
    (r"\b(background check|security clearance|clearance)\b", "confirms that all personnel will meet the specified security requirements."),
    (r"\b(comply|compliance|accordance)\b", "confirms compliance with this requirement."),
    (r"\b(submit|deliver|due|deadline)\b", "confirms this response is submitted in accordance with the stated requirements."),
    (r"\b(acknowledge|accept|agree)\b", "acknowledges and agrees to this requirement."),
)
GENERIC_STATEMENT = "confirms compliance with this requirement."


def statement(text: Column, company: Column, status: Column) -> Column:
    name = F.coalesce(F.nullif(company, F.lit("")), F.lit("[Company Name]"))
    yes = F.concat_ws(" ", name, first_label(text, STATEMENTS, GENERIC_STATEMENT))
    return (
        F.when(status == "COMPLIANT", yes)
        .when(status == "NON_COMPLIANT", F.concat(name, F.lit(" notes non-compliance with this requirement.")))
        .when(status == "NOT_APPLICABLE", F.concat(F.lit("Not applicable to "), name, F.lit("'s proposal.")))
        .otherwise("")
    )


def response_status(compliance: Column) -> Column:
    return F.when(compliance.isin("COMPLIANT", "NON_COMPLIANT", "NOT_APPLICABLE"), "ANSWERED").otherwise("UNANSWERED")


# Signs that a figure is asked for.
FINANCIAL = (r"[£$€¥]", r"\b\d+(\.\d+)?\s*%", r"\bpric(e|es|ing)\b", r"\bcost(s|ing)?\b", r"\bfee(s)?\b", r"\bbudget\b", r"\bquot(e|ation)\b", r"\btariff\b", r"\b(hourly|daily|annual)\s+rate\b")
ABOUT_PROCESS = (
    r"\bapproach\s+to\s+(pricing|cost|fee)", r"\bdescribe\s+(your\s+)?approach\b", r"\bexplain\s+(your\s+)?approach\b", r"\bexplain\s+how\s+you\b", r"\bmethodology\s+(for|of)\b", r"\bstrategy\s+for\b",
    r"\bhow\s+do\s+you\s+(handle|manage|approach)\b", r"\bdescribe\s+your\s+.{0,30}(process|method|approach|strategy)",
)
ASKS_NUMBERS = (
    r"\bprovide\s+(your\s+)?(pricing|costs?|fees?|rates?)\b", r"\bwhat\s+(is|are)\s+(your|the)\s+(price|cost|fee|rate)\b", r"\blist\s+(your\s+)?(pricing|rates?|fees?|costs?)\b", r"\btotal\s+(cost|price|amount|fee)\b",
    r"\bquote\s+(for|your)\b", r"\bprovide\s+a\s+(breakdown|schedule)\s+of\b", r"\bstate\s+(your|the)\s+(price|cost|fee|rate)\b",
)
CURRENCY = r"[£$€¥]\s*\d"


def corrected_type(text: Column, kind: Column) -> Column:
    """A descriptive requirement that asks for figures is a quantitative one."""
    figures = any_of(text, FINANCIAL) & ~any_of(text, ABOUT_PROCESS) & (any_of(text, ASKS_NUMBERS) | matches(text, CURRENCY))
    return F.when((kind == "DESCRIPTIVE") & figures, "QUANTITATIVE").otherwise(kind)


TYPES = ("CONTEXTUAL", "PROCEDURAL", "DECLARATIVE", "DESCRIPTIVE", "EVIDENCE_BASED", "QUANTITATIVE", "REFERENCE_BASED", "STAFFING")
OLD_TYPES = ("CONTEXTUAL", "PROCEDURAL", "DECLARATIVE", "DESCRIPTIVE", "EVIDENCE_BASED")


def valid_type(kind: Column) -> Column:
    return F.when(kind.isin(*TYPES), kind).otherwise("DESCRIPTIVE")


def old_type(kind: Column) -> Column:
    return F.when(F.upper(kind).isin(*OLD_TYPES), F.upper(kind)).otherwise("DECLARATIVE")


def valid_domain(kind: Column) -> Column:
    return F.when(kind.isin("FEATURE", "PROCESS", "LEGAL"), kind)


BOXES = "[═─│╔╗╚╝╠╣╦╩╬╒╓╘╙╛╜╞╟╡╢╤╥╧╨╪╫]"
SECTION_NUMBER = r"\b\d+\.\d+(?:\.\d+)?\b"
SPECIAL = r"""[^\w\s.,;:?!'"\-()]"""
REASONS = ("table markers", "pipe characters", "box-drawing characters", "very short", "several section numbers", "many special characters", "repeated characters")


def review_reasons(text: Column) -> Column:
    """array<string>: what in a text asks for a second look."""
    tests = (
        matches(text, r"\[Col\s*\d*\]?|\[ROW\s*\d*\]?|\[TABLE|\[HEADER\]"),
        matches(text, r"\s\|\s") | matches(text, r"^\s*\||\|\s*\z"),
        text.rlike(BOXES),
        F.length(strip(text)) < 25,
        F.regexp_count(text, F.lit(java(SECTION_NUMBER))) > 2,
        (F.length(text) > 50) & (F.regexp_count(text, F.lit(java(SPECIAL))) * 10 > F.length(text)),
        text.rlike(r"([^_\-\r\n])\1{5,}") | text.rlike(r"([\r\n])\1{5,}"),
    )
    return F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)]))


# Answer templates: name, patterns, keywords, least share of keywords.
TEMPLATES = (
    ("data-protection-policy", ("data protection policy", "privacy policy", "GDPR policy"), ("data", "protection", "policy", "privacy", "GDPR"), 0.6),
    ("gdpr-compliance", ("GDPR compliance", "compliant with GDPR", "comply with GDPR"), ("GDPR", "compliance", "data", "protection", "regulation"), 0.6),
    ("data-processor-controller", ("data processor", "data controller", "processor or controller"), ("data", "processor", "controller", "role", "GDPR"), 0.6),
    ("iso-27001", ("ISO 27001", "ISO27001", "information security management"), ("ISO", "27001", "security", "certification", "management"), 0.6),
    ("soc2-compliance", ("SOC 2", "SOC2", "SOC II"), ("SOC", "2", "II", "compliance", "audit", "report"), 0.6),
    ("security-certifications", ("security certifications", "what certifications", "list.*certifications"), ("security", "certifications", "standards", "compliance"), 0.5),
    ("data-retention", ("data retention", "retention policy", "how long.*data.*stored"), ("data", "retention", "policy", "storage", "period", "delete"), 0.5),
    ("data-backup", ("backup.*policy", "disaster recovery", "business continuity"), ("backup", "recovery", "disaster", "continuity", "redundancy"), 0.5),
    ("data-location", ("where.*data.*stored", "data.*location", "data.*residency", "hosting location"), ("data", "location", "stored", "hosting", "residency", "region"), 0.5),
    ("pricing-model", ("pricing model", "pricing structure", "how.*pricing.*work"), ("pricing", "model", "cost", "structure", "fees"), 0.5),
    ("support-hours", ("support hours", "support availability", "when.*support.*available"), ("support", "hours", "availability", "help", "desk"), 0.5),
    ("sla-uptime", ("SLA", "uptime guarantee", "service level", "availability.*guarantee"), ("SLA", "uptime", "availability", "service", "level", "guarantee"), 0.5),
    ("implementation-timeline", ("implementation timeline", "how long.*implementation", "onboarding.*time"), ("implementation", "timeline", "onboarding", "time", "duration"), 0.5),
    ("training-provided", ("training.*provided", "user training", "training program"), ("training", "provided", "users", "program", "learning"), 0.5),
    ("api-available", ("API.*available", "provide.*API", "API.*integration"), ("API", "integration", "available", "REST", "connect"), 0.5),
)


def template(text: Column) -> Column:
    """Name of the first template with a pattern found; else of the one with the greatest share of keywords that reaches its least; or null."""
    by_pattern = F.coalesce(*[F.when(any_of(text, patterns), F.lit(name)) for name, patterns, _, _ in TEMPLATES])
    words = F.lower(text)
    scores = []
    for i, (name, _, keywords, least) in enumerate(TEMPLATES):
        hits = sum((F.contains(words, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
        share = hits / len(keywords)
        scores.append(F.when(share >= least, F.struct(share.alias("share"), F.lit(-i).alias("first"), F.lit(name).alias("name"))))
    return F.coalesce(by_pattern, F.greatest(*scores)["name"])


# Placeholders in drafts; the first two in this case only.
PLACEHOLDERS = (
    ("DRAFT", r"\[DRAFT\]", False), ("COMPANY_NAME", r"\[COMPANY NAME\]", False), ("PROVIDE", r"\[PROVIDE[^\]]*\]", True), ("CONFIRM", r"\[CONFIRM[^\]]*\]", True), ("DESCRIBE", r"\[DESCRIBE[^\]]*\]", True),
    ("EXPLAIN", r"\[EXPLAIN[^\]]*\]", True), ("OUTLINE", r"\[OUTLINE[^\]]*\]", True), ("DATE", r"\[DATE\]", True), ("NUMBER", r"\[NUMBER\]", True), ("SPECIFIC_DETAILS", r"\[SPECIFIC DETAILS\]", True),
)


def placeholders(draft: Column) -> Column:
    """array<struct<kind, match, critical>>; all kinds but DRAFT block an export."""

    def each(kind: str, pattern: str, any_case: bool) -> Column:
        found = F.regexp_extract_all(F.coalesce(draft, F.lit("")), F.lit(("(?i)" if any_case else "") + pattern), F.lit(0))
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("match"), F.lit(kind != "DRAFT").alias("critical")))

    return F.flatten(F.array(*[each(*p) for p in PLACEHOLDERS]))


# Ways to state a deadline.
DEADLINE_SIMPLE = r"(?:deadline|submission date|due date|closing date)[:\s]+([A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4})"
DEADLINES = (
    (r"(?:deadline|due date|submission date|respond by|responses? due)[:\s]+([A-Za-z]+\s+\d{1,2},?\s+\d{4})", "MMMM d yyyy"),
    (r"(?:deadline|due date|submission date|respond by|responses? due)[:\s]+(\d{1,2}\/\d{1,2}\/\d{4})", "M/d/yyyy"),
    (r"(?:deadline|due date|submission date|respond by|responses? due)[:\s]+(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
    (r"(?:must be received by|submit by|no later than)[:\s]+([A-Za-z]+\s+\d{1,2},?\s+\d{4})", "MMMM d yyyy"),
)


def deadline_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(?i)" + java(DEADLINE_SIMPLE), 1), F.lit(""))


def deadline(text: Column) -> Column:
    """Date (yyyy-MM-dd) of the first form found that is a date."""
    found = [F.date_format(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.nullif(F.regexp_extract(text, "(?i)" + java(p), 1), F.lit("")), ",", " "), r"\s+", " "), F.lit(form)), "yyyy-MM-dd") for p, form in DEADLINES]
    return F.coalesce(*found)
