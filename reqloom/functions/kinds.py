"""What kind of answer a requirement asks for: structure of the question, topics, keyword density, and the rules that weigh them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqloom.functions.regexlib import any_of, java, matches
from reqloom.functions.text import strip

# Structures of questions, in order; the first found counts: pattern, structure, confidence, indicator.
STRUCTURES = (
    (r"^(does|do)\s+(the|your|it|this|a|an|you)", "yes_no", 95, "does/do start"),
    (r"^can\s+(the|your|you|it|this|users?|a|an|we)", "yes_no", 95, "can start"),
    (r"^can\s+\w+(\s+\w+){0,3}\s+be\s+", "yes_no", 88, "can X be"),
    (r"^(?![\s\S]*\b(what|how|why|where|when|which)\b)can\s+[^?]+\?\z", "yes_no", 85, "can...?"),
    (r"^is\s+(the|your|it|this|there|a|an)\s", "yes_no", 95, "is start"),
    (r"^are\s+(the|your|there|these|those|you|we)", "yes_no", 95, "are start"),
    (r"^will\s+(the|your|it|this|you|there)", "yes_no", 90, "will start"),
    (r"^would\s+(the|your|it|this|you)", "yes_no", 85, "would start"),
    (r"^has\s+(the|your|it|this)", "yes_no", 90, "has start"),
    (r"^have\s+(you|your|the)", "yes_no", 90, "have start"),
    (r"\b(confirm|indicate|specify)\s+(whether|if)\s+(the|your|you)", "yes_no", 90, "confirm whether/if"),
    (r"\bplease\s+(confirm|indicate|specify)\s+(that|if|whether)", "yes_no", 88, "please confirm"),
    (r"^(please\s+)?(confirm|acknowledge|agree|accept|certify|attest)\b", "confirmation", 95, "confirmation verb start"),
    (r"\bconfirm\s+(that|your|you|receipt|acceptance|compliance|understanding)", "confirmation", 90, "confirm that"),
    (r"\backnowledge\s+(that|your|you|receipt|understanding)", "confirmation", 90, "acknowledge that"),
    (r"^describe\b", "open_ended", 95, "describe start"),
    (r"^explain\b", "open_ended", 95, "explain start"),
    (r"^(how|what|why)\s+(does|do|is|are|will|would|can|could|should|has|have)", "open_ended", 92, "how/what/why question"),
    (r"^please\s+(describe|explain|detail|elaborate|discuss)", "open_ended", 93, "please describe/explain"),
    (r"^(outline|detail|discuss|elaborate)\b", "open_ended", 90, "outline/detail start"),
    (r"^(list|identify|name|enumerate)\b", "list_request", 92, "list/identify start"),
    (r"^provide\s+(a\s+)?(list|listing|breakdown|inventory)\b", "list_request", 90, "provide list"),
    (r"^(the\s+)?(vendor|contractor|respondent|proposer|bidder)\s+(shall|must|will)\s", "statement", 85, "vendor shall statement"),
    (r"^(this\s+section|the\s+following|note\s+that|note:|for\s+the\s+purposes?\s+of)", "statement", 90, "section intro"),
    (r"^(all\s+)?(proposals?|responses?|submissions?)\s+(shall|must|should)\s+(be|include|contain)", "statement", 85, "proposal shall statement"),
    (r"^(what|how|why|when|where|which)\b[\s\S]*\?\z", "open_ended", 70, "wh-question start"),
    (r"\b(does|do|can|is|are|will|would|has|have)\b[\s\S]*\?\z", "yes_no", 65, "question mark + aux verb"),
    (r"\b(what|how|why)\b[\s\S]*\?\z", "open_ended", 55, "embedded wh-word"),
    (r"\?\z", "unknown", 50, "question mark only"),
    (r"^(provide|submit|include|attach|upload)\b", "unknown", 45, "action verb start"),
)
EMBEDDED = r"\.\s*(?:please\s+)?(list|provide|describe|explain|identify|specify)\b"
ANSWERS = {"yes_no": "DECLARATIVE", "open_ended": "DESCRIPTIVE", "list_request": "DESCRIPTIVE", "confirmation": "PROCEDURAL", "statement": "CONTEXTUAL", "unknown": "DESCRIPTIVE"}

# Topics in order: type, patterns, patterns that rule it out, words of a section title that speak for it.
HOW_AFTER = r"\?[^?]*\bhow\s+(is|are|do|does|will|would|can)\b"
TOPICS = (
    ("STAFFING", (
        r"\b(provide|submit|include|list|identify|describe|explain).{0,30}(staff|personnel|team\s+member|FTE|employee)", r"\b(provide|submit|include|attach|describe).{0,30}(resume|CV|curriculum\s+vitae)",
        r"\b(provide|identify|list|describe).{0,30}(key\s+staff|key\s+personnel|project\s+team)", r"\b(provide|include|attach|describe).{0,30}organizational?\s+chart",
        r"\b(name|identify).{0,20}(project\s+manager|team\s+lead|account\s+manager)", r"\bwho\s+will\s+(be\s+)?(assigned|responsible|leading|managing)", r"\bproposed\s+(staff|team|personnel)\b",
        r"\bstaffing\s+(plan|proposal|approach|setup|structure)\b", r"\b(describe|explain)\s+(your\s+)?(staffing|team\s+structure|personnel)", r"\bhow.{0,20}(your|the)\s+(team|staff).{0,20}(organized|structured|assigned)",
        r"\b(team|staff)\s+(qualification|experience|background|expertise)", r"\b(developer|engineer|architect|analyst|manager)\s+(experience|qualification)",
    ), (r"\bour\s+staff\s+will\s+(review|contact|respond)", r"\bissuer('s)?\s+staff\b"), ("staffing", "personnel", "team", "resources", "key staff", "qualifications")),
    ("REFERENCE_BASED", (
        r"\b(provide|submit|include|list).{0,30}(client|customer)\s+reference", r"\b(provide|submit|include|list).{0,30}reference.{0,15}(contact|name|phone|email)", r"\bcontact\s+information.{0,20}(reference|client)",
        r"\b(provide|submit|include|attach|describe).{0,30}case\s+stud(y|ies)", r"\b(describe|provide|explain).{0,30}(similar|comparable|relevant)\s+(project|work|engagement|experience)",
        r"\b(describe|explain|provide).{0,30}(past|previous|prior)\s+(project|work|experience|engagement)", r"\bpast\s+performance", r"\btrack\s+record", r"\bCPARS\b",
        r"\b(your|the)\s+(past|previous|prior)\s+(experience|expertise)\s+(with|in|on)", r"\bhow\s+(long|many).{0,20}(experience|years|projects)", r"\bexamples?\s+of\s+(similar|past|previous|your)\s+(project|work|experience)",
    ), (r"^(does|do|can|is|are|will)\s+(the|your)\s+\w+\s+(provide|support|offer|have|allow|enable)",), ("reference", "experience", "past performance", "qualifications", "case study")),
    ("DECLARATIVE", (
        r"^does\s+(the|your)\s+\w+.{0,30}(provide|support|offer|have|allow|enable|include)\b", r"^can\s+(the|your)\s+\w+.{0,30}(provide|support|do|perform|handle|generate|track|manage)\b", r"^is\s+(the|your)\s+\w+.{0,30}(capable|able)\s+to\b",
        r"\b(system|solution|platform|product|software)\s+(provides?|supports?|offers?|has|enables?|allows?|includes?)\b", r"\b(does|can)\s+(it|the\s+system|the\s+solution|your\s+product)\s+(support|provide|allow|enable|offer|include)",
        r"^(does|do)\s+(your|the).{0,40}(support|provide|allow|enable|offer|include|have|track|manage)\b",
    ), (r"\b(past|previous|prior|similar)\s+(project|work|experience)\b", r"\b(client|customer)\s+reference", r"\bcase\s+stud(y|ies)", HOW_AFTER), ("capability", "feature", "functional", "technical", "requirements", "support")),
    ("EVIDENCE_BASED", (
        r"\b(attach|upload|include|submit|provide|describe).{0,30}(certificate|certification|license|permit)\b", r"\bcertificate\s+of\s+(insurance|compliance|incorporation|good\s+standing)", r"\bproof\s+of\s+(insurance|compliance|registration|bonding|licensure)",
        r"\b(HIPAA|PCI|GDPR|FedRAMP|FISMA|NIST|CIS)\b", r"\b(ISO|SOC|SOC2)\s*[-\s]?\d+\b", r"\b(attach|provide|submit|describe).{0,30}(financial\s+statement|audit(ed)?\s+report|W-?9)\b", r"\b(attach|provide|submit).{0,30}(balance\s+sheet|income\s+statement|tax\s+return)",
        r"\binsurance\s+(certificate|policy|coverage)\b", r"\b(describe|explain).{0,30}(your\s+)?(security|compliance|certification)\s+(posture|status|measures|controls)",
        r"\b(describe|explain).{0,30}(how\s+)?(you|your).{0,20}(comply|compliant|certified|meet).{0,30}(standard|regulation|requirement)", r"\b(what|which)\s+(security\s+)?(certification|compliance|audit|attestation)",
        r"\b(describe|provide|explain).{0,30}(disaster\s+recovery|business\s+continuity|DR|BCP)\s+(plan|capability|procedure)", r"\battest(ation)?\b", r"\b(are|is)\s+(you|your).{0,20}(certified|compliant|audited)",
    ), (r"\bdocumentation\s+of\s+(your\s+)?(development|implementation)\s+(approach|methodology)",), ("attachment", "evidence", "documentation", "certificate", "compliance", "security", "audit")),
    ("QUANTITATIVE", (
        r"\bwhat\s+(is|are)\s+(the|your)\s+(price|cost|fee|rate|total)", r"\bprovide\s+(your\s+)?(pricing|costs?|fees?|rates?|quote|bid)\b", r"\bsubmit\s+(your\s+)?(pricing|costs?|fees?|quote|bid)\b", r"[£$€¥]\s*[\d,]+", r"\b\d+(\.\d+)?\s*%",
        r"\bhow\s+much\s+(does|will|would|is)", r"\btotal\s+(cost|price|amount|fee)\b", r"\bunit\s+price", r"\b(hourly|daily|weekly|monthly|annual)\s+(rate|fee|cost)", r"\bprice\s+(per|for|of)\b", r"\bcost\s+breakdown\b", r"\bitemized\s+(cost|price|fee)",
        r"\b(describe|provide|explain|what).{0,30}(your\s+)?(SLA|service\s+level|uptime|availability)\b", r"\b(what|describe|provide).{0,30}(your\s+)?(response\s+time|resolution\s+time|turnaround)",
        r"\b(what|describe).{0,30}(your\s+)?(capacity|scalability|throughput|performance)\s+(limit|metric|number)", r"\bpricing\s+(schedule|table|sheet|breakdown|detail)", r"\bfee\s+(schedule|structure|breakdown)", r"\b(volume|bulk|quantity)\s+(discount|pricing)",
        r"\bdiscount\s+(for|on|rate|structure)", r"\b(per-seat|per-user|per-license|seat-based|user-based)\s*(pricing|cost|fee)", r"\blicens(e|ing)\s+(cost|fee|price|model)",
    ), (r"^(does|do|can|is|are|will)\s+(the|your|it|this)", r"\bintegrat(e|es|ion)\s+(with|into)\b", r"^how\s+(is|are|does|do)\s+"), ("pricing", "cost", "fee", "financial", "budget", "price", "sla", "metrics")),
    ("PROCEDURAL", (
        r"\bsign(ed|ature)?\s*(and\s+)?(return|submit|date|below)", r"\bexecute\s+(the\s+)?(agreement|contract|form|document)", r"\binitial\s+(here|each|all|below)", r"\breturn\s+(this|the)\s+(form|document|page).{0,20}(signed|completed)",
        r"\bcomplete\s+and\s+(sign|return|submit)", r"\bsigned\s+(copy|form|document|agreement)", r"\b(describe|explain|provide|what).{0,30}(your\s+)?(implementation|deployment|rollout)\s+(process|plan|approach|steps)",
        r"\b(describe|explain|outline).{0,30}(your\s+)?(onboarding|migration|transition)\s+(process|plan|procedure)", r"\b(what|describe).{0,30}(your\s+)?(installation|setup|configuration)\s+(process|procedure|steps)",
        r"\b(describe|explain|outline).{0,30}(your\s+)?(workflow|process|procedure)\s+(for|to)\b", r"\bhow\s+(do|does|will|would)\s+(you|your|the).{0,30}(implement|deploy|install|migrate|onboard)", r"\bwhat\s+(are|is)\s+(the\s+)?(steps?|phases?|stages?)\s+(for|to|in|of)\b",
        r"\b(list|describe|outline)\s+(the\s+)?(steps?|phases?|stages?)\s+(for|to|in|of|required)", r"\b(describe|explain).{0,30}(your\s+)?(maintenance|support|upgrade|update)\s+(process|procedure|workflow)",
        r"\b(describe|explain).{0,30}(your\s+)?(change\s+management|release\s+management|version\s+control)\b",
    ), (), ("signature", "execution", "acknowledgment", "certification", "implementation", "process", "workflow", "onboarding")),
    ("CONTEXTUAL", (
        r"^(this\s+section|the\s+following|below\s+are|the\s+purpose\s+of)", r"^(note|please\s+note|important):", r"^for\s+the\s+purposes?\s+of\s+(this|the)", r"\b(deadline|due\s+date|closing\s+date)\s*(is|:)", r"\bsubmission\s+(deadline|date|instructions?)\b",
        r"\bproposals?\s+(must|shall)\s+be\s+(received|submitted|delivered)\s+(by|before|no\s+later)", r"\bevaluation\s+(criteria|factors?)\s*(are|include|:)", r"\bwill\s+be\s+(evaluated|scored|assessed)\s+(based\s+on|according\s+to)",
        r"\bfailure\s+to.{0,40}(may|will|shall)\s+(result|cause|lead|disqualify)", r"\bnon-?compliance.{0,20}(may|will|shall)\s+(result|cause)", r'^"[^"]+"\s+(means|refers\s+to|is\s+defined\s+as)', r"\bfor\s+purposes\s+of\s+this\s+(RFP|solicitation|document)",
        r"\b(vendor|contractor|respondent)s?\s+(shall|must|should)\s+(ensure|provide|submit|comply)", r"\ball\s+(proposals?|responses?)\s+(shall|must|should)\s",
    ), (r"^(does|do|can|is|are|will|has|have|what|how|describe|explain|provide|list)\s", r"\?\z", r"^(describe|explain|outline|detail|discuss|provide|list|identify)\b"), ("introduction", "overview", "background", "instructions", "evaluation", "deadline")),
    ("DESCRIPTIVE", (
        r"\bdescribe\s+(your|the|how|in\s+detail)", r"\bexplain\s+(your|the|how|in\s+detail)", r"\bprovide\s+(a\s+)?(detailed\s+)?(description|explanation|overview)", r"\boutline\s+(your|the|how)", r"\bdetail\s+(your|the|how)", r"\belaborate\s+on",
        r"\bhow\s+(do|does|would|will|can)\s+(your|the|you)", r"\bhow\s+(is|are)\s+(this|that|it)\s+(achieved|accomplished|done|handled|implemented|managed)", r"\bwhat\s+(is|are)\s+(your|the)\s+(approach|methodology|strategy|process)", HOW_AFTER,
    ), (
        r"\bprovide\s+(a\s+)?(list|resume|certificate|reference)", r"\b(staff|personnel|team\s+member|FTE|employee|staffing|resume|cv)\b", r"\b(reference|case\s+stud|similar\s+project|past\s+performance|past\s+project|previous\s+work)\b",
        r"\b(certificate|certification|compliance|hipaa|pci|gdpr|fedramp|soc\s*2?|iso\s*27|audit)\b", r"\b(pricing|sla|service\s+level|uptime|response\s+time|fee\s+schedule)\b",
        r"\b(implementation\s+process|onboarding\s+process|migration\s+process|deployment\s+process|workflow\s+for)\b",
    ), ("approach", "methodology", "narrative", "response", "solution")),
)
# Words of a section title that speak for a type in its confidence.
TITLE_WORDS = {
    "STAFFING": ("staff", "personnel", "team", "resource"), "QUANTITATIVE": ("price", "pricing", "cost", "fee", "financial", "budget"), "REFERENCE_BASED": ("reference", "experience", "qualification", "past performance"),
    "EVIDENCE_BASED": ("attachment", "evidence", "document", "certificate"), "PROCEDURAL": ("signature", "certify", "acknowledgment"), "CONTEXTUAL": ("introduction", "overview", "instruction", "background"),
    "DECLARATIVE": ("capability", "feature", "support", "compliance", "functional"), "DESCRIPTIVE": ("approach", "methodology", "narrative", "solution", "technical"),
}
ACTION_START = r"^(describe|explain|provide|list|identify|outline|detail|discuss|how|what|why|can|does|do|is|are|will|has|have)\b"
BASE, BOOST = 75, 10


def structure(text: Column) -> Column:
    """struct(kind, confidence, indicator)."""
    t = strip(text)
    said = lambda kind, confidence, indicator: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(indicator).alias("indicator"))
    out = None
    for pattern, *rest in STRUCTURES:
        hit = matches(t, pattern)
        out = F.when(hit, said(*rest)) if out is None else out.when(hit, said(*rest))
    verb = F.lower(F.regexp_extract(t, "(?i)" + java(EMBEDDED), 1))
    out = out.when(verb.isin("list", "identify", "specify"), said("list_request", 75, "embedded list request")).when(verb != "", said("open_ended", 72, "embedded describe request"))
    return out.otherwise(said("unknown", 30, "no pattern matched"))


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def best_topic(text: Column, section: Column) -> Column:
    """struct(kind, base) of the topic with the greatest base confidence that nothing rules out, the first of equals; or null."""
    t, title = strip(text), F.lower(F.coalesce(section, F.lit("")))
    found = []
    for i, (kind, patterns, against, words) in enumerate(TOPICS):
        base = F.when(any_word(title, words), BASE + BOOST).otherwise(BASE)
        hit = any_of(t, patterns)
        if against:
            hit = hit & ~any_of(t, against)
        found.append(F.when(hit, F.struct(base.alias("base"), F.lit(-i).alias("order"), F.lit(kind).alias("kind"))))
    return F.greatest(*found)


def keyword_scores(text: Column, keywords: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> Column:
    """array<struct<score, order, kind>> of the given types' strong and weak words: 20 points a strong and 20/3 a weak one, 100 at most. A hyphen may also be a space or nothing."""
    low = F.lower(text)
    some = F.size(F.filter(F.split(low, r"\W+"), lambda w: F.length(w) > 2)) > 0
    count = lambda words: sum((any_word(low, (w, w.replace("-", " "), w.replace("-", ""))).cast("int") for w in words), F.lit(0))
    score = lambda strong, weak: F.floor(F.least(F.lit(100.0), (count(strong) * 3 + count(weak)) / 15 * 100) + 0.5).cast("int")
    return F.array(*[F.struct(F.when(some, score(*words)).otherwise(0).alias("score"), F.lit(-i).alias("order"), F.lit(kind).alias("kind")) for i, (kind, words) in enumerate(keywords.items())])


def best_keywords(text: Column, keywords: dict) -> Column:
    """struct(score, order, kind) of the type with the greatest score, from 15 on; context rows have none. Else null."""
    top = F.array_max(keyword_scores(text, {k: w for k, w in keywords.items() if k != "CONTEXTUAL"}))
    return F.when(top["score"] >= 15, top)


def answer_kind(df, text: str, section: str, keywords: dict):
    """df with structure (struct), kind and kind_confidence. Done in steps, so that no expression repeats another."""
    t = F.col(text)
    df = df.withColumn("structure", structure(t)).withColumn("__topic", best_topic(t, F.col(section))).withColumn("__words", best_keywords(t, keywords))
    s, c, topic = F.col("structure.kind"), F.col("structure.confidence"), F.col("__topic")
    default = F.element_at(F.create_map(*[F.lit(x) for pair in ANSWERS.items() for x in pair]), s)
    with_topic = (
        F.when((s == "yes_no") & (c >= 90), F.when(topic["base"] < BASE + BOOST, "DECLARATIVE").otherwise(topic["kind"]))
        .when(s == "confirmation", "PROCEDURAL")
        .when(s == "statement", "CONTEXTUAL")
        .otherwise(topic["kind"])
    )
    kind = F.when(topic.isNotNull(), with_topic).when(F.col("__words.score") >= 20, F.col("__words.kind")).otherwise(default)
    df = df.withColumn("__kind", kind).withColumn("__how", matches(strip(t), HOW_AFTER)).withColumn("__acts", matches(strip(t), ACTION_START))
    k = F.col("__kind")
    kind = F.when(F.col("__how"), "DESCRIPTIVE").when((s == "yes_no") & (c >= 85) & k.isin("CONTEXTUAL", "DESCRIPTIVE"), "DECLARATIVE").otherwise(k)
    kind = F.when((kind == "CONTEXTUAL") & (((s == "open_ended") & (c >= 85)) | (F.col("__acts") & (s != "yes_no"))), "DESCRIPTIVE").when((kind == "CONTEXTUAL") & F.col("__acts"), "DECLARATIVE").otherwise(kind)
    df = df.withColumn("kind", kind)
    title = F.lower(F.coalesce(F.col(section), F.lit("")))
    titled = F.lit(False)
    for name, words in TITLE_WORDS.items():
        titled = titled | ((F.col("kind") == name) & any_word(title, words))
    aligned = F.when(topic["kind"] == default, 18).when(topic.isNotNull() & (s != "unknown") & (c > 70), -10).otherwise(0)
    points = F.lit(55.0) + F.when(s != "unknown", c * 0.35).otherwise(0.0) + F.when(topic.isNotNull(), topic["base"] * 0.30).otherwise(0.0) + aligned + F.when(titled, 8).otherwise(0) + F.when(c >= 90, 5).otherwise(0)
    df = df.withColumn("kind_confidence", F.greatest(F.lit(35), F.least(F.lit(95), F.floor(points + 0.5))).cast("int"))
    return df.drop("__topic", "__words", "__kind", "__how", "__acts")
