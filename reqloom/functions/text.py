"""Normalisation of tender texts and of drafted answers."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqloom.functions.regexlib import holds, java, let, matches, replaced, replaced_where_found, where

HEAVY, LIGHT = "═" * 80, "─" * 58

# The steps of text normalisation, in their order.
WHITESPACE = ((r"\r\n", "\n"), (r"\r", "\n"), (r"\n{4,}", "\n\n\n"), (r"[^\S\n]{3,}", "  "))
SECTION_NUMBERS = (
    (r"(\d+)\.\s*\n+\s*(\d+)\.\s*\n+\s*(\d+)", "$1.$2.$3"),
    (r"(\d+)\.\s*\n+\s*(\d+)", "$1.$2"),
    (r"(\d+)\.\s+(\d+)\.\s+(\d+)(?=\s|\z)", "$1.$2.$3"),
    (r"(\d+)\.\s+(\d+)(?=\s|\z)", "$1.$2"),
)
BULLETS = (
    (r"^(\s*)[○●◦◆◇▪▫►▸→‣⁃]", "$1• "),
    (r"^(\s*)\*\s+", "$1• "),
    (r"^(\s*)-\s+(?=[A-Z])", "$1• "),
    (r"^(\s*)[–—]\s+", "$1• "),
)
LISTS = ((r"^(\s*)(\d+)\.(?!\d)\s*", "$1$2. "), (r"^(\s*)([a-z])\)\s*", "$1$2) "))
LISTS_ANY_CASE = ((r"^(\s*)\(([ivxlc]+)\)\s*", "$1($2) "),)
LETTERED = ((r"^(\s*)\(([a-z])\)\s*", "$1($2) "),)
HEAVY_HEADINGS = (
    (r"\n(\s*)(\d+\.0\s+)([A-Z][A-Z\s]{2,}|[A-Z][a-z]+(?:\s+[A-Za-z]+){0,4})(?=\s*\n)", ""),
    (r"\n(\s*)(Section\s+\d+[.:]\s*)([A-Z][A-Za-z\s,&\-]{3,})", "i"),
    (r"\n(\s*)(\d+\s+)([A-Z]{2,}(?:\s+[A-Z]{2,})+)(?=\s*\n)", ""),
)
LIGHT_HEADING = r"\n(\s*)(\d+\.\d+\s+)([A-Z][A-Za-z\s,&\-:]{3,40})(?=\s*\n)"
TABLE_HEADER = ((r"^(\s*)([A-Za-z]+(?:\s{2,}|\t)[A-Za-z]+(?:\s{2,}|\t)[A-Za-z]+.*)$", "$1[TABLE HEADER] $2"),)
INLINE_LISTS = ((r"([.?!])\s*(•)", "$1\n$2"), (r"([.?!])\s*(\d+\.|\([a-z]\)|[a-z]\))", "$1\n$2"), (r"\n(•|\d+\.|\([a-z]\)|[a-z]\))", "\n  $1"))
# Markers that are escaped before a text is shown to a language model.
PROMPT_MARKERS = (r"```system", r"```assistant", r"```user", r"<\|im_start\|>", r"<\|im_end\|>", r"\[INST\]", r"\[\/INST\]", r"<<SYS>>", r"<\/SYS>>", "Human:", "Assistant:", "System:", "SYSTEM:", "USER:", "ASSISTANT:")
MODEL_CHARS = 250_000
# Stock phrases that are removed from drafts.
FLUFF = tuple(
    (rf"\b{p}\s*", "")
    for p in (
        "It is worth noting that", "It should be noted that", "As mentioned previously,?", "As stated above,?", "Moving forward,?", "Going forward,?",
        "At the end of the day,?", "In terms of", "With respect to", "In this regard,?", "For your consideration,?", "Please be advised that",
        "Needless to say,?", "It goes without saying that", "As a matter of fact,?", "In fact,?", "We would like to take this opportunity to",
        "We are confident that", "Rest assured,?", "Additionally,?", "Furthermore,?", "Moreover,?", "We are pleased to", "It is our pleasure to",
        "We believe that", "We feel that", "It is important to note that", "It is essential to", "In conclusion,?", "To summarize,?",
        "confirms a? ?comprehensive capability in", "confirms capability in", "confirms full capability in", "Response details:?", "To conclude,?",
        "Please do not hesitate to", "Should you have any questions,?", "We are happy to", "We are delighted to", "Aligning with the requirements,?", "In accordance with",
    )
)
# Claims and what stands for them.
OVERCLAIMS = (
    (r"\bwe guarantee\b", "[COMPANY NAME] is committed to"),
    (r"\bguarantees?\b", "is designed to support"),
    (r"\b100% uptime\b", "high availability [CONFIRM SLA]"),
    (r"\b100% secure\b", "robust security measures"),
    (r"\bindustry-leading\b", "comprehensive"),
    (r"\bbest-in-class\b", "robust"),
    (r"\bbest in class\b", "robust"),
    (r"\bunmatched\b", "comprehensive"),
    (r"\bunparalleled\b", "extensive"),
    (r"\bwe always\b", "[COMPANY NAME] typically"),
    (r"\bwe never\b", "[COMPANY NAME] is designed to avoid"),
    (r"\bfully compliant\b", "designed to support compliance"),
    (r"\bfully certified\b", "[CONFIRM certification status]"),
    (r"\bensures compliance\b", "supports compliance efforts"),
    (r"\bintegrates with\b", "supports integration with"),
    (r"\bprovides seamless\b", "supports"),
    (r"\bseamlessly\b", ""),
    (r"\beffortlessly\b", ""),
    (r"\bworld-class\b", "comprehensive"),
    (r"\bcutting-edge\b", "modern"),
    (r"\bstate-of-the-art\b", "current"),
)
ONE_SPACE = ((r"[^\S\n]+", " "),)
LINE_ENDS = ((r"^ +", ""), (r" +$", ""))
TWO_BREAKS = ((r"\n{3,}", "\n\n"),)
BULLET_BREAKS = ((r"([^\n•\-\*])[ \t]*\n?([•\-\*])", "$1\n\n$2"), (r"([•\-\*][^\n]+)\n([A-Z])", "$1\n\n$2"))
TABLE_RULES = ((r"^\|[-:\s|]+\|$", ""),)
STRAY_PIPES = ((r"^\s*\|\s*", ""), (r"\s*\|\s*$", ""))
# Terms that a domain forbids, and the notices that two domains add.
FORBIDDEN = {
    "FEATURE": ("guaranteed", "always", "never", "best", "industry-leading", "unmatched", "100%"),
    "PROCESS": ("quick", "seamless", "effortless", "instant", "guaranteed timeline", "immediately", "fast"),
    "LEGAL": ("guarantee", "certify", "warrant", "promise", "ensure compliance", "fully compliant", "100% secure", "bulletproof", "never", "always", "complete protection", "absolute"),
}
NOTICES = {
    "PROCESS": "Actual timelines may vary based on scope and customer readiness.",
    "LEGAL": "Compliance responsibilities are shared between parties as defined in the applicable agreement.",
}


#: The characters that java() has for \\s.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def section_markers(text: Column) -> Column:
    for pattern, flags in HEAVY_HEADINGS:
        text = replaced(text, ((pattern, f"\n\n{HEAVY}\n$1$2$3\n{HEAVY}\n"),), flags)
    return replaced(text, ((LIGHT_HEADING, f"\n\n{LIGHT}\n[SUBSECTION] $1$2$3\n{LIGHT}\n"),), "")


def separate_requirements(text: Column) -> Column:
    """A blank line before each three-part number, unless a line break is there."""
    return replaced(text, ((r"(\S)[^\S\n]*(?<!\n)(?<![\d.])(\d+\.\d+\.\d+\.?\s+)", "$1\n\n$2"),), "")


def bulleted(text: Column) -> Column:
    out = replaced(text, BULLETS[:1], "m")
    for step, signs in zip(BULLETS[1:], ("*", "-", "–—"), strict=True):
        out = where(out, holds(*signs), lambda t, step=step: replaced(t, (step,), "m"))
    return out


def numbered_lists(text: Column) -> Column:
    out = where(replaced(text, LISTS[:1], "m"), holds(")"), lambda t: replaced(t, LISTS[1:], "m"))
    return where(out, holds("("), lambda t: replaced(replaced(t, LISTS_ANY_CASE, "mi"), LETTERED, "m"))


def preprocess(text: Column, markers: bool = True, separate: bool = True, bullets: bool = True, lists: bool = True, tables: bool = True) -> Column:
    """Normalised tender text; each optional step can be left out."""
    out = where(text, holds("\r"), lambda t: replaced(t, WHITESPACE[:2], ""))
    out = where(out, holds("\n\n\n\n"), lambda t: replaced(t, WHITESPACE[2:3], ""))
    out = replaced(replaced(out, WHITESPACE[3:], ""), SECTION_NUMBERS, "")
    out = section_markers(out) if markers else out
    out = separate_requirements(out) if separate else out
    out = bulleted(out) if bullets else out
    out = numbered_lists(out) if lists else out
    out = replaced(out, TABLE_HEADER, "m") if tables else out
    return strip(where(out, holds("\n\n\n\n"), lambda t: replaced(t, WHITESPACE[2:3], "")))


def for_model(text: Column) -> Column:
    """Escaped for a language model: control characters, prompt markers, runs of marks, code fences, length."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for marker in PROMPT_MARKERS:
        out = F.regexp_replace(out, f"(?i){marker}", "[ESCAPED: $0]")
    out = F.regexp_replace(out, r"[#*_~`]{5,}", "[REDACTED]")
    out = F.regexp_replace(out, r"(?s)```(.*?)```", "[DOCUMENT CODE BLOCK START]\n$1\n[DOCUMENT CODE BLOCK END]")
    return F.when(F.length(out) > MODEL_CHARS, F.concat(F.substring(out, 1, MODEL_CHARS), F.lit("\n[DOCUMENT TRUNCATED]"))).otherwise(out)


def section_header(text: Column) -> Column:
    """Whether a line reads as a heading, not as a requirement."""
    t = strip(text)
    words = F.split(t, java(r"\s+"))
    titled = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))) * 2 > F.size(words)
    asks = matches(t, r"^(Does|Do|Can|Will|Should|Must|Is|Are|Has|Have|Describe|Explain|Provide)")
    return (F.length(t) <= 100) & ~t.contains("?") & (titled | t.endswith(":")) & ~asks


def requirement_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(java(r"\b(\d+\.\d+\.\d+|[A-Z]\.\d+\.\d+)\b")), F.lit(1))


SECTION_IDS = (r"\b(\d+\.\d+\.\d+)\b", r"\b(\d+\.\d+)\b", r"\b([A-Z]\.\d+\.\d+)\b", r"\b([A-Z]\.\d+)\b")


def section_ids(text: Column) -> Column:
    """Distinct ids in all four numbering styles."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(java(p)), F.lit(1)) for p in SECTION_IDS])))


SPLITTER = r"(\d+\.\d+\.\d+|\d+\.\d+\s*[a-z]\)|[A-Z]\.\d+\.\d+)\s+"


def split_requirements(text: Column) -> Column:
    """array<struct<section, text>>: the parts behind each id; a text without ids is one part."""
    ids = F.transform(F.regexp_extract_all(text, F.lit(java(SPLITTER)), F.lit(1)), strip)
    parts = F.transform(F.split(text, java(SPLITTER)), strip)
    pairs = F.zip_with(ids, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda i, p: F.struct(i.alias("section"), F.coalesce(p, F.lit("")).alias("text")))
    return F.when(F.size(ids) == 0, F.array(F.struct(F.lit("").alias("section"), strip(text).alias("text")))).otherwise(F.filter(pairs, lambda x: x["text"] != ""))


def list_breaks(text: Column) -> Column:
    return replaced(text, INLINE_LISTS, "")


def without_fluff(draft: Column) -> Column:
    return strip(replaced(replaced(replaced(replaced_where_found(draft, FLUFF), ONE_SPACE, ""), LINE_ENDS, "m"), TWO_BREAKS, ""))


def guarded(draft: Column) -> Column:
    return replaced(replaced_where_found(draft, OVERCLAIMS), ONE_SPACE, "")


def tidy_breaks(draft: Column) -> Column:
    return strip(replaced(replaced(replaced(draft, BULLET_BREAKS, ""), TWO_BREAKS, ""), ((r"[ \t]+$", ""),), "m"))


def without_tables(draft: Column) -> Column:
    """Markdown table rows as bullets."""

    def bullet(line: Column) -> Column:
        cells = F.filter(F.transform(F.split(F.regexp_extract(line, r"^\|(.+)\|$", 1), r"\|"), strip), lambda c: c != "")
        joined = F.when(F.size(cells) == 2, F.array_join(cells, ": ")).otherwise(F.array_join(cells, " - "))
        return F.when(~line.rlike(r"^\|.+\|$"), line).when(F.size(cells) == 0, "").otherwise(F.concat(F.lit("• "), joined))

    lines = F.transform(F.split(replaced(draft, TABLE_RULES, "m"), "\n"), bullet)
    return replaced(replaced(F.array_join(lines, "\n"), STRAY_PIPES, "m"), TWO_BREAKS, "")


def by_domain(draft: Column, domain: Column) -> Column:
    """Forbidden terms out (in legal drafts: marked), the domain's notice added, spaces tidied."""

    def noted(name: str, done: Column) -> Column:
        has = done.contains(NOTICES[name]) | done.contains("[DRAFT]")
        has = has | done.contains("may vary") if name == "PROCESS" else has
        return F.when(has, done).otherwise(F.concat(strip(done), F.lit("\n\n" + NOTICES[name])))

    def chosen(whole: Column) -> Column:
        out = whole
        for name, terms in FORBIDDEN.items():
            done = replaced_where_found(whole, tuple((rf"\b{t}\b", "[REVIEW: term removed]" if name == "LEGAL" else "") for t in terms))
            done = let(done, partial(noted, name)) if name in NOTICES else done
            out = F.when(domain == name, done).otherwise(out)
        return out

    return strip(replaced(replaced(let(draft, chosen), ONE_SPACE, ""), TWO_BREAKS, ""))


def with_company(text: Column, name: Column) -> Column:
    """The company placeholder, in any case and spacing, filled in; unchanged without a name."""
    filled = F.call_function("array_join", F.split(text, r"(?i)\[\s*company\s+name\s*\]"), name)
    return F.when(F.coalesce(name, F.lit("")) == "", text).otherwise(filled)
