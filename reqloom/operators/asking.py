"""Rows put to an outside model: the seam behind which a language model, or anything that answers texts, may stand.

Only rows below a confidence are asked about; all others pass by. Asked rows are dealt over a stated number of tasks, each
with a stated number of calls in flight, so the load on the other side is bounded by their product whatever the cluster's
size. A call carries a few prompts; its reply is JSON, a list under "r" with an object for each prompt that names its place
in "i". Answers go back to their rows by that place. A call that fails is tried again after a growing wait; one that keeps
failing, or whose reply leaves places out, is split, down to single prompts, and a prompt that fails alone leaves its row as
it was. So a row's result depends on its own prompt only, not on the rows that shared its call or task. Values that are not
allowed leave the old ones; answered rows get the confidence of an answer.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.operators.expiring import backoff

# The kinds of requirements, and what a message says if trying again is of no use.
KINDS = ("DECLARATIVE", "DESCRIPTIVE", "QUANTITATIVE", "REFERENCE_BASED", "EVIDENCE_BASED", "STAFFING", "PROCEDURAL", "CONTEXTUAL")
FINAL = ("invalid api key", "authentication", "quota exceeded", "insufficient_quota", "billing", "rate_limit_exceeded")
MOST_CHARS, ANSWERED = 500, 95  # of a text in a prompt; the confidence of an answer


def reply(ask: Callable, given: list[str] | str, read: Callable, retries: int, wait: Callable[[float], None]):
    """What read makes of a reply's JSON; None where no call succeeds."""
    for attempt in range(retries + 1):
        try:
            return read(json.loads(ask(given)))
        except Exception as e:  # whatever the other side raises, the row keeps its values
            if attempt == retries or any(said in str(e).lower() for said in FINAL):
                return None
            wait(backoff(attempt, 1000, 10_000) / 1000)
    return None


def tried(ask: Callable[[list[str]], str], prompts: list[str], retries: int, wait: Callable[[float], None]) -> dict[int, dict]:
    """Answers by place; fewer, or none, where the reply lacks them or no call succeeds."""
    fits = lambda x: isinstance(x, dict) and isinstance(x.get("i"), int) and 0 <= x["i"] < len(prompts)
    return reply(ask, prompts, lambda said: {x["i"]: x for x in said["r"] if fits(x)}, retries, wait) or {}


def answers(ask: Callable[[list[str]], str], prompts: list[str], retries: int, wait: Callable[[float], None]) -> list[dict | None]:
    """An answer for each prompt, or None; what a call leaves out is asked again in halves."""
    found = tried(ask, prompts, retries, wait)
    missing = [i for i in range(len(prompts)) if i not in found]
    if missing and len(prompts) > 1:
        middle = -(-len(missing) // 2)
        for part in (missing[:middle], missing[middle:]):
            more = answers(ask, [prompts[i] for i in part], retries, wait) if part else []
            found |= {i: x for i, x in zip(part, more) if x is not None}
    return [found.get(i) for i in range(len(prompts))]


def refined(rows: DataFrame, ask: Callable[[list[str]], str], prompt: Column, id_: str, kind: str = "type", mandatory: str = "is_mandatory", confidence: str = "confidence", least: int = 70,
            prompts: int = 10, in_flight: int = 3, tasks: int = 8, retries: int = 2, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """rows with what ask says of those below least, and answered: true, false (asked in vain) or null (not asked)."""
    low = F.coalesce(F.col(confidence) < least, F.lit(True))
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", answered boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                said = [t or "" for t in batch.column(len(names)).to_pylist()]
                calls = [said[i : i + prompts] for i in range(0, len(said), prompts)]
                found = [x for part in pool.map(lambda c: answers(ask, c, retries, wait), calls) for x in part]
                columns = dict(zip(names, batch.columns))
                old_kind, old_mandatory, old_confidence = (columns[c].to_pylist() for c in (kind, mandatory, confidence))
                columns[kind] = pa.array([x["type"] if x and x.get("type") in KINDS else old for x, old in zip(found, old_kind)], batch.schema.field(kind).type)
                columns[mandatory] = pa.array([x["mandatory"] if x and isinstance(x.get("mandatory"), bool) else old for x, old in zip(found, old_mandatory)], pa.bool_())
                columns[confidence] = pa.array([ANSWERED if x else old for x, old in zip(found, old_confidence)], batch.schema.field(confidence).type)
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array([x is not None for x in found])], names=[*names, "answered"])

    asked = rows.where(low).withColumn("__prompt", F.left(prompt, F.lit(MOST_CHARS))).repartition(tasks, id_).mapInArrow(run, schema)
    return rows.where(~low).withColumn("answered", F.lit(None).cast("boolean")).unionByName(asked)


# The numbering families a profile may name, why a section is skipped, and kinds of documents.
FAMILIES = ("numeric", "letter", "parenthetical", "bracket", "outline", "roman", "letter-number")
REASONS = ("appendix", "examples", "definitions", "boilerplate", "administrative", "vendor_info")
DOCUMENTS = ("rfp", "rfq", "ifb", "solicitation", "other")
PROFILE = "`primary` string, families array<string>, prefixes array<string>, skipped array<struct<title:string,reason:string>>, has_contents boolean, has_appendices boolean, has_definitions boolean, expected long, document_type string, confidence int"
_PROFILE = pa.schema([("primary", pa.string()), ("families", pa.list_(pa.string())), ("prefixes", pa.list_(pa.string())), ("skipped", pa.list_(pa.struct([("title", pa.string()), ("reason", pa.string())]))),
                      ("has_contents", pa.bool_()), ("has_appendices", pa.bool_()), ("has_definitions", pa.bool_()), ("expected", pa.int64()), ("document_type", pa.string()), ("confidence", pa.int32())])


def read_profile(said: dict) -> dict | None:
    """A reply's profile, each part held to its type; None without a family or without facts about the document."""
    primary, facts = said.get("primaryPatternFamily"), said.get("metadata")
    if not primary or not isinstance(facts, dict) or not facts:
        return None
    primary = primary if primary in FAMILIES else "numeric"
    listed = lambda name: said[name] if isinstance(said.get(name), list) else []
    number = lambda v, most: int(min(max(v, 0), most)) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v else None
    flag = lambda name: facts[name] if isinstance(facts.get(name), bool) else None
    skipped = [x for x in listed("skipSections") if isinstance(x, dict) and isinstance(x.get("title"), str) and x["title"].strip()]
    return {
        "primary": primary,
        "families": list(dict.fromkeys([primary, *(f for f in listed("secondaryPatternFamilies") if f in FAMILIES)])),
        "prefixes": [p for p in listed("requirementSectionPrefixes") if isinstance(p, str) and p],
        "skipped": [{"title": x["title"], "reason": x["reason"] if x.get("reason") in REASONS else None} for x in skipped],
        "has_contents": flag("hasTableOfContents"), "has_appendices": flag("hasAppendices"), "has_definitions": flag("hasDefinitionsSection"),
        "expected": number(facts.get("estimatedRequirementCount"), 2**53), "confidence": number(said.get("confidence"), 100),
        "document_type": facts["documentType"] if facts.get("documentType") in DOCUMENTS else "other",
    }


def profiles(docs: DataFrame, ask: Callable[[str], str], prompt: Column, id_: str = "doc_id", in_flight: int = 3, tasks: int = 8, retries: int = 2, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """id_ and the profile that ask gives for each prompt, a call a document; all null where it gives none, or the prompt is blank.

    Only the prompt travels, so its length is what bounds a task; a document's profile joins its text by id_.
    """
    given = docs.select(id_, prompt.alias("__prompt"))
    schema = f"`{id_}` {given.schema[id_].dataType.simpleString()}, {PROFILE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                found = list(pool.map(lambda p: reply(ask, p, read_profile, retries, wait) if p and p.strip() else None, batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x and x[f.name] for x in found], f.type) for f in _PROFILE)], names=[id_, *_PROFILE.names])

    return given.repartition(tasks, id_).mapInArrow(run, schema)
