"""Queries of the extraction path. Their folds have no SQL; tests hold them against hand-made cases."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.functions import offsets as O
from reqloom.functions import text as N
from reqloom.operators import extraction as X
from reqloom.operators import parallel
from reqloom.operators import profile as P
from reqloom.operators.asking import profiles
from reqloom.plans.texts import tender_documents, varied_tenders
from reqloom.session import written
from reqloom.sources.html import html_text


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised tender texts of all projects, in all numbering families."""
    return varied_tenders(spark, sf_dir).select(F.col("project_id").alias("doc_id"), N.preprocess(F.col("text"), tables=False).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def pattern_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.detected_families(tenders(spark, sf_dir))


def section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.detected_sections(tenders(spark, sf_dir))


def requirement_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.all_candidates(tenders(spark, sf_dir))


def extracted_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.classified(tenders(spark, sf_dir))


def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extraction_stats(X.classified(tenders(spark, sf_dir)))


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenders with a profile: numeric labels under 3. only."""
    return tenders(spark, sf_dir).withColumn("families", F.array(F.lit("numeric"))).withColumn("prefixes", F.array(F.lit("3.")))


def guided_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan by a profile."""
    return X.candidates(profiled(spark, sf_dir), profile=True)


def guided_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan by a profile finds, classified."""
    docs = profiled(spark, sf_dir)
    return X.classified(docs, X.candidates(docs, profile=True, titles=True))


def tender_told(prompt: str) -> str:
    """Stands in for a model: the family of the first label that stands at a line's start; no reply where there is none."""
    heads = (("bracket", r"(?m)^\[?REQ-"), ("numeric", r"(?m)^\d+\.\d"), ("letter", r"(?m)^[A-Z]\.\d"), ("parenthetical", r"(?m)^\("))
    found = sorted((m.start(), name) for name, p in heads for m in [re.search(p, prompt)] if m)
    if not found:
        raise LookupError("no labels")
    return json.dumps({"primaryPatternFamily": found[0][1], "skipSections": [{"title": "Scope of Work", "reason": "examples"}], "metadata": {"estimatedRequirementCount": 9}, "confidence": 90})


def profiled_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenders profiled, then scanned each by its own profile (those without a profile as without one), and classified."""
    docs = written(tenders(spark, sf_dir), "tenders")
    made = profiles(docs, tender_told, P.prompt(F.col("text")), tasks=int(spark.conf.get("spark.sql.shuffle.partitions")), wait=lambda s: None)
    ready = P.guided(docs, made)
    return X.classified(ready, X.candidates(ready, profile=True, titles=True))


def extraction_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.bins(X.candidates(tenders(spark, sf_dir)), 3)


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and tenders under negative ids."""
    return documents(spark, sf_dir).unionByName(tenders(spark, sf_dir).withColumn("doc_id", -F.col("doc_id")))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents and tenders, by each of the three routes."""
    return parallel.planned_chunks(written(all_texts(spark, sf_dir), "texts"))


def chunked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all documents and tenders, with many tasks to a long text."""
    return parallel.candidates(written(all_texts(spark, sf_dir), "texts"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def profile_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample, table of contents and skipped section of all documents and tenders."""
    docs = documents(spark, sf_dir).unionByName(tenders(spark, sf_dir))
    t = F.col("text")
    return docs.select("doc_id", P.sample(t, 2000).alias("sample"), P.contents(t).alias("contents"), P.without_section(t, F.lit("Scope of Work")).alias("rest"))


def range_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(tenders(spark, sf_dir), "tenders")
    rows = X.candidates(docs)
    return P.range_texts(docs, rows, docs.select("doc_id", F.lit("3.1").alias("first"), F.lit("3.2.99999").alias("last")))


def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sentence of the documents begins, in code points and in UTF-16 units; every e stands as a letter of two units."""
    docs = documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("e"), F.lit("\U0001f600")))
    parts = docs.select("doc_id", F.posexplode(F.transform(F.split("text", r"\. "), lambda x: F.length(x) + 2)).alias("nth", "points"))
    before = Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    spans = parts.select("doc_id", "nth", F.coalesce(F.sum("points").over(before), F.lit(0)).cast("int").alias("start"))
    return O.spans_in_units(spans.withColumn("unit", F.col("start")), docs, "doc_id", "text", "unit")


UNITS_SQL = """with d as (select doc_id, string_split(replace(text, 'e', chr(128512)), '. ') as parts from documents), p as (select doc_id, unnest(parts) as said, unnest(range(len(parts))) as nth from d),
n as (select *, length(said) + 2 as points, length(said) - length(replace(said, chr(128512), '')) as wide from p)
select doc_id, nth::int as nth, coalesce(sum(points) over w, 0)::int as start, coalesce(sum(points + wide) over w, 0)::int as unit from n window w as (partition by doc_id order by nth rows between unbounded preceding and 1 preceding)"""

QUERIES = {f.__name__: (f, None) for f in (pattern_families, section_map, requirement_candidates, extracted_requirements, extraction_stats, guided_candidates, guided_requirements, profiled_requirements, extraction_bins, document_chunks, chunked_candidates, page_texts, profile_inputs, range_texts)}
QUERIES["sentence_units"] = (sentence_units, UNITS_SQL)
