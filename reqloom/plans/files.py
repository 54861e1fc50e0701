"""Queries of file sources and sinks, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.plans.corpus import PROJECTS_SQL, REQUIREMENTS_SQL, projects, requirements
from reqloom.session import shared_dir
from reqloom.sources import bulk, pdf, replies


def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as PDF files and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = pdf.merged_pages(pdf.as_pdf(docs.select(F.col("doc_id").cast("string").alias("path"), "text")))
    return read.select(F.col("path").cast("long").alias("doc_id"), "text", "defect")


PDF_SQL = r"""with d as (select doc_id, nullif(trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x{0B}\x{FEFF}]+', ' ', 'g')), '') as text from documents)
select doc_id, text, case when text is null then 'empty' end as defect from d"""



def bulk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements, the jobs that found them and their projects, inserted as three batches, one of them twice, and read back."""
    where = f"{shared_dir(spark)}/bulk-{uuid.uuid4().hex}"
    rows, owners = requirements(spark, sf_dir), projects(spark, sf_dir)
    for batch in (0, 1, 2, 1):
        mine = rows.where(F.col("project_id") % 3 == batch)
        tables = {
            "requirement": mine.select(F.col("requirement_id").alias("id"), "project_id", F.col("text").alias("said")),
            "job": mine.groupBy("project_id").agg(F.max("requirement_id").alias("id"), F.concat(F.lit("COMPLETE "), F.count(F.lit(1)).cast("string")).alias("said")).select("id", "project_id", "said"),
            "project": owners.where(F.col("project_id") % 3 == batch).select(F.col("project_id").alias("id"), "project_id", F.lit("READY").alias("said")),
        }
        bulk.bulk_insert(tables, where, f"batch-{batch}")
    parts = [bulk.bulk_table(spark, where, name).select(F.lit(name).alias("table"), "id", "project_id", "said") for name in ("requirement", "job", "project")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


BULK_SQL = f"""with {REQUIREMENTS_SQL}, {PROJECTS_SQL} select 'requirement' as "table", requirement_id as id, project_id, text as said from requirements
union all select 'job', max(requirement_id), project_id, 'COMPLETE ' || count(*) from requirements group by project_id union all select 'project', project_id, project_id, 'READY' from projects"""

def worker_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a worker, one a project and some of them broken, read as a stream in two runs; the rows and dead letters that they give."""
    where = f"{shared_dir(spark)}/replies-{uuid.uuid4().hex}"
    row = F.struct("section", F.col("text").alias("text"), F.col("type").alias("type"), F.col("is_mandatory").alias("isMandatory"), F.col("domain_context").alias("domainContext"))
    lists = requirements(spark, sf_dir).where("text <> ''").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("ord", row.alias("x")))).alias("l"))
    said = F.to_json(F.struct(F.when(F.col("project_id") % 11 != 5, F.col("project_id")).alias("project_id"), F.transform("l", lambda x: x["x"]).alias("requirements")))
    lines = lists.select("project_id", F.when(F.col("project_id") % 7 == 3, F.substring(said, F.lit(1), F.length(said) - 2)).otherwise(said).alias("value"))
    for part in (0, 1):
        lines.where(F.col("project_id") % 2 == part).select("value").write.mode("append").text(f"{where}/in")
        replies.ingest(spark.readStream.text(f"{where}/in"), f"{where}/store", f"{where}/check", "worker")
    rows = bulk.bulk_table(spark, f"{where}/store", "requirement").select("project_id", "ord", "text", "section", "type", "is_mandatory", "domain_context", "requires_review", F.lit(None).cast("string").alias("reason"))
    dead = bulk.bulk_table(spark, f"{where}/store", "dead_letter").groupBy("reason").agg(F.count(F.lit(1)).cast("int").alias("ord"))
    return rows.unionByName(dead, allowMissingColumns=True)


REPLIES_SQL = f"""with {REQUIREMENTS_SQL}, k as (select *, (row_number() over (partition by project_id order by ord) - 1)::int as place, case when project_id % 7 = 3 then 'no reply' when project_id % 11 = 5 then 'no project' end as why from requirements where text <> '')
select project_id, place as ord, text, section, type, is_mandatory, domain_context, domain_context = 'LEGAL' as requires_review, null::varchar as reason from k where why is null
union all select null, count(distinct project_id)::int, null, null, null, null, null, null, why from k where why is not null group by why"""

QUERIES = {"pdf_texts": (pdf_texts, PDF_SQL), "bulk_rows": (bulk_rows, BULK_SQL), "worker_replies": (worker_replies, REPLIES_SQL)}
