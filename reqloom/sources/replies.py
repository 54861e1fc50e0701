"""Replies of an extraction worker, one JSON line each, as a source of requirement rows.

Lines come from Spark's own text reader, as a table or as a stream, so files are split over tasks and a stream's checkpoint
holds what has been read. A reply is checked against its schema; what fails goes whole to a table of dead letters with the
reason. Each micro-batch is one bulk insert under the name of the source and the number of the batch: requirements, jobs
and dead letters are seen at once, and a batch that is repeated after a crash adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqloom.sources.bulk import bulk_insert

REPLY = "project_id long, status string, requirements array<struct<section: string, sectionGroup: string, text: string, type: string, isMandatory: boolean, domainContext: string>>, unread string"


def checked(lines: DataFrame) -> DataFrame:
    """lines: value. value, reply, reason: null where the reply is good."""
    reply = F.from_json("value", REPLY, {"columnNameOfCorruptRecord": "unread"})
    r = F.col("reply")
    reason = (
        F.when(r.isNull() | r["unread"].isNotNull(), "no reply")
        .when(r["project_id"].isNull(), "no project")
        .when(F.coalesce(r["status"], F.lit("")) == "error", "worker failed")
        .when(r["requirements"].isNull(), "no requirements")
        .when(F.exists(r["requirements"], lambda x: F.coalesce(F.trim(x["text"]), F.lit("")) == ""), "requirement without text")
    )
    return lines.select("value", reply.alias("reply")).withColumn("reason", reason)


def reply_tables(lines: DataFrame) -> dict[str, DataFrame]:
    """Rows of the requirement, job and dead_letter tables that the lines give; defaults where a reply leaves a field out."""
    read = checked(lines)
    good = read.where("reason is null")
    rows = good.select(F.col("reply.project_id").alias("project_id"), F.posexplode("reply.requirements").alias("ord", "x"))
    domain = F.coalesce(F.nullif(F.col("x.domainContext"), F.lit("")), F.lit("FEATURE"))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return {
        "requirement": rows.select(
            "project_id", "ord", F.col("x.text").alias("text"), empty("x.section").alias("section"), empty("x.sectionGroup").alias("section_group"), F.coalesce(empty("x.type"), F.lit("DESCRIPTIVE")).alias("type"),
            F.coalesce("x.isMandatory", F.lit(True)).alias("is_mandatory"), domain.alias("domain_context"), (domain == "LEGAL").alias("requires_review"), F.lit("UNANSWERED").alias("status"),
        ),
        "job": good.select(F.col("reply.project_id").alias("project_id"), F.lit("COMPLETE").alias("status"), F.size("reply.requirements").alias("requirements")),
        "dead_letter": read.where("reason is not null").select("value", "reason"),
    }


def ingest(lines: DataFrame, path: str, checkpoint: str, source: str):
    """Inserts what a stream of lines has now into the tables at path. source names the stream; one name goes with one checkpoint."""

    def insert(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            bulk_insert(reply_tables(batch), path, f"{source}-{number}")
        finally:
            batch.unpersist()

    query = lines.select("value").writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
