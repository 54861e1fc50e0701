"""Steps behind a cheap test against the same steps without it, and titles of the scan against those of a join."""

import random

from pyspark.sql import functions as F

from reqloom.functions import rules as R
from reqloom.functions import text as N
from reqloom.functions.regexlib import java, matches, replaced
from reqloom.operators import extraction as X

BITS = ["3.1.1 ", " 3.2 Title Words", " [3.4]: Title", " REQ-5 Title", " A.1.a Title", " II.A Title", " iv. title", " | Pass/Fail", " | yes", "| n/a ", "Enter response here:", "type ANSWER here", "Bidder Reply: ", "vendor response", " (x) Name of it", ")", " 3 of 9 Request for Proposal X", " Page 1 of 2 more",
        "PAGE 2 OF 3", "═══", "│", "[Col 2]", "[ROW 3]", "Col 4]", "\r\n", "\r", "\n\n\n\n\n", "\n", " ", " ", "﻿", "   ", "\t", "* star", "\n- Dash", "\n– dash", "\n— dash", "\n○ round", "\na)x", "\n(iv)x", "\n(b)x", "\n7.x", "text.", "Text", "é", "2,000 sq ft", "12 Main Street", "NY 10001", '"A" means ', "means ", "City:", "Fax Number", "Trading name"]


def test_guarded_steps(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9)))) for i in range(3000)] + [(3000, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    t = F.col("text")
    plain_strip = lambda c: F.regexp_replace(c, java(r"^\s+|\s+\z"), "")

    plain = plain_strip(t)
    for steps, flags in ((X.NEXT_HEADERS, ""), (X.NEXT_HEADERS_ANY, "i"), (X.NEXT_HEADERS_MORE, ""), (X.NEXT_ROMAN, "i")):
        plain = replaced(plain, steps, flags)
    plain = X.without_marks(plain_strip(plain))
    plain = plain_strip(replaced(replaced(F.regexp_replace(plain, R.BOXES + "+", ""), X.ANSWER_CELLS), X.SPACES, ""))
    plain = plain_strip(replaced(plain_strip(replaced(plain, X.BRACKET_TITLE, "")), X.FOOTERS))
    lines = replaced(replaced(t, N.WHITESPACE, ""), N.SECTION_NUMBERS, "")
    lines = replaced(N.separate_requirements(N.section_markers(lines)), N.BULLETS, "m")
    lines = replaced(replaced(replaced(lines, N.LISTS, "m"), N.LISTS_ANY_CASE, "mi"), N.LETTERED, "m")
    lines = plain_strip(replaced(lines, ((r"\n{4,}", "\n\n\n"),), ""))
    anchored = F.lit(False)
    for p in (*(p.removesuffix("$") + (r"\z" if p.endswith("$") else "") for p in X.FORM_LABELS), *X.DEFINITIONS):
        anchored = anchored | matches(t, p)
    found = df.select(plain_strip(t).alias("a"), N.strip(t).alias("b"), plain.alias("c"), X.cleaned(t).alias("d"), lines.alias("e"), N.preprocess(t, tables=False).alias("f"), anchored.alias("g"), (X.any_of(t, tuple(p.removesuffix("$") + (r"\z" if p.endswith("$") else "") for p in X.FORM_LABELS)) | X.any_of(t, X.DEFINITIONS)).alias("h")).collect()
    for r in found:
        assert (r.a, r.c, r.e, r.g) == (r.b, r.d, r.f, r.h)
    assert sum(r.c != r.a for r in found) > 500 and sum(bool(r.g) for r in found) > 50


def test_titles_of_the_scan(spark):
    text = "1.0 Introduction\n3.0 Scope of Work\n3.1.1 Provide search of all records now.\n4.0 Terms\n4.1.2 Provide export of all records now. Is it there, and will it stay for long?\n9.1.1 Provide import of all records now."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    joined = X.classified(docs, X.all_candidates(docs))
    once = X.classified(docs)
    assert once.columns == joined.columns and sorted(map(tuple, once.collect())) == sorted(map(tuple, joined.collect()))
    assert {r.section_group for r in once.collect()} >= {"3: Scope of Work", "9: Section 9"}
    assert "Join" not in once._jdf.queryExecution().optimizedPlan().toString()


def test_number_changes_of_texts_under_one_id(spark):
    body = "".join(f"{n}.1 Title\n{'word ' * 150}\n{n}.2 More\n{'word ' * 20}\n" for n in (1, 2, 3, 4))
    other = "intro\n" + body.replace("4.", "9.")
    schema = "doc_id long, text string"
    apart = [sorted(map(tuple, X.number_changes(spark.createDataFrame([(1, t)], schema)).collect())) for t in (body, other)]
    assert [r[4] for r in apart[0]] == ["1", "2", "3", "4"] and [r[4] for r in apart[1]][-1] == "9"
    both = X.number_changes(spark.createDataFrame([(1, body), (1, other)], schema))
    assert sorted(map(tuple, both.collect())) == sorted(apart[0] + apart[1])
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()


def test_queries_read_their_texts_once(spark):
    """What several parts of a query read stands in a table: no plan normalises tender texts."""
    from reqloom.plans import accounts, extracts

    for query in (extracts.document_chunks, extracts.chunked_candidates, extracts.range_texts, extracts.profiled_requirements, accounts.extraction_runs):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "orders.parquet" not in plan and "o_orderkey" not in plan
