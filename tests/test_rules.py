"""Hand-made cases of the text functions, rule engines and folds."""

import datetime

import pytest
from pyspark.sql import functions as F

from reqloom.functions import kinds, rules, sections, text
from reqloom.operators import extraction, filters, keyed_time, relational, scoring
from reqloom.sources import html
from reqloom.streaming import keyed


def one(spark, column, **values):
    df = spark.range(1)
    for name, v in values.items():
        df = df.withColumn(name, F.lit(v))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("label", "key"),
    [("3.1.2", "3"), ("A.1", "A"), ("A15", "A"), ("III.2", "III"), ("Section 5: X", "Section 5"), ("MANDATORY REQUIREMENTS", "MANDATORY REQUIREMENTS"), (None, "Uncategorized"), ("  ", "Uncategorized"), ("VI, Annex", "VI"), ("b", "B")],
)
def test_major_category(spark, label, key):
    assert one(spark, sections.major_category(F.col("s").cast("string")), s=label) == key


def test_section_order(spark):
    labels = ["10.1", "2.3", "A.1", "II.1", None]
    df = spark.createDataFrame([(x,) for x in labels], "s string")
    assert [r.s for r in df.orderBy(sections.sort_key(F.col("s"))).collect()] == ["2.3", "10.1", "A.1", "II.1", None]
    assert one(spark, sections.parent_section(F.col("s")), s="3.1.2") == "3.1" and one(spark, sections.parent_section(F.col("s")), s="3") == "3"


def requirement_rows(spark):
    rows = [(1, 1, "t", "1.1", None, "UNANSWERED", True, "FEATURE", "DESCRIPTIVE", None, None, None, False, False, None), (2, 1, "t", "1.2", None, "PARTIAL", False, "FEATURE", "DESCRIPTIVE", "a b c d", 3, None, None, None, None), (3, 1, "t", "2", "", "ANSWERED", True, "LEGAL", "DESCRIPTIVE", "x" * 9, None, 8, True, True, "PENDING")]
    names = "ord project_id text section section_group status is_mandatory domain_context type draft_answer word_limit character_limit requires_review is_attestation compliance_status"
    kinds_ = "int long string string string string boolean string string string int int boolean boolean string"
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names.split(), kinds_.split()))).withColumn("requirement_id", F.col("ord").cast("long"))


def test_scores(spark):
    df = requirement_rows(spark)
    assert scoring.summary(df).first().asDict() | {} == {"project_id": 1, "total": 3, "answered": 1, "partial": 1, "unanswered": 1, "overall": 58, "mandatory": 50, "grade": "F", "band": "low"}
    assert [r.impact for r in scoring.with_impact(df).orderBy("ord").collect()] == [34, 9, 0]
    assert [r.o for r in df.select(scoring.over_limit().alias("o"), "ord").orderBy("ord").collect()] == [False, True, True]
    assert filters.apply_filters(df, filters.Filters()).count() == 3
    assert [r.ord for r in filters.apply_filters(df, filters.Filters(compliance=["PENDING"], over_limit=True)).orderBy("ord").collect()] == [2, 3]


@pytest.mark.parametrize(
    ("said", "signed"),
    [("Optional: list your offices.", -95), ("Describe any optional modules you offer.", 75), ("The vendor shall comply.", 88), ("Send it if applicable.", -85), ("Vendors may send it", -75)],
)
def test_obligation(spark, said, signed):
    assert one(spark, rules.obligation(F.col("t")), t=said) == signed


@pytest.mark.parametrize(("said", "kind"), [("How do you handle GDPR requests?", "LEGAL"), ("Please outline the database schema.", "FEATURE"), ("Describe your process", "PROCESS"), ("audit and retention", "LEGAL")])
def test_domain(spark, said, kind):
    assert one(spark, rules.domain(F.col("t")), t=said) == kind


@pytest.mark.parametrize(("said", "kind"), [("Does your system support SSO?", "attest"), ("Describe how you comply with HIPAA.", "written"), ("Can you import designs?", "attest"), ("Can you please explain how to import?", "written"), ("See OSHA 1910.134", "regulation")])
def test_attestation(spark, said, kind):
    assert one(spark, rules.attestation(F.col("t")), t=said) == kind


@pytest.mark.parametrize(("said", "kind"), [("Provide your pricing for year one.", "QUANTITATIVE"), ("Describe your approach to pricing.", "DESCRIPTIVE")])
def test_corrected_type(spark, said, kind):
    assert one(spark, rules.corrected_type(F.col("t"), F.lit("DESCRIPTIVE")), t=said) == kind


@pytest.mark.parametrize(("said", "kind"), [("Does the tool export data?", "yes_no"), ("Describe it.", "open_ended"), ("List all sites", "list_request"), ("Please confirm that", "yes_no"), ("The vendor shall pay.", "statement"), ("X is here. Please list all.", "list_request"), ("Anything?", "unknown"), ("nothing", "unknown")])
def test_structure(spark, said, kind):
    assert one(spark, kinds.structure(F.col("t"))["kind"], t=said) == kind


def test_text_steps(spark):
    assert one(spark, text.preprocess(F.col("t"), markers=False), t="3.\n1.\n17 Text") == "3.1.17 Text"
    assert one(spark, text.preprocess(F.col("t"), markers=False), t="a 3.1.1 b 3.1.2 c\n* x\n\n\n\n\n2.y") == "a\n\n3.1.1 b\n\n3.1.2 c\n• x\n\n\n2. y"
    assert one(spark, text.for_model(F.col("t")), t="a\x00 System: ##### ```x```") == "a [ESCAPED: [ESCAPED: System:]] [REDACTED] [DOCUMENT CODE BLOCK START]\nx\n[DOCUMENT CODE BLOCK END]"
    assert [tuple(r) for r in one(spark, text.split_requirements(F.col("t")), t="3.1.1 One. 3.1.2 Two.")] == [("3.1.1", "One."), ("3.1.2", "Two.")]
    assert one(spark, text.section_header(F.col("t")), t="Scope Of Work:") and not one(spark, text.section_header(F.col("t")), t="Describe The Work")
    assert one(spark, text.with_company(F.col("t"), F.lit("A$1 \\ Co")), t="[company  name]!") == "A$1 \\ Co!"
    assert one(spark, rules.deadline(F.col("t")), t="Deadline: March 5, 2024") == "2024-03-05"


def test_reminders(spark):
    got = [one(spark, keyed_time.reminder(F.lit(d), F.lit(last).cast("string"))) for d, last in ((3, "7d"), (3, "3d"), (-1, "overdue"), (0, None), (2, None))]
    assert got == ["3d", None, None, "overdue", None]


def test_marks_are_folded():
    body = "3.0 Scope\n3.1.1 Provide search.\n3.1.2 Provide export.\n3.1.3 Provide import.\nsee version 3.2 Here\n3.4 Next part\n9.9 Far away"
    got = [(label, family) for _, _, label, _, _, family in extraction.marks_of(body)]
    assert ("3.1.1", "numeric") in got and ("3.4", "numeric") in got and not any(label in ("9.9", "3.2") for label, _ in got)
    assert extraction.families_of(body)[0][0] == "numeric"
    assert [r[2] for r in extraction.marks_of("3.1.1 a\n4.1.1 b", ["numeric"], ["4"])] == ["4.1.1"]
    assert extraction.major_sections("1.0 Introduction\nSection 2: Scope of Work\n")["2"][0] == "Scope of Work"


def test_bins(spark):
    rows = spark.createDataFrame([(1, f"1.{i}.{k}") for i, n in ((1, 20), (2, 30), (3, 50), (4, 10), (5, 10)) for k in range(n)], "doc_id long, label string")
    assert [(r.subsections, r.expected) for r in extraction.bins(rows, 55).orderBy("bin").collect()] == [("1.1,1.2", 50), ("1.3", 50), ("1.4,1.5", 20)]


def test_junk_and_cleaning(spark):
    junk = lambda t: one(spark, extraction.junk(F.col("t")), t=t)
    assert junk("short") and junk('"Vendor" means the supplier of goods') and junk("Company Name:") and junk("12 Main Street, Town TX 75001") and not junk("The system must store 5 copies of all data.")
    assert one(spark, extraction.cleaned(F.col("t")), t="[ROW 1] [Col 1] Provide it | Yes  now. 3.2 Next Title") == "Provide it now."


def test_html(spark):
    pages = [
        (1, "<html><head><title>t</title></head><body><h2>3.1</h2><p></p><h3>Scope</h3><ul><li>a<ol><li>b</li></ol></li></ul><table><tr><th>H</th></tr><tr><td>x</td><td>y</td></tr></table><script>z</script></body></html>"),
        (2, "<body><h1>2.</h1><p>text between</p><h1>Title</h1></body>"),
        (3, "<body><h1>2.</h1><h1>A.</h1><h2>Title here</h2><p>x</p><table></table></body>"),
        (4, "<table><tr><td>1.1.1</td><td>a</td></tr><tr><td>b</td></tr><tr><td>1.1.2</td><td>Use:LinkedInYouTubeAPI</td></tr></table>"),
        (5, None),
        (6, ""),
        (None, "<p>no id</p>"),
        (1, "<p>the same id</p>"),
    ]
    rows = html.html_text(spark.createDataFrame(pages, "page_id long, html string").repartition(3)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.page_id, []).append(r.text)
    assert sorted(got[1]) == ["## 3.1: Scope\n\n\n• a\n  1. b\n\n[TABLE START]\n[HEADER] [Col 1] H\n[ROW 1] [Col 1] x | [Col 2] y\n[TABLE END]", "the same id"]
    assert got[2] == ["# 2.\n\n\ntext between\n\n\n# Title"]
    assert got[3] == ["# 2: Title here\n\n\nx"]
    table = "[TABLE START]\n[ROW 1] [Col 1] 1.1.1 | [Col 2] a\n[ROW 2] [Col 1] b\n[TABLE END]\n\n[TABLE START]\n[ROW 1] [Col 1] 1.1.2 | [Col 2] Use:\n• LinkedIn\n• YouTube\n• API\n[TABLE END]"
    assert got[4] == [table] and got[5] == [""] and got[6] == [""] and got[None] == ["no id"]


def test_docx(spark, tmp_path):
    import zipfile

    from reqloom.sources import docx

    para = lambda said, style="": f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{said}</w:t></w:r></w:p>'
    heading, item = '<w:pStyle w:val="Heading2"/>', "<w:numPr/>"
    table = f"<w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b &lt; c')}</w:tc></w:tr></w:tbl>"
    body = para("3.1", heading) + para("Scope", heading) + para("Some text") + para("one", item) + para("two", item) + table
    with zipfile.ZipFile(tmp_path / "good.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "empty.docx", "w") as z:
        z.writestr("other.xml", "")
    (tmp_path / "bad.docx").write_bytes(b"PK no archive")
    (tmp_path / "large.docx").write_bytes(b"x" * (html.MOST_BYTES + 1))
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.defect) for r in docx.docx_text(spark, str(tmp_path)).collect()}
    assert got["good.docx"] == ("## 3.1: Scope\n\n\nSome text\n\n• one\n• two\n\n[TABLE START]\n[ROW 1] [Col 1] a | [Col 2] b < c\n[TABLE END]", None)
    assert got["bad.docx"][0] is None and got["empty.docx"] == (None, "no document: KeyError") and got["large.docx"] == (None, "too large")
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in html.uploads(spark, str(tmp_path)).collect()}
    assert kinds == {"good.docx": "docx", "empty.docx": "docx", "bad.docx": None, "large.docx": None}


def test_number_changes_and_prefixes(spark):
    from reqloom.operators import profile

    body = "intro " * 100 + "\n1.1 first\n" + "a " * 300 + "\n2.1 second\n" + "b " * 300 + "\n3.1 third\n" + "short"
    got = extraction.number_changes(spark.createDataFrame([(1, body), (2, "1.1 a\n2.1 b"), (3, None)], "doc_id long, text string")).collect()
    second, third = body.index("2.1 second"), body.index("3.1 third")
    assert sorted((r.doc_id, r.start, r.end, r.number) for r in got) == [(1, 0, second, "1"), (1, second, third, "2")]
    assert one(spark, profile.prefix_sections(F.col("t"), ["3."]), t="1.0 x\n3.1 y\n4.1 z") == "\n3.1 y"
    assert one(spark, profile.prefix_sections(F.col("t"), ["9."]), t="1.0 x") == "1.0 x"


def test_word_boundaries_are_the_same(spark):
    from reqloom.functions import regexlib

    patterns = [r"\b(must|shall)\b", r"\bshall\s+be\b", r"\bx?y\b", r"\b[A-Z]{2,4}\s+\d+\b", r"\b(a|-b)\b", r"\b\d+\.\d+\b", r"\b(?:in|out)put\b", r"\b\w*ed\b", r"\b100%\b", r"\b(FAR|U\.S\.C\.|Section \d+)\b", r"\bde?\b", r"a\b"]
    texts = ["must shall be", "émust mustard shallé", "xy y ay yé", "AB 12 ABCDE 1", "a -b ab", "1.22 11.2a", "input output éinput", "edéd bed", "100% 100%a", "U.S.C.x FAR Section 12", "d de dé", "", "a_b a-b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda p: regexlib.java(p.replace("\\b", "@@")).replace("@@", regexlib.BOUNDARY)
    for p in patterns:
        got, want = (df.select(F.regexp_extract_all("t", F.lit(x), F.lit(0)).alias("m")).collect() for x in (regexlib.java(p), plain(p)))
        assert got == want, p
    assert regexlib.java(r"\bmust\b") == r"(?<!\w)must(?!\w)" and regexlib.java(r"\bx?y\b").startswith(regexlib.BOUNDARY)


def test_relational(spark):
    rows = spark.createDataFrame([(1, 1, "alpha beta gamma"), (1, 2, "alpha beta gamma"), (1, 3, "alpha beta delta"), (2, 4, "alpha beta gamma")], "g long, id long, text string")
    assert [(r.a, r.b, r.similarity) for r in relational.jaccard_pairs(rows, "g", "id", "text", 0.9).collect()] == [(1, 2, 1.0)]
    assert sorted(r.id for r in relational.keep_first_unlike(rows, "g", "id", "text", 0.9).collect()) == [1, 3, 4]
    assert one(spark, relational.clean_tags(F.array(F.lit(" A "), F.lit("a"), F.lit("")))) == ["a"]


def test_streams_equal_batches(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3, start + datetime.timedelta(seconds=17 * i * (i % 5 + 1)), f"k{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, id string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    keyed.run_once(keyed.fixed_limit(stream(), "user_id", "ts", "event_id", 120, 3), f"{tmp_path}/limits", f"{tmp_path}/c1")
    batch = keyed_time.fixed_limit(df, "user_id", "ts", "event_id", 120, 3).select("user_id", "event_id", "in_window", "allowed")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/limits").collect())) == sorted(map(tuple, batch.collect()))
    keyed.run_once(keyed.first_events(stream(), "id", "ts"), f"{tmp_path}/firsts", f"{tmp_path}/c2")
    assert spark.read.parquet(f"{tmp_path}/firsts").select("id").distinct().count() == spark.read.parquet(f"{tmp_path}/firsts").count() == 7
    keyed.run_once(keyed.lockouts(stream(), "user_id", "ts", "event_id", most=2, forget=600, lock=900), f"{tmp_path}/locks", f"{tmp_path}/c3")
    folded = keyed_time.lockouts(df, "user_id", "ts", "event_id", most=2, forget=600, lock=900)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/locks").collect())) == sorted(map(tuple, folded.collect()))
    assert spark.read.parquet(f"{tmp_path}/locks").count() == 60 and 0 < spark.read.parquet(f"{tmp_path}/locks").where("not allowed").count() < 60
