"""Scans by a profile, and the parts of a text under prefixes, against hand-made cases."""

import json

from pyspark.sql import functions as F

from reqloom.operators import asking as A
from reqloom.operators import extraction as X
from reqloom.operators import profile as P


def test_guided_rows_are_classified(spark):
    text = "3.0 Scope\n3.1.1 The vendor must provide search of all records.\n3.1.2 Vendors may send an optional list of offices.\n4.1.1 The vendor must provide export of all records.\n"
    docs = spark.createDataFrame([(1, text, ["numeric"], ["3."]), (2, text, ["numeric"], ["4."]), (3, text, ["bracket"], [])], "doc_id long, text string, families array<string>, prefixes array<string>")
    rows = X.classified(docs, X.candidates(docs, profile=True)).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.label, r.mandatory) for r in rows] == [(1, "3.1.1", True), (1, "3.1.2", False), (2, "4.1.1", True)]
    assert rows[0].section_group == "3: Scope"


def test_prefix_sections(spark):
    text = "1.1 Intro text\n3.1 Search text\nmore of it\n3.1.2 Details\n3.2 Export text\n5.1 Rest"
    under = lambda *prefixes: spark.createDataFrame([(text,)], "text string").select(P.prefix_sections(F.col("text"), list(prefixes))).first()[0]
    assert under() == text and under("9.") == text
    assert "Search text" in under("3.1") and "more of it" not in under("3.1")  # a part ends with its line, as the rule's line mode has it
    assert "3.1.2 Details" in under("3.1") and "Export" not in under("3.1") and "Rest" not in under("3.1", "3.2") and "Export" in under("3.1", "3.2")
    for odd in ("A(", "+", "[3"):  # signs of patterns stand for themselves
        assert under(odd) == text


def test_profiles_are_held_to_their_types(spark):
    whole = {"primaryPatternFamily": "letter", "secondaryPatternFamilies": ["numeric", "letter", "odd", 3], "requirementSectionPrefixes": ["3.", "", 4], "confidence": 250.7,
             "skipSections": [{"title": "Glossary", "reason": "definitions"}, {"title": "Forms", "reason": "because"}, {"title": " "}, {"reason": "examples"}, "Annex"],
             "metadata": {"hasTableOfContents": True, "hasAppendices": "yes", "estimatedRequirementCount": -4, "documentType": "letter"}}
    said = {"whole": whole, "family": whole | {"primaryPatternFamily": "odd"}, "bare": {"primaryPatternFamily": "roman", "metadata": {"x": 1}}, "none": {"metadata": {"x": 1}}, "facts": {"primaryPatternFamily": "roman", "metadata": {}}, "list": [1]}

    def ask(prompt):
        if prompt == "fails":
            raise TimeoutError("timed out")
        return json.dumps(said[prompt]) if prompt in said else "no json"

    names = [*said, "fails", "prose", "", "  ", None]
    docs = spark.createDataFrame([(i, n, "extra") for i, n in enumerate(names)] * 2, "doc_id long, text string, confidence string")
    for tasks in (1, 5):
        out = A.profiles(docs, ask, F.col("text"), tasks=tasks, wait=lambda s: None)
        rows = [tuple(r) for r in out.orderBy("doc_id").collect()]
        assert rows[::2] == rows[1::2]
        first, family, bare, *rest = rows[::2]
        assert first == (0, "letter", ["letter", "numeric"], ["3."], [("Glossary", "definitions"), ("Forms", None)], True, None, None, 0, "other", 100)
        assert family[1:3] == ("numeric", ["numeric", "letter"]) and bare[1:] == ("roman", ["roman"], [], [], None, None, None, None, "other", None)
        assert [r[0] for r in rest] == list(range(3, 11)) and all(v is None for r in rest for v in r[1:])
    assert A.profiles(docs.limit(0), ask, F.col("text")).count() == 0


def test_texts_are_scanned_by_their_own_profiles(spark):
    text = "3.0 Scope\n3.1.1 The vendor must provide search of all records.\n4.0 Forms\n4.1.1 The vendor must sign this form.\n"
    docs = spark.createDataFrame([(i, text, "k") for i in range(4)], "doc_id long, text string, kind string")
    made = spark.createDataFrame(
        [(0, "numeric", ["numeric"], ["3."], [], 90), (1, "numeric", ["numeric"], [], [("Forms", "examples")], 90), (2, "bracket", ["bracket"], [], [], 20), (3, None, None, None, None, None)],
        "doc_id long, primary string, families array<string>, prefixes array<string>, skipped array<struct<title:string,reason:string>>, confidence int",
    )
    ready = P.guided(docs, made, least=50)
    rows = {r.doc_id: r for r in ready.collect()}
    assert ready.columns == ["doc_id", "text", "kind", "families", "prefixes"] and len(rows) == 4
    assert rows[0].text == text and "SKIPPED" in rows[1].text and "Forms" not in rows[1].text and rows[2].text == rows[3].text == text
    assert rows[2].families is None and rows[3].prefixes is None
    labels = lambda docs, **k: {(r.doc_id, r.label) for r in X.candidates(docs, **k).collect()}
    found = labels(ready, profile=True)
    assert (0, "3.1.1") in found and (0, "4.1.1") not in found and (1, "3.1.1") in found
    assert {x for x in found if x[0] > 1} == {x for x in labels(docs) if x[0] > 1}


def test_prompts_show_the_contents(spark):
    listed = "TABLE OF CONTENTS\n" + "\n".join(f"Part {i} ........ {i}" for i in range(12))
    got = [r[0] for r in spark.createDataFrame([(listed + "\n1. Scope of all",), ("plain",), ("",), (None,)], "text string").select(P.prompt(F.col("text"))).collect()]
    assert "--- TABLE OF CONTENTS ---" in got[0] and got[1:] == ["plain", "", None]
