"""DOCX files as structured text: the paragraphs, lists and tables of the main part as HTML, which sources/html reads.

A file is a zip archive of XML parts; the libraries of Python's own distribution open both in an Arrow function, file by file.
What is too large, no archive, or without a main part gives a null text and says why in defect.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.functions.text import preprocess
from reqloom.sources.html import MOST_BYTES, html_text

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAIN = "word/document.xml"
MOST_XML = 256 << 20  # bytes of an unpacked main part


def _said(node: ElementTree.Element) -> str:
    """Text of runs, with tabs and line breaks."""
    marks = {f"{WORD}t": lambda e: e.text or "", f"{WORD}tab": lambda e: "\t", f"{WORD}br": lambda e: "\n"}
    return "".join(marks[e.tag](e) for e in node.iter() if e.tag in marks)


def _paragraph(p: ElementTree.Element) -> tuple[str, str]:
    """(tag, HTML) of a paragraph: a heading by its style, a list item by its numbering, or plain."""
    style = p.find(f"{WORD}pPr/{WORD}pStyle")
    level = re.fullmatch(r"(?i)heading\s*([1-6])", style.get(f"{WORD}val", "") if style is not None else "")
    tag = f"h{level[1]}" if level else "li" if p.find(f"{WORD}pPr/{WORD}numPr") is not None else "p"
    return tag, f"<{tag}>{escape(_said(p))}</{tag}>"


def _table(table: ElementTree.Element) -> str:
    cells = lambda row: "".join(f"<td>{escape(chr(10).join(_said(p) for p in c.iter(f'{WORD}p')))}</td>" for c in row.findall(f"{WORD}tc"))
    return "<table>" + "".join(f"<tr>{cells(r)}</tr>" for r in table.findall(f"{WORD}tr")) + "</table>"


def html_of(content: bytes) -> tuple[str | None, str | None]:
    """(HTML, None), or (None, why not)."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as parts:
            if parts.getinfo(MAIN).file_size > MOST_XML:
                return None, "main part is too large"
            body = ElementTree.fromstring(parts.read(MAIN)).find(f"{WORD}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zipfile.zlib.error, EOFError) as e:
        return None, f"no document: {type(e).__name__}"
    out, items = [], []
    for node in body if body is not None else ():
        tag, said = _paragraph(node) if node.tag == f"{WORD}p" else ("table", _table(node)) if node.tag == f"{WORD}tbl" else ("", "")
        if items and tag != "li":
            out.append(f"<ul>{''.join(items)}</ul>")
            items = []
        (items if tag == "li" else out).append(said)
    return f"<body>{''.join(out)}{f'<ul>{chr(10).join(items)}</ul>' if items else ''}</body>", None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [html_of(c) for c in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("path"), pa.array([h for h, _ in found], pa.string()), pa.array([d for _, d in found], pa.string())], names=["page_id", "path", "html", "defect"])


def docx_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text (normalised), defect of each *.docx file of a folder. Files over the upload limit are told by length and never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    read = files.where(F.col("length") <= MOST_BYTES).select(F.xxhash64("path").alias("page_id"), "path", "content").mapInArrow(_read, "page_id long, path string, html string, defect string")
    texts = html_text(read.where("defect is null")).select("page_id", preprocess(F.col("text"), tables=False).alias("text"))
    out = read.select("page_id", "path", "defect").join(texts, "page_id", "left").select("path", "text", "defect")
    return out.unionByName(files.where(F.col("length") > MOST_BYTES).select("path", F.lit(None).cast("string").alias("text"), F.lit("too large").alias("defect")))
