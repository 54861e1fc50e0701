"""Tokens attributed to sections of a document by offset mapping.

Each document is encoded once, as a whole. Token byte lengths give each token's character span; the spans are joined to
the sections' intervals by binary search. Rule for a token that crosses a boundary: it belongs to the section that
holds most of its characters, and of equal shares to the earlier section. A token that is part of a character spans that
whole character. So the sections' counts add up to the document's.

Null text is an empty text; an empty text has one empty section with no tokens. A null id stays null. Texts are encoded
whole, however long. Repeated rows are counted each on their own, so ties do not matter. Only id and text are read; extra
columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reqloom.llm.common import table, tokenizer_file

RANKS = "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long"
_LOADED: dict[str, tuple] = {}


def encoder(ranks_file: str):
    """(encoding, bytes of each token); kept for the life of the worker."""
    if ranks_file not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(tokenizer_file(ranks_file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _LOADED[ranks_file] = tiktoken.Encoding(ranks_file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _LOADED[ranks_file]


def token_spans(text: str, ranks_file: str = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """Character starts and ends of the tokens of the whole text."""
    encoding, lengths = encoder(ranks_file)
    ids = np.asarray(encoding.encode_ordinary(text), dtype=np.int64)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char_of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char_of_byte[starts], char_of_byte[ends - 1] + 1


def line_sections(text: str) -> np.ndarray:
    """Starts of the lines; a line's newline belongs to it."""
    return np.asarray([0, *(m.end() for m in re.finditer("\n", text))], dtype=np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses an edge. edges: section starts, ascending, plus the end of the last."""
    first = np.searchsorted(edges[1:-1], starts, side="right")
    last = np.searchsorted(edges[1:-1], ends - 1, side="right")
    owner = first.copy()
    for i in np.flatnonzero(first != last):
        lo, hi = first[i], last[i] + 1
        held = np.minimum(edges[lo + 1 : hi + 1], ends[i]) - np.maximum(edges[lo:hi], starts[i])
        owner[i] = lo + int(np.argmax(held))  # argmax: the earliest of equal shares
    return owner, first != last


def _count(batches: Iterator[pa.RecordBatch], ranks_file: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            owners, rows = [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                text = text or ""
                begins = line_sections(text)
                edges = np.append(begins, len(text))
                starts, ends = token_spans(text, ranks_file)
                owner, crossing = attribute(starts, ends, edges)
                n = len(begins)
                owners.append(np.full(n, i))
                rows.append(np.stack([np.arange(n), edges[:-1], edges[1:], np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n), np.full(n, len(starts))]))
            section, *others = np.concatenate(rows, axis=1)
            ids = part.column("doc_id").take(pa.array(np.concatenate(owners)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(section.astype(np.int32)), *map(pa.array, others)], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])


def section_token_counts(docs: DataFrame, ranks_file: str = RANKS) -> DataFrame:
    """One row for each line of each document: its span, its tokens, how many of those cross an edge, the document's tokens."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lambda batches: _count(batches, ranks_file), SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_token_counts(table(spark, sf_dir, "documents"))
