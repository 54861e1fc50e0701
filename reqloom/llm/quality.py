"""Quality rules: base rules over words, and tokeniser fertility against bands per language or script.

Fertility of a document under a public vocabulary with byte fallback: characters of its words per token, the share of
tokens that are byte fallbacks, and the Shannon entropy of its token distribution. A document is rejected if one of the
three leaves the band of its language; for an unknown or null language the band of its commonest script is taken.
Entropy grows with length, so its floor is a line over log2(tokens); so is that of characters a token, as one long key
weighs more in a short document; one character of four bytes more than the share is always let through. Every length is
judged. Bands were set once below what clean text shows, to reject only outliers: under 64 tokens, clean texts with keys
and addresses go down to 1.12 characters a token, where noise of consonants has 1.25 to 1.6, so short noise stays unless it
falls apart into single characters, bytes or repeats.

Null and empty texts have no words and fail the base rules. Each row is judged on its own, so ties and repeated rows do
not matter; empty tables give empty results; extra columns travel along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqloom.llm.common import WHITE, table, tokenizer_file

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
ONE_CHARACTER = 4  # byte fallbacks of one character at most
#: Of each language or script: floor of characters a token as (log2 tokens, characters) points, most characters a token, most byte-fallback share, entropy floor as (log2 tokens, bits) points.
BANDS = {
    "en": (((3, 0.95), (6, 1.1), (8, 1.55)), 5.5, 0.20, ((3, 2.0), (4, 2.8), (5, 3.3), (6, 3.9), (7, 5.2), (8, 5.75), (9, 6.0), (10, 6.2), (11, 6.35), (12, 6.45), (13, 6.5))),
    "fr": (((3, 0.95), (6, 1.1), (8, 1.45)), 5.0, 0.20, ((3, 2.0), (4, 2.8), (5, 3.3), (6, 3.9), (7, 5.2), (8, 5.65), (9, 5.9), (10, 6.1), (11, 6.25), (12, 6.3), (13, 6.35))),
    "de": (((3, 0.95), (6, 1.1), (8, 1.45)), 5.0, 0.20, ((3, 2.0), (4, 2.8), (5, 3.3), (6, 3.9), (7, 5.2), (8, 5.65), (9, 5.9), (10, 6.1), (11, 6.25), (12, 6.3), (13, 6.35))),
    "es": (((3, 0.95), (6, 1.1), (8, 1.45)), 5.0, 0.20, ((3, 2.0), (4, 2.8), (5, 3.3), (6, 3.9), (7, 5.2), (8, 5.6), (9, 5.9), (10, 6.15), (11, 6.3), (12, 6.35), (13, 6.4))),
    "LATIN": (((3, 0.95), (6, 1.1), (8, 1.3)), 6.0, 0.25, ((3, 2.0), (4, 2.8), (5, 3.2), (6, 3.5), (9, 5.2), (13, 5.8))),
    "GREEK": (((6, 0.8),), 4.0, 0.30, ((3, 1.8), (6, 3.0), (9, 4.2), (13, 4.8))),
    "CYRILLIC": (((6, 1.0),), 5.0, 0.30, ((3, 2.0), (4, 2.8), (5, 3.2), (6, 3.5), (9, 5.0), (13, 5.6))),
    "OTHER": (((6, 0.2),), 6.0, 0.60, ((3, 1.5), (6, 2.5), (13, 3.5))),
}
SCRIPTS = (("LATIN", re.compile(r"[A-Za-zÀ-ɏ]")), ("GREEK", re.compile(r"[Ͱ-Ͽ]")), ("CYRILLIC", re.compile(r"[Ѐ-ӿ]")))
MEASURES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType())]
    + [T.StructField(c, T.DoubleType()) for c in ("chars_per_token", "byte_share", "token_entropy")]
    + [T.StructField("band", T.StringType()), T.StructField("kept", T.BooleanType())]
)
_ARROW = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.string(), pa.bool_()]
_LOADED: dict[str, tuple] = {}


def vocabulary(model_file: str):
    """(processor, whether each id is a byte fallback); kept for the life of the worker."""
    if model_file not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(model_file))
        _LOADED[model_file] = model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return _LOADED[model_file]


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of so many words which the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.uint64, count=len(words))
    key = np.zeros(n, dtype=np.uint64)
    for i in range(width):  # words are numbered, so the windows' keys collide with probability n*n / 2**64
        key = (key ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    _, group, count = np.unique(key, return_inverse=True, return_counts=True)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    twice = np.flatnonzero(count[group] > 1)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + width, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def base_measures(text: str) -> tuple[int, int, int, int, int, bool]:
    words = text.encode().split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    n, repeats = len(words), repeated_words(words)
    return n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, n < 10 or 100 * repeats > 20 * n


def script_of(text: str) -> str:
    counts = [(len(p.findall(text)), name) for name, p in SCRIPTS]
    most, name = max(counts, key=lambda x: x[0])
    return name if 2 * most >= len(text.translate(str.maketrans("", "", WHITE))) else "OTHER"


def fertility(ids: np.ndarray, word_chars: int, is_byte: np.ndarray) -> tuple[float, float, float]:
    """Characters a token, byte-fallback share, entropy in bits; zeros for no tokens."""
    if not len(ids):
        return 0.0, 0.0, 0.0
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return word_chars / len(ids), float(is_byte[ids].mean()), float(-(share * np.log2(share)).sum())


def verdict(n_tokens: int, figures: tuple[float, float, float], band: tuple) -> bool:
    low, high, most_bytes, floor = band
    if not n_tokens:
        return False
    least = lambda points: np.interp(np.log2(n_tokens), *zip(*points, strict=True))
    return bool(least(low) <= figures[0] <= high and figures[1] <= most_bytes + ONE_CHARACTER / n_tokens and figures[2] >= least(floor))


def _measure(batches: Iterator[pa.RecordBatch], model_file: str, bands: dict) -> Iterator[pa.RecordBatch]:
    model, is_byte = vocabulary(model_file)
    languages = bands.keys() - {"OTHER", *(name for name, _ in SCRIPTS)}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [x or "" for x in part.column("__text").to_pylist()]
            rows = []
            for text, lang, ids in zip(texts, part.column("__lang").to_pylist(), model.encode(texts, out_type=int, num_threads=1), strict=True):
                base, ids = base_measures(text), np.asarray(ids, dtype=np.int64)
                band = lang if lang in languages else script_of(text)
                figures = fertility(ids, base[1], is_byte)
                rows.append((*base, *figures, band, bool(not base[-1] and verdict(len(ids), figures, bands[band]))))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], *made], names=[*part.schema.names[:-2], *MEASURES.names])


def measure_quality(df: DataFrame, text: str = "text", lang: str = "lang", model_file: str = VOCABULARY, bands: dict = BANDS, carry: list[str] | None = None) -> DataFrame:
    """carry (all columns, unless given) with the measures; carried columns named like a measure give way to it."""
    carry = [c for c in (df.columns if carry is None else carry) if c not in MEASURES.names]
    given = df.select(*carry, F.col(text).alias("__text"), F.col(lang).cast("string").alias("__lang"))
    schema = T.StructType([*[given.schema[c] for c in carry], *MEASURES.fields])
    return given.mapInArrow(lambda batches: _measure(batches, model_file, bands), schema)


def quality_filter(df: DataFrame) -> DataFrame:
    """The rows of df that pass, with its columns as they were."""
    docs = df.withColumn("__row", F.struct(*df.columns))
    return measure_quality(docs, carry=["__row"]).where("kept").select("__row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return measure_quality(docs, carry=["doc_id"]).select("doc_id", *MEASURES.names)
