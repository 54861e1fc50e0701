"""Secret scan in DataFrame functions only.

Three pattern kinds (assign, access, hex) are found leftmost and without overlap in whole texts. The method adds a fourth,
entropy: candidate strings are runs of key characters; over each slides a window whose Shannon entropy is kept by
incremental counts, in whole numbers (n*log2(n) scaled by 2**20), so a result never depends on rounding. A candidate's
character class sets window and threshold; the span runs from the first window above the threshold to the end of the last.
Allow-list patterns suppress candidates (added spans only; the pattern kinds always stay).

Spark's match functions give no offsets: they are summed from the lengths of the matches and of the pieces between them,
in blocks, so a text with very many matches costs no quadratic time.

Null and empty texts have no spans, and an empty table gives an empty one. Very long texts are scanned whole, in time that
grows with their length. Ties and repeated rows: each row is scanned on its own. Extra columns travel along, whatever their
names; columns called base_spans or all_spans give way to the results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm.common import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the shortest that the rule keeps has 16 characters; a shorter run never holds a longer match
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Of each character class (each candidate is in exactly one): name, full match, alphabet, window, bits above which a window is reported.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 20, 3.0),
    ("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.7),
    ("lower", r"^(?=.*[0-9])(?=.*[a-z])(?![0-9a-f]+$)[a-z0-9+/_=-]+$", "abcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.6),
    ("upper", r"^(?=.*[0-9])(?=.*[A-Z])(?![0-9A-F]+$)[A-Z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", 20, 3.6),
    ("letters", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 20, 3.9),
    ("onecase", r"^(?=.*[A-Za-z])([a-z+/_=-]+|[A-Z+/_=-]+)$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 24, 3.8),
    ("digits", r"^[0-9+/_=-]+$", "0123456789+/_=-", 20, 3.1),
)
_PART = r"(?:[A-Za-z]?[a-z]++[0-9]{0,4}+|[A-Z]++[0-9]{0,4}+|[0-9]{1,4}+)"
_LOWER = r"(?:(?=[a-z]{0,14}[aeiouy])[a-z]{2,15}+|a)"
_CAPITAL = r"(?:[AEIOUY][a-z]{1,14}+|[A-Z](?=[a-z]{0,13}[aeiouy])[a-z]{1,14}+)"
_WORDS = rf"(?:{_LOWER}?+{_CAPITAL}++|{_LOWER}|[0-9]{{1,8}}+)"
_NAME = rf"{_PART}(?:[_-]{_PART})*+"
#: Candidates that match one of these are no secrets: UUIDs, placeholders of 64 characters or less, and what consists of nothing but runs of the alphabet or of digits, of one character, of a path of three word-like parts or more, or of words (with a vowel, of 15 letters at most) and numbers, the words run together by capitals or all parted by single signs.
ALLOW = (
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"(?i)^(?=.*(?:example|placeholder|changeme|sample|dummy|your_)).{1,64}$",
    r"(?i)^(?:abcdef(?:gh(?:ij(?:klmnop(?:qrstuvwxyz)?)?)?)?|0|1234567(?:89?)?|[+/_=-])++$",
    r"^(.)\1{7,}$",
    rf"^/*+(?:{_NAME}/){{3,}}+(?:{_NAME})?$",
    rf"^[+/_-]?+{_WORDS}(?:[/_-]{_WORDS})*+[/_=-]?+$",
)
SCALE = 1 << 20
BLOCK = 512


def weight_table(window: int) -> list[int]:
    """n*log2(n) for n from 0 to window, scaled."""
    return [0, *(round(n * math.log2(n) * SCALE) for n in range(1, window + 1))]


def limit(window: int, bits: float) -> int:
    """A window's sum of weights is at most this where its entropy is at least bits."""
    return math.floor(window * (math.log2(window) - bits) * SCALE)


def _running(lengths: Column) -> Column:
    """struct(total, out): exclusive prefix sums of a short array."""
    zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, zero, lambda a, x: F.struct((a["total"] + x).alias("total"), F.concat(a["out"], F.array(a["total"])).alias("out")))


def prefix_sums(lengths: Column) -> Column:
    """Exclusive prefix sums of an array<int>, block by block."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: _running(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    offsets = _running(F.transform(blocks, lambda b: b["total"]))["out"]
    flat = F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(b["out"], lambda v: v + o)))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(flat)



def _window_scan(window: int, size: int, most: int) -> str:
    """SQL over x.codes: struct(n, sum, first, last). A step judges the window before it, then adds a character and drops one.

    n: counts of the characters in the window, sum: their weights; first, last: ends of the first and the last window
    whose sum is at most most (0: none).
    """
    weights = "array(" + ", ".join(f"{w}L" for w in weight_table(window)) + ")"
    new, old = "get(x.codes, i - 1)", f"get(x.codes, i - 1 - {window})"
    gain = f"coalesce(get({weights}, get(a.n, {new}) + 1) - get({weights}, get(a.n, {new})), 0L)"
    loss = f"coalesce(get({weights}, get(a.n, {old})) - get({weights}, get(a.n, {old}) - 1), 0L)"
    found = f"i > {window} and a.sum <= {most}L"
    return f"""aggregate(sequence(1, size(x.codes) + 1), named_struct('n', array_repeat(0, {size}), 'sum', 0L, 'first', 0, 'last', 0),
        (a, i) -> named_struct(
            'n', transform(a.n, (v, k) -> v + if(k = {new}, 1, 0) - if(k = {old}, 1, 0)),
            'sum', a.sum + if({new} <=> {old}, 0L, {gain} - {loss}),
            'first', if(a.first = 0 and {found}, i - 1, a.first),
            'last', if({found}, i - 1, a.last)))"""


def _literal(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern + '"'


def _matches(df: DataFrame, text: str, kind: str, pattern: str, may: Column, group: int = 0) -> DataFrame:
    """Adds __<kind>: array<struct<start, ord, kind, end, said>>; said is the given group. may: false where nothing can match."""
    none = F.array().cast("array<string>")
    whole, pieces, said = f"__{kind}_whole", f"__{kind}_pieces", f"__{kind}_said"
    df = df.withColumn(whole, F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size(whole) > 0
    df = df.withColumn(pieces, F.when(some, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn(said, F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else F.col(whole))
    df = df.withColumn(f"__{kind}_at", prefix_sums(F.zip_with(F.slice(pieces, 1, F.size(whole)), whole, lambda p, m: F.length(p) + F.length(m))))
    spans = f"""transform({whole}, (m, i) -> named_struct(
        'start', get(__{kind}_at, i) + length(get({pieces}, i)), 'ord', {KINDS.index(kind)}, 'kind', '{kind}',
        'end', get(__{kind}_at, i) + length(get({pieces}, i)) + length(m), 'said', get({said}, i)))"""
    return df.withColumn(f"__{kind}", F.expr(spans)).drop(whole, pieces, said, f"__{kind}_at")


def _entropy(df: DataFrame, classes: tuple, allow: tuple) -> DataFrame:
    """Turns the candidates in __entropy into the spans that the windows give."""
    allowed = " or ".join(f"x.said rlike {_literal(p)}" for p in allow) or "false"
    df = df.withColumn("__entropy", F.expr(f"filter(__entropy, x -> not ({allowed}))"))
    parts = []
    for name, full, alphabet, window, bits in classes:
        said = "lower(x.said)" if name == "hex" else "x.said"
        coded = f"""transform(filter(__entropy, x -> x.said rlike {_literal(full)} and length(x.said) >= {window}),
            x -> named_struct('start', x.start, 'codes', transform(split({said}, ''), c -> instr('{alphabet}', c) - 1)))"""
        scanned = f"transform({coded}, x -> named_struct('start', x.start, 'scan', {_window_scan(window, len(alphabet), limit(window, bits))}))"
        found = f"filter({scanned}, x -> x.scan.last > 0)"
        parts.append(f"transform({found}, x -> named_struct('start', x.start + x.scan.first - {window}, 'ord', {KINDS.index('entropy')}, 'kind', 'entropy', 'end', x.start + x.scan.last))")
    return df.withColumn("__entropy", F.when(F.size("__entropy") > 0, F.expr(f"concat({', '.join(parts)})")).otherwise(F.expr(f"cast(array() as {SPANS})")))


SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"


def scan_secrets(df: DataFrame, text: str = "text", classes: tuple = CLASSES, allow: tuple = ALLOW) -> DataFrame:
    """df with base_spans and all_spans: arrays of (start, ord, kind, end) by start, then kind; code points, end exclusive."""
    kept = [c for c in df.columns if c not in ("base_spans", "all_spans")]
    df = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    low = F.lower("__text")
    keyword = F.greatest(*[F.contains(low, F.lit(w)) for w in ("passw", "secret", "token", "apikey", "api_key")])
    df = _matches(df, "__text", "assign", ASSIGN, keyword, 2)
    df = df.withColumn("__assign", F.filter("__assign", lambda x: F.length(x["said"]) >= 8))
    df = _matches(df, "__text", "access", ACCESS, F.contains("__text", F.lit("AKIA")))
    df = _matches(df, "__text", "hex", HEX, F.lit(True))
    df = _matches(df, "__text", "entropy", CANDIDATE, F.lit(True))
    df = _entropy(df, classes, allow)
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["kind"].alias("kind"), x["end"].alias("end")))
    df = df.withColumn("base_spans", F.array_sort(F.concat(plain("__assign"), plain("__access"), plain("__hex"))))
    df = df.withColumn("all_spans", F.array_sort(F.concat("base_spans", "__entropy")))
    return df.select("__row.*", "base_spans", "all_spans")


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[count_of("base_spans", k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined("base_spans"), 256).alias("base_sha256"),
        joined("all_spans").alias("spans"),
    )
