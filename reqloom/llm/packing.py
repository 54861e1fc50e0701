"""Lexical retrieval packing.

Every text is encoded once. Documents are then dealt by content: a document's key is two tokens drawn from its set with
chances that grow with the token's rank in the vocabulary, by the same random numbers for all (weighted MinHash), so that documents
that share rare tokens tend to get the same key. In order of the keys they are cut into index shards of at most
SHARD_DOCS documents and SHARD_TOKENS tokens; a key that very many documents have fills several shards. Each shard holds its
own BM25 inverted index over token ids (its own document counts and lengths, as search engines score a shard). In a shard a
seed document opens a window. The index returns the unused documents that score highest for the seed; in that order those
that fit are put into the window. If room is left, the best one that does not fit is cut there and its rest
becomes the seed of the next window; without neighbours, the next unused document is. So all windows of a shard but the
last are full. A term that half of the shard's documents hold or more weighs nothing (the BM25 weight is not positive).

Null and empty texts have only the end token. Texts are packed whole, however long; a long one makes a shard of few. Rows
with equal ids are packed each on its own. Null ids are kept. Only id and text are read; extra columns are dropped. Ties in
score go to the document that comes first in the shard's order (by key, hash, id). An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm.common import table, tokenizer_file, written

VOCABULARY = "word_bpe_49k.json"
END = 1
WINDOW = 2048
SHARD_DOCS = 1024
SHARD_TOKENS = 4 << 20
PART_TOKENS = 16 << 20  # in one task, which packs its shards one after the other
PART_BYTES = 6 << 20  # of text that is encoded at a time
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tokens binary"


def word_engine(vocabulary: str):
    """(encoding, ids by rank, -1 for none, whether a rank ends a word): the vocabulary's merges for words in lower case, in an engine several times as fast.

    The engine merges the adjacent pair whose joined bytes have the lowest rank; the vocabulary's library merges the listed
    pair of the lowest rank. They agree where each token has one listed pair and its own bytes merge to itself (by
    induction over the length of a token's span), which the tests verify for the whole vocabulary. A word ends in a line
    break, which stands for the vocabulary's mark of word ends and never occurs inside a word.
    """
    import tiktoken

    with open(tokenizer_file(vocabulary), encoding="utf-8") as f:
        model = json.load(f)["model"]
    ranks = ranks_of(model["merges"])
    ids = {token_of(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
    by_rank, last = np.array([ids.get(b, -1) for b in ranks]), np.array([b.endswith(BREAK) for b in ranks])
    return tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={}), by_rank, last


BREAK, MARK = b"\n", "</w>"


def byte_of_letter() -> dict[str, int]:
    """The vocabulary writes bytes as letters: printable ones as themselves, the others as the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_BYTES = byte_of_letter()


def token_of(written: str) -> bytes:
    end = written.endswith(MARK) and written != MARK
    return bytes(_BYTES[c] for c in (written.removesuffix(MARK) if end else written)) + (BREAK if end else b"")


def ranks_of(merges: list) -> dict[bytes, int]:
    """Bytes, bytes that end a word, then the merges, in order."""
    ranks: dict[bytes, int] = {}
    for b in [*(bytes([x]) for x in range(256)), *(bytes([x]) + BREAK for x in range(256))]:
        ranks.setdefault(b, len(ranks))
    for pair in merges:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        ranks.setdefault(token_of(a) + token_of(b), len(ranks))
    return ranks


def lowered(word: str) -> str:
    """A word of letters, lowered letter by letter as the vocabulary's normalizer does; empty for any other."""
    if word.isascii():
        return word.lower() if word.isalpha() else ""
    low = "".join(map(str.lower, word)) if word.isalpha() and unicodedata.is_normalized("NFC", word) else ""
    return low if low.isalpha() else ""


class TokenBytes(dict):
    """Token ids of white-space-free strings as little-endian 32-bit numbers, kept up to a number of strings.

    The vocabulary's tokenizer drops white space and never looks across it, so a text's ids are those of its strings in a
    row. It splits letters from signs that follow and lowers them letter by letter: so a word of letters goes, lowered, to
    the fast engine, signs after it go on their own, and all else goes to the tokenizer. The engine takes many words in one
    call, which costs less than to keep them and look them up; only the strings between are kept.
    """

    MOST = 400_000
    AT_ONCE = 1 << 15

    def __init__(self, vocabulary: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(vocabulary))
        self.engine, self.ids, self.last = word_engine(vocabulary)
        self[""] = b""

    def make_room(self) -> None:
        """Long strings go first, as short ones come again more often; all go if that is not enough."""
        for word in [w for w in self if len(w) > 6]:
            del self[word]
        if len(self) > self.MOST // 2:
            self.clear()
            self[""] = b""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.MOST:
            self.make_room()
        core, low = word.rstrip(MARKS), lowered(word)
        if core != word:
            whole = core.isalpha() and "İ" not in core  # lowered, that letter ends in a sign of its own
            value = self[core] + self[word[len(core) :]] if whole else self.tokenized(word)
        else:
            value = self.merged([low])[0] if low else self.tokenized(word)
        self[word] = value
        return value

    def of(self, words: list[str]) -> list[bytes]:
        """Of many strings, AT_ONCE by a call of the engine."""
        return [tokens for at in range(0, len(words), self.AT_ONCE) for tokens in self.of_some(words[at : at + self.AT_ONCE])]

    def of_some(self, words: list[str]) -> list[bytes]:
        cores = [w.rstrip(MARKS) for w in words]
        lows = list(map(lowered, cores))
        found = iter(self.merged([x for x in lows if x]))
        return [next(found) + self[w[len(c) :]] if x else self[w] for w, c, x in zip(words, cores, lows, strict=True)]

    def merged(self, lows: list[str]) -> list[bytes]:
        """Of words of letters in lower case, by one call of the engine."""
        if not lows:
            return []
        ranks = np.array(self.engine.encode_ordinary("\n".join(lows) + "\n"))
        ids = self.ids[ranks]
        ends = (4 * np.cumsum(ids >= 0)[self.last[ranks]]).tolist()
        tokens = ids[ids >= 0].astype("<u4").tobytes()
        return [tokens[a:b] for a, b in zip([0, *ends], ends)]

    def tokenized(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()


#: Signs that never join with letters before them; no apostrophe, which can.
MARKS = ".,;:!?#*$%&|()[]{}-+=/\\\"~^_@"
_LOADED: dict[str, TokenBytes] = {}


def token_bytes(text: str | None, vocabulary: str = VOCABULARY) -> bytes:
    """The ids of the whole text, without special tokens, as little-endian 32-bit numbers."""
    return encoded_texts(pa.array([text], pa.string()), vocabulary)[0]


def encoded_texts(texts: pa.Array, vocabulary: str = VOCABULARY) -> list[bytes]:
    """token_bytes of each text. A string that is found several times in them is encoded once."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = TokenBytes(vocabulary)
    words = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
    coded = words.flatten().dictionary_encode()
    tokens = pa.array(_LOADED[vocabulary].of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
    lists = (pa.LargeListArray if pa.types.is_large_list(words.type) else pa.ListArray).from_arrays(words.offsets, tokens)
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).to_pylist()


def parts(batch: pa.RecordBatch, text: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices, in each of which the texts after the first have fewer bytes than most."""
    place = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy().astype(np.int64)) // most
    edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


class Index:
    """BM25 over one shard: postings by term, in document order."""

    def __init__(self, documents: list[np.ndarray]):
        n = len(documents)
        lengths = np.array([len(d) for d in documents], dtype=np.float64)
        width = 1 + max((int(d.max()) for d in documents if len(d)), default=0)
        owner = np.repeat(np.arange(n), [len(d) for d in documents])
        pair, count = np.unique(np.concatenate([np.zeros(0, np.int64), *documents]).astype(np.int64) * n + owner if n else np.zeros(0, np.int64), return_counts=True)
        term, self.docs = pair // max(n, 1), pair % max(n, 1)
        held = np.bincount(term, minlength=width)
        idf = np.log((n - held + 0.5) / (held + 0.5))
        norm = K1 * (1 - B + B * lengths[self.docs] / max(1.0, lengths.mean() if n else 1.0))
        self.scores = idf[term] * count * (K1 + 1) / (count + norm)
        useful = idf[term] > 0
        term, self.docs, self.scores = term[useful], self.docs[useful], self.scores[useful]
        self.start = np.searchsorted(term, np.arange(width + 1))
        self.n = n

    def query(self, tokens: np.ndarray) -> np.ndarray:
        """Score of each document for the distinct terms of tokens."""
        terms = np.unique(tokens)
        a, b = self.start[terms], self.start[terms + 1]
        size = b - a
        if not size.sum():
            return np.zeros(self.n)
        at = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return np.bincount(self.docs[at], weights=self.scores[at], minlength=self.n)


def pack_shard(documents: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece. documents: token ids, in the shard's order."""
    index, n = Index(documents), len(documents)
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    unused, next_seed = np.ones(n, dtype=bool), 0
    pieces, sequence, filled = [], 0, 0
    rest: tuple[int, int] | None = None  # a document that was cut, and where it goes on

    def put(doc: int, start: int, most: int) -> int:
        nonlocal filled
        length = min(most, len(documents[doc]) - start, window - filled)
        pieces.append((doc, start, length, sequence, filled))
        filled += length
        return start + length

    while True:
        if rest is None:
            while next_seed < n and not unused[next_seed]:
                next_seed += 1
            if next_seed == n:
                return pieces
            rest = (next_seed, 0)
            unused[next_seed] = False
        seed, start = rest
        at = put(seed, start, window)
        rest = (seed, at) if at < len(documents[seed]) else None
        if filled < window and rest is None:
            scores = np.where(unused, index.query(documents[seed]), -1.0)
            order = np.argsort(-scores, kind="stable")
            order = order[scores[order] > 0]
            left_out = -1
            while filled < window and len(order):
                fits = sizes[order] <= window - filled
                place = int(np.argmax(fits))
                if left_out < 0 and not fits[0]:
                    left_out = int(order[0])
                if not fits[place]:
                    break
                doc = int(order[place])
                put(doc, 0, int(sizes[doc]))
                unused[doc] = False
                order = order[place + 1 :]
            if filled < window and left_out >= 0:
                unused[left_out] = False
                at = put(left_out, 0, window)
                rest = (left_out, at)
        if filled == window:
            sequence, filled = sequence + 1, 0


RARER = 4.0  # a token's weight in the key is this power of the logarithm of its id, as later ids are rarer


def _draws(seed: int, n: int) -> np.ndarray:
    """Of each token id the number that is compared: the least of a set is drawn with a chance in proportion to its weight."""
    weight = np.log(np.arange(n) + 2.0) ** RARER
    return np.random.Generator(np.random.PCG64(seed)).exponential(size=n) / weight


def content_key(ids: np.ndarray, draws: tuple[np.ndarray, np.ndarray]) -> int:
    """Two tokens of the document, one from each row of draws, as one number; -1 without tokens."""
    if not len(ids):
        return -1
    first, second = (int(ids[np.argmin(d[ids])]) for d in draws)
    return first << 31 | second


def narrow(tokens: bytes) -> bytes:
    """32-bit numbers as 16-bit ones where all fit."""
    ids = np.frombuffer(tokens, dtype="<u4")
    return ids.astype("<u2").tobytes() if int(ids.max()) < 1 << 16 else tokens


def wide(tokens: bytes, n: int) -> bytes:
    """n numbers of either width as 32-bit ones."""
    return tokens if len(tokens) == 4 * n else np.frombuffer(tokens, dtype="<u2").astype("<u4").tobytes()


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str, seed: int) -> Iterator[pa.RecordBatch]:
    draws = _draws(seed, 1 << 17), _draws(seed + 1, 1 << 17)
    end = np.array([END], dtype="<u4").tobytes()
    for batch in batches:
        for part in parts(batch, "text"):
            raw = encoded_texts(part.column("text"), vocabulary)
            ids = [np.frombuffer(r, dtype="<u4") for r in raw]
            keys = [content_key(i, draws) if not len(i) or int(i.max()) < 1 << 17 else int(i.max()) for i in ids]
            tokens = [narrow(r + end) for r in raw]
            columns = [part.column("doc_id"), part.column("order"), pa.array(keys, pa.int64()), pa.array([len(i) + 1 for i in ids], pa.int64()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "order", "key", "n", "tokens"])


def _pieces(given: list[tuple[int | None, bytes]], window: int, base: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of one shard, and the number of its sequences. given: id and tokens of each document, in order."""
    pieces = pack_shard([np.frombuffer(r, dtype="<u4") for _, r in given], window)
    doc, start, length, sequence, offset = (np.array(c, dtype=np.int64) for c in zip(*pieces, strict=True))
    tokens = [given[d][1][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length, strict=True)]
    columns = [pa.array([given[d][0] for d in doc], pa.int64()), start, length, pa.array([zlib.crc32(t) for t in tokens], pa.int64()), pa.array([len(given[d][1]) // 4 for d in doc], pa.int64()), base + sequence, offset, pa.array(tokens, pa.binary())]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names), int(sequence.max()) + 1


def _pack(batches: Iterator[pa.RecordBatch], window: int, shard_docs: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    """Packs the documents of a task, which come in order of their keys, shard by shard."""
    base, given, held = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for doc_id, n_tokens, tokens in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "tokens")), strict=True):
            if given and (len(given) >= shard_docs or held + n_tokens > shard_tokens):
                out, n = _pieces(given, window, base)
                yield out
                base, given, held = base + n, [], 0
            given.append((doc_id, wide(tokens, n_tokens)))
            held += n_tokens
    if given:
        yield _pieces(given, window, base)[0]


def pack(docs: DataFrame, id_: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, window: int = WINDOW, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS, seed: int = 5) -> DataFrame:
    """One row for each piece, with its token ids (tokens: little-endian 32-bit)."""
    order = F.xxhash64(F.lit(seed), F.col(id_), F.crc32(F.coalesce(text, F.lit("")).cast("binary")))
    given = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"), order.alias("order"))
    encoded = written(given.mapInArrow(lambda b: _encode(b, vocabulary, seed), "doc_id long, order long, key long, n long, tokens binary"), "tokens")
    rows, tokens = encoded.agg(F.count(F.lit(1)), F.sum("n")).first()
    shards = max(1, math.ceil(rows / shard_docs))
    tasks = min(shards, max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((tokens or 0) / PART_TOKENS)))
    dealt = encoded.repartitionByRange(tasks, "key", "order", "doc_id").sortWithinPartitions("key", "order", "doc_id").select("doc_id", "n", "tokens")
    return dealt.mapInArrow(lambda b: _pack(b, window, shard_docs, shard_tokens), SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("tokens")
