"""Byte-level BPE: speculate and verify.

A text is cut into words by the vocabulary's pattern. Each distinct word of a batch gets a proposal, its greedy longest
matches, from one walk of all positions through the vocabulary's trie. The proposal is the word's encoding if every
adjacent pair of tokens is compatible, that is, if the merges never join across the edge between the two: undoing the
merges of both tokens, latest first, no pair of pieces at the edge may have a merge that comes before the pieces vanish
in larger ones. That test runs over all distinct pairs at once, in whole arrays. Only words with an incompatible pair are
merged exactly, by a heap of ranks. Words travel through a cache that is emptied when full; it changes no result.

The test is sound for vocabularies in which each merge makes a token of its own, later than the merges of its parts. For
any other vocabulary every word is merged exactly. Tokens that do not encode to themselves are never proposed.

Null text is an empty text and gives no ids; null ids decode to an empty text. Texts are encoded whole, however long:
they are cut where no word can lie across. Added tokens in a text are tokens, as the library has it. Ids that the
vocabulary lacks decode to nothing; bytes that are no UTF-8 to U+FFFD. A null id of a document stays null, repeated rows
are rows of their own, ties do not arise. Only the id and the text are read, extra columns are dropped. An empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm.common import table, tokenizer_file

VOCABULARY = "byte_bpe_50k.json"
CHUNK = 1 << 20  # characters encoded at once
CACHED = 1 << 18  # words
SHORT = 64  # bytes of words that are merged together
NEVER = np.iinfo(np.int64).max
# Fixed value: the pattern that byte-level pre-tokenizers split by. Its white space is Unicode's; regex also counts U+001C to U+001F.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")
_EDGE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")  # no word lies across


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others for letters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Vocabulary:
    """The file's tokens and merges as arrays; encodes and decodes batches of texts."""

    def __init__(self, file: str):
        with open(tokenizer_file(file), encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        before = spec["pre_tokenizer"] or {}
        odd = [model["type"] != "BPE", before.get("type") != "ByteLevel", before.get("add_prefix_space"), not before.get("use_regex", True), spec["normalizer"]]
        odd += [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")]
        odd += [a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")]
        if any(odd):
            raise ValueError(f"{file}: only plain byte-level BPE without normalizer is supported")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        raw = {i: bytes(map(byte_of.__getitem__, t)) for t, i in model["vocab"].items() if byte_of.keys() >= set(t)}
        self.added = {a["content"]: a["id"] for a in added}
        for content, i in self.added.items():
            raw[i] = bytes(map(byte_of.__getitem__, content)) if byte_of.keys() >= set(content) else content.encode()
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.size = max(raw) + 1
        self.byte_ids = [model["vocab"].get(c) for c in byte_of]
        if None in self.byte_ids:
            raise ValueError(f"{file}: not every byte is a token")
        self._read_merges(model["vocab"], model["merges"])
        self.blob = np.frombuffer(b"".join(raw.get(i, b"") for i in range(self.size)), dtype=np.uint8)
        self.lengths = np.fromiter((len(raw.get(i, b"")) for i in range(self.size)), np.int64, self.size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self._plant(raw)
        self._forget()

    def _read_merges(self, ids: dict[str, int], merges: list) -> None:
        parts = [m.split(" ") if isinstance(m, str) else m for m in merges]
        a, b, made = (np.fromiter(map(ids.__getitem__, x), np.int64, len(parts)) for x in ([p[0] for p in parts], [p[1] for p in parts], [p[0] + p[1] for p in parts]))
        self.rank, self.left, self.right = np.full(self.size, -1), np.full(self.size, -1), np.full(self.size, -1)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(parts)), a, b
        order = np.argsort(a * self.size + b, kind="stable")
        self.pair_keys, self.pair_ranks, self.made = (a * self.size + b)[order], order, made
        self.merge_of = {k: r for k, r in zip((a * self.size + b).tolist(), range(len(parts)))}
        self.regular = len(np.unique(made)) == len(parts) and not np.isin(made, self.byte_ids).any() and bool((np.maximum(self.rank[a], self.rank[b]) < np.arange(len(parts))).all())
        self.sound = np.zeros(self.size, dtype=bool)
        self.sound[self.byte_ids] = True
        if self.regular:
            alone = self.compatible(a, b, np.arange(len(parts)))
            for t, l, r, good in zip(made.tolist(), a.tolist(), b.tolist(), alone.tolist()):
                self.sound[t] = good and self.sound[l] and self.sound[r]

    def _plant(self, raw: dict[int, bytes]) -> None:
        """The trie of the sound tokens: sorted keys 256 * node + byte, the node that each leads to, the token that ends at each node."""
        nodes, edges, token = {b"": 0}, {}, [-1]
        for t in np.flatnonzero(self.sound).tolist():
            word, at = raw[t], 0
            for n in range(1, len(word) + 1):
                if (to := nodes.get(word[:n])) is None:
                    to = nodes[word[:n]] = len(token)
                    edges[at << 8 | word[n - 1]] = to
                    token.append(-1)
                at = to
            token[at] = t
        self.trie_keys = np.array(sorted(edges), dtype=np.int64)
        self.trie_to = np.array([edges[k] for k in self.trie_keys.tolist()], dtype=np.int64)
        self.node_token = np.array(token, dtype=np.int64)

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.flat, self.word_starts, self.word_lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; NEVER where there is none."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER) if len(self.pair_keys) else np.full(len(keys), NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether no merge before until joins a piece of a with a piece of b, of each pair.

        Pieces at the edge are followed back in time. Of merges with equal rank the one further left comes first: a piece
        on the left is gone when its own merge has the rank of the joining one, a piece on the right is not.
        """
        good = np.ones(len(a), dtype=bool)
        l, r = a.copy(), b.copy()
        gone_l, gone_r = np.broadcast_to(until, len(a)).copy(), np.broadcast_to(until, len(a)).copy()
        open_ = np.arange(len(a))
        while len(open_):
            x, y = l[open_], r[open_]
            joins = self.merge_rank(x, y)
            good[open_] = ~((joins < gone_l[open_]) & (joins <= gone_r[open_]))
            undo_left, undo_right = self.rank[x] > self.rank[y], (self.rank[y] >= self.rank[x]) & (self.rank[y] >= 0)
            one, other = open_[undo_left], open_[undo_right]
            gone_l[one], gone_r[other] = self.rank[l[one]], self.rank[r[other]]
            l[one], r[other] = self.right[l[one]], self.left[r[other]]
            open_ = open_[good[open_] & (undo_left | undo_right)]
        return good

    def longest(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest token that starts at each byte and ends by ends."""
        found, node, at, depth = np.full(len(text), -1), np.zeros(len(text), np.int64), np.arange(len(text)), 0
        while len(at):
            keys = node << 8 | text[at + depth]
            to = np.minimum(np.searchsorted(self.trie_keys, keys), len(self.trie_keys) - 1)
            hit = self.trie_keys[to] == keys
            at, node, depth = at[hit], self.trie_to[to[hit]], depth + 1
            ends_here = self.node_token[node] >= 0
            found[at[ends_here]] = self.node_token[node[ends_here]]
            inside = at + depth < ends[at]
            at, node = at[inside], node[inside]
        return found

    def proposed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(greedy tokens of all words in a row, the word that each belongs to)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        token = self.longest(np.frombuffer(b"".join(words), dtype=np.uint8), np.repeat(ends, sizes))
        step = self.lengths[token].tolist()
        at, tokens, owner = (ends - sizes).tolist(), [], []
        for word, (here, end) in enumerate(zip(at, ends.tolist())):
            while here < end:
                tokens.append(here)
                owner.append(word)
                here += step[here]
        return token[np.array(tokens, dtype=np.int64)], np.array(owner, dtype=np.int64)

    def encode_words(self, words: list[bytes]) -> tuple[list[np.ndarray], int]:
        """Ids of each word (none is empty), and how many had to be merged exactly."""
        if not words:
            return [], 0
        if not self.regular:
            return [self.merged(w) for w in words], len(words)
        tokens, owner = self.proposed(words)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        bad = ~self.compatible(pairs // self.size, pairs % self.size)
        failed = np.unique(owner[inner[bad[which]]])
        out = np.split(tokens, np.flatnonzero(owner[1:] != owner[:-1]) + 1)
        short = [i for i in failed.tolist() if len(words[i]) <= SHORT]
        for word, ids in zip(short, self.merged_together([words[i] for i in short])):
            out[word] = ids
        for word in failed.tolist():
            if len(words[word]) > SHORT:
                out[word] = self.merged(words[word])
        return out, len(failed)

    def merged_together(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many short words, a rank of each word at a time; for regular vocabularies.

        There a merge only makes pairs of later ranks, so all pairs of a word's lowest rank can go at once, from the left.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tokens = np.array(self.byte_ids, dtype=np.int64)[np.frombuffer(b"".join(words), dtype=np.uint8)]
        names = np.arange(len(words))
        while len(tokens):
            starts = np.cumsum(sizes) - sizes
            ranks = np.full(len(tokens), NEVER)
            ranks[:-1] = self.merge_rank(tokens[:-1], tokens[1:])
            ranks[starts + sizes - 1] = NEVER
            least = np.minimum.reduceat(ranks, starts)
            done = least == NEVER
            if done.any():
                for name, a, n in zip(names[done].tolist(), starts[done].tolist(), sizes[done].tolist()):
                    out[name] = tokens[a : a + n]
                stay = np.repeat(~done, sizes)
                tokens, ranks, sizes, names, least = tokens[stay], ranks[stay], sizes[~done], names[~done], least[~done]
            chosen = ranks == np.repeat(least, sizes) if len(tokens) else np.zeros(0, dtype=bool)
            places = np.flatnonzero(chosen)
            first = np.concatenate([[True], np.diff(places) > 1])[: len(places)]  # of places in a row, as in a a a, each second one goes
            nth = np.arange(len(places)) - np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            places = places[nth % 2 == 0]
            tokens[places] = self.made[ranks[places]]
            keep = np.ones(len(tokens), dtype=bool)
            keep[places + 1] = False
            sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[places], minlength=len(sizes))
            tokens = tokens[keep]
        return out

    def merged(self, word: bytes) -> np.ndarray:
        """Exact merging: the pair of the lowest rank first, of equal ones the leftmost."""
        ids, size, merge_of, made = [self.byte_ids[b] for b in word], self.size, self.merge_of, self.made
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(rank, i) for i in range(len(ids) - 1) if (rank := merge_of.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or merge_of.get(ids[i] * size + ids[j]) != rank:
                continue
            ids[i], ids[j] = int(made[rank]), -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (again := merge_of.get(ids[left] * size + ids[right])) is not None:
                    heapq.heappush(heap, (again, left))
        return np.array([t for t in ids if t >= 0], dtype=np.int64)

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has; words go to the cache."""
        new = list(set(words).difference(self.cache))
        if new:
            ids, _ = self.encode_words([w.encode() for w in new])
            first = len(self.word_starts)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.word_starts = np.concatenate([self.word_starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.word_lengths = np.concatenate([self.word_lengths, sizes])
            self.flat = np.concatenate([self.flat, np.concatenate(ids).astype(np.int32)])
            self.cache.update(zip(new, range(first, first + len(new))))
        at = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        sizes = self.word_lengths[at]
        ids = self.flat[gathered(self.word_starts[at], sizes)]
        if len(self.cache) > CACHED or len(self.flat) > 8 * CACHED:
            self._forget()
        return ids, sizes

    def encode_part(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without added tokens in a row, and how many each has."""
        words, counts = [], []
        for part in parts:
            found = SPLIT.findall(part)
            words += found
            counts.append(len(found))
        ids, sizes = self._look_up(words)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(np.array(counts, dtype=np.int64))
        return ids, np.diff(edges[np.concatenate([[0], ends])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and how many each has. Parts of about CHUNK characters are looked up at once."""
        out, counts, parts, owners, held = [], np.zeros(len(texts), dtype=np.int64), [], [], 0

        def flush() -> None:
            nonlocal parts, owners, held
            if parts:
                ids, sizes = self.encode_part(parts)
                out.append(ids)
                np.add.at(counts, owners, sizes)
            parts, owners, held = [], [], 0

        for i, text in enumerate(texts):
            for piece in self.split_added.split(text) if self.split_added else [text]:
                if piece in self.added:
                    flush()
                    out.append(np.array([self.added[piece]], dtype=np.int32))
                    counts[i] += 1
                    continue
                for part in chunks(piece):
                    parts.append(part)
                    owners.append(i)
                    held += len(part)
                    if held >= CHUNK:
                        flush()
        flush()
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of runs of ids; ends says where each run ends."""
        known = (ids >= 0) & (ids < self.size)
        at = np.where(known, ids, 0)
        sizes = np.where(known, self.lengths[at], 0)
        raw = self.blob[gathered(self.starts[at], sizes)].tobytes()
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])]


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of runs of the given starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def chunks(text: str) -> Iterable[str]:
    """The text in pieces of about CHUNK characters; no word lies across two of them."""
    at = 0
    while len(text) - at > CHUNK:
        edge = _EDGE.search(text, at + CHUNK)
        if edge is None:
            break
        yield text[at : edge.start()]
        at = edge.start()
    if at < len(text):
        yield text[at:]


def slices(lengths: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(first row, rows) of stretches of rows whose lengths add up to most at the utmost; a longer one is a stretch of its own."""
    sizes = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(sizes):
        before = sizes[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield first, end - first
        first = end


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(file: str = VOCABULARY) -> Vocabulary:
    """The vocabulary, kept for the life of the worker."""
    if file not in _LOADED:
        _LOADED[file] = Vocabulary(file)
    return _LOADED[file]


def _encode(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    coder = vocabulary(file)
    for batch in batches:
        for first, n in slices(pc.binary_length(batch.column(1))):
            ids, counts = coder.encode([t or "" for t in batch.column(1).slice(first, n).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    coder = vocabulary(file)
    for batch in batches:
        for first, n in slices(pc.list_value_length(batch.column(1)), CHUNK // 4):
            lists = batch.column(1).slice(first, n)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            texts = coder.decode(lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, file: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of each document's text."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lambda b: _encode(b, file), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, file: str = VOCABULARY) -> DataFrame:
    """encoded (doc_id, ids) with decoded, the text of the ids."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decode(b, file), "doc_id long, ids array<int>, decoded string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(table(spark, sf_dir, "documents")))
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
