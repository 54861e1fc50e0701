"""BPE against the tokenizers library, and against plain merging where the vocabulary is odd."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqloom.llm import bpe
from reqloom.llm.common import tokenizer_file

SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id long, text string, ids string, decoded string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(bpe.VOCABULARY))


def texts() -> list[str]:
    rng = random.Random(5)
    kinds = ["ab", "abcdefghijklmnopqrstuvwxyz", "aeiouéü ñ \n\t  'stlldvmre", "0123456789 .,", "中文\U0001f600é á", " \n 　x\x1c\x85", "ing tion s the er", SPECIAL + " x"]
    out = ["".join(rng.choice(k) for _ in range(rng.randint(0, 80))) for k in kinds for _ in range(60)]
    out += ["", " ", "\n\n", f"x{SPECIAL}y {SPECIAL}{SPECIAL} z", "don't we'll I'd", "aaaa" * 50, "word " * 3000, "ab" * 40_000, " " * 30_000 + "x", "".join(rng.choice("abcdefgh") for _ in range(40_000))]
    return out


def test_ids_equal_the_library(library):
    coder = bpe.Vocabulary(bpe.VOCABULARY)
    assert coder.regular and coder.sound.sum() == 50_256
    some = texts()
    ids, counts = coder.encode(some)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, got in zip(some, parts, strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]
    assert coder.decode(ids.astype(np.int64), np.cumsum(counts)) == [library.decode(x.tolist(), skip_special_tokens=False) for x in parts] == some


def test_every_letter(library):
    """Each code point of the lower planes by itself, doubled, and among others."""
    coder = bpe.vocabulary()
    some = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1 {chr(c)}" for c in [*range(0x3100), *range(0xF900, 0x10000), *range(0x1F300, 0x1F700)]]
    ids, counts = coder.encode(some)
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_speculation_and_merging_agree():
    """Words that pass the pair test have the ids of exact merging; some words fail it."""
    coder, rng = bpe.vocabulary(), random.Random(1)
    words = list({"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)})
    ids, failed = coder.encode_words(words)
    assert 0 < failed < len(words)
    assert all(got.tolist() == coder.merged(w).tolist() for w, got in zip(words, ids, strict=True))
    words += [b"aaaaaaa", b"a" * 60, "ééééé".encode(), b"x"]
    assert all(got.tolist() == coder.merged(w).tolist() for w, got in zip(words, coder.merged_together(words), strict=True))
    assert coder.merged_together([]) == []


def test_odd_vocabularies(tmp_path):
    """A later merge of earlier parts makes the pair test unsound: all words are merged. Other kinds are refused."""
    with open(tokenizer_file(bpe.VOCABULARY), encoding="utf-8") as f:
        spec = json.load(f)
    letters = bpe.byte_letters()
    merges = [["a", "b"], ["b", "c"], ["a", "bc"]]
    spec["model"] |= {"vocab": {t: i for i, t in enumerate([*letters, "ab", "bc", "abc"])}, "merges": merges}
    spec["added_tokens"] = []
    plain = tmp_path / "plain.json"
    plain.write_text(json.dumps(spec))
    from tokenizers import Tokenizer

    coder, library = bpe.Vocabulary(str(plain)), Tokenizer.from_file(str(plain))
    assert coder.regular and not coder.sound[letters.__len__() + 2]  # "abc" encodes to "ab", "c"
    spec["model"]["merges"] = [["a", "bc"], ["a", "b"], ["b", "c"]]
    odd = tmp_path / "odd.json"
    odd.write_text(json.dumps(spec))
    late, other = bpe.Vocabulary(str(odd)), Tokenizer.from_file(str(odd))
    assert not late.regular
    some = ["abc", "aabbcc abcabc", "bcabc", "ab" * 9]
    for mine, theirs in ((coder, library), (late, other)):
        ids, counts = mine.encode(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [theirs.encode(t).ids for t in some]
    spec["model"]["ignore_merges"] = True
    odd.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(odd))


def test_chunks(monkeypatch, library):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    monkeypatch.setattr(bpe, "CACHED", 20)
    coder = bpe.Vocabulary(bpe.VOCABULARY)
    some = [t for t in texts() if len(t) < 5000]
    ids, counts = coder.encode(some)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert all("".join(bpe.chunks(t)) == t for t in some)


def test_decode_of_any_ids(library):
    coder = bpe.vocabulary()
    ids = [[220, 50256, 5], [163, 240], [163], [-1, 99_999, 40], []]  # bytes that are no UTF-8, ids that are none
    got = coder.decode(np.array([i for x in ids for i in x]), np.cumsum([len(x) for x in ids]))
    assert got == [library.decode([i for i in x if 0 <= i <= 50256], skip_special_tokens=False) for x in ids]


def test_query(spark, tmp_path, library):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts())] + [(None, "no id", None, None), (7, None, None, None), (7, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, bpe.op11_bpe(spark, str(tmp_path)).collect()), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert got == sorted(want, key=repr)
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [40])], "doc_id long, ids array<int>")).select(F.collect_list("decoded")).first()[0] == ["", "I"]
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert bpe.op11_bpe(spark, str(tmp_path / "none")).count() == 0
