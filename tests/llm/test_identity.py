"""Texts that patterned hashes would confuse, literals of added tokens, and rows that repeat an id."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpusloom.llm import bpe, neardup, token_files
from corpusloom.llm.common import span_hashes


def morse(n, one="a", two="b"):
    """Thue-Morse word of n letters and its complement: sums over powers of an odd base agree modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((one, two)[b] for b in bits), "".join((two, one)[b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_patterned_words_have_hashes_of_their_own(n):
    raw = np.frombuffer("".join(morse(n)).encode(), np.uint8)
    a, b = span_hashes(raw, np.array([0, n]), np.array([n, 2 * n]))
    assert a != b


def test_equal_spans_hash_alike_wherever_they_stand():
    r = np.random.default_rng(3)
    raw = r.integers(97, 100, 4000).astype(np.uint8)
    starts = r.integers(0, 3800, 3000)
    ends = starts + r.integers(0, 190, 3000)
    seen, back = {}, {}
    for h, i, j in zip(span_hashes(raw, starts, ends).tolist(), starts, ends, strict=True):
        assert seen.setdefault(raw[i:j].tobytes(), h) == h
        assert back.setdefault(h, raw[i:j].tobytes()) == raw[i:j].tobytes()


@pytest.fixture(scope="module")
def patterned():
    return [t for n in (1024, 2048, 4096) for t in morse(n)] + [" ".join(morse(256, "ab", "ba"))]


def test_bpe_of_patterned_texts(patterned):
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    enc, dec = bpe.codec(bpe.tokenizer_path("byte_bpe_50k.tiktoken"), bpe.default_pattern())
    for _, _, _, _, ids, to in bpe.encoded_blocks(pa.array(patterned), enc):
        for i, t in enumerate(patterned):
            assert ids[to[i] : to[i + 1]].tolist() == own.encode_ordinary(t)
            assert dec.decode(ids[to[i] : to[i + 1]]).tobytes().decode() == t


def test_chunks_that_share_a_hash_are_told_apart(monkeypatch):
    """With a hash of two bits nearly all chunks collide; ids stay those of the library."""
    monkeypatch.setattr(bpe, "span_hashes", lambda raw, a, b: span_hashes(raw, a, b) & np.uint64(3))
    enc, _ = bpe.codec(bpe.tokenizer_path("byte_bpe_50k.json"), None)
    small = bpe.Encoder(enc.tokenizer, enc.length, added=True)
    texts = ["one two three", "another sentence with considerably longer expressions", "one considerably longer", "", "x"]
    # Chunks of up to eight bytes rely on hashes that can't collide at equal length, so only longer ones are tried here.
    texts = [" ".join(w for w in t.split() if len(w) > 8) for t in texts]
    for _, _, _, _, ids, to in bpe.encoded_blocks(pa.array(texts), small):
        for i, t in enumerate(texts):
            assert ids[to[i] : to[i + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_added_tokens_in_files_are_the_librarys(spark, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    texts = ["plain text", "before <|endoftext|> after", None, "<|endoftext|><|endoftext|>", "<|endof text|>"]
    token_files.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "t"))
    got, start = {r.doc_id: r for r in token_files.read(spark, str(tmp_path / "t")).collect()}, 0
    for i, t in enumerate(texts):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_near_duplicates_of_patterned_texts(spark, patterned):
    got = neardup.classes(spark.createDataFrame(list(enumerate(patterned)), "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got)


LONG = {"A": "one two three four five six seven eight nine ten eleven twelve", "B": "alpha beta gamma delta epsilon zeta eta theta iota kappa", "C": "one two three four five six seven eight nine ten eleven twelve thirteen"}


def test_repeated_ids_lose_no_text(spark):
    rows = [(1, "A"), (1, "B"), (2, "B"), (3, "A"), (4, "C"), (None, "A"), (5, ""), (5, ""), (5, " ")]
    df = spark.createDataFrame([(i, LONG.get(t, t)) for i, t in rows], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in neardup.classes(df).collect())
    assert got == [(0, 0, 8), (1, 1, 6), (1, 1, 8), (2, 1, 6), (3, 1, 8), (4, 1, 9), (5, 5, 0), (5, 5, 0), (5, 5, 0)]
    kept = sorted((r.doc_id or 0, r.text) for r in neardup.keep_one(df).collect())
    assert kept == sorted([(0, LONG["A"]), (1, LONG["A"]), (1, LONG["B"]), (5, ""), (5, " ")])
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_linked_texts_of_one_id_leave_one_row(spark):
    df = spark.createDataFrame([(7, LONG["A"], 1), (7, LONG["C"], 2), (7, LONG["A"], 3), (9, LONG["C"], 4)], "doc_id long, text string, extra int")
    kept = neardup.keep_one(df).collect()
    assert len(kept) == 1 and kept[0].doc_id == 7


def test_digest_of_words_ignores_case_and_spacing():
    raw = "A b\nC".encode() + b"  a B c " + b"ab c"
    _, _, k1, k2 = neardup.shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, 5, 13, 17]))
    assert (k1[0], k2[0]) == (k1[1], k2[1]) != (k1[2], k2[2])
    assert hashlib.blake2b(np.array([1, 1, 1], "<u4").tobytes() + b"abc", digest_size=16).digest() == np.array([k1[0], k2[0]], "<u8").tobytes()
