"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

A text's words repeat, so each worker keeps the ids of the chunks it has met. Texts are cut where the split
pattern begins a new piece whatever stands around (see chunk_starts), thus a text's ids are its
chunks' ids in a row. Chunks are looked up by their bytes' 64-bit hashes, found for a whole block of texts at a time,
and what is found must agree in its bytes; only chunks not met yet, or that share a hash with another, go to the
library. The store is emptied when it reaches CHUNKS_KEPT, which bounds memory and changes no result.

Nulls and empty texts have no ids; repeated rows are encoded each for itself; extra columns are ignored; an empty
table gives an empty result. A text of any length is encoded whole, as a block of its own.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, span_hashes, text_parts, tokenizer_path

CHUNKS_KEPT = 2_000_000
#: Chunks that are handed to the library as one text.
JOINED = 64
#: Bytes of text that are encoded in one go; a longer text forms a block of its own.
ENCODE_BYTES = 4 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_BREAK, _SIGN, _PLAIN = np.zeros((3, 256), bool)
_BREAK[[0x20, 0x0A]] = True
_SIGN[list(b"!#$%&()*+,-./:;<=>?@|~")] = True
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@lru_cache(1)
def byte_to_char() -> list[str]:
    """The printable character that stands for each byte: itself if it prints in Latin-1, else the next one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizers pipeline that merges as the rank table says: each way to halve a token is a merge, in rank order."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    char = byte_to_char()
    show = {t: "".join(char[b] for b in t) for t in ranks}
    merges = [(show[t[:i]], show[t[i:]]) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    out = Tokenizer(models.BPE(vocab={show[t]: r for t, r in ranks.items()}, merges=merges))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def token_bytes(tokenizer) -> list[bytes]:
    """Bytes of each id: the byte table reversed. An id without a token has none."""
    back = {c: b for b, c in enumerate(byte_to_char())}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[starts[i]:starts[i] + lengths[i]] for each i, in a row."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each text, at each space or line break without white space at either side (and after the break), and where signs follow a letter or digit. What might be part of a longer white-space character counts as one."""
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 2:
        at = np.flatnonzero(_BREAK[raw[1:-1]]) + 1
        before, after = raw[at - 1], raw[at + 1]
        two, three = raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
        odd = _WHITE[before] | _WHITE[after] | (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3)) | ((two == 0xC2) & (before >= 0x80)) | ((three >= 0xE1) & (three <= 0xE3) & (before >= 0x80))
        at = at[~odd]
        cut[at] = True
        cut[at[raw[at] == 0x0A] + 1] = True
        at = np.flatnonzero(_SIGN[raw[1:]]) + 1
        before, two = raw[at - 1], raw[np.maximum(at - 2, 0)]
        cut[at[_PLAIN[before] | ((two == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))]] = True
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


class Encoder:
    """Token ids of blocks of texts. Literals of added tokens are ordinary text, unless added is true."""

    def __init__(self, tokenizer, length: np.ndarray, added: bool = False):
        """length: bytes of each id."""
        self.tokenizer, self.length = tokenizer, length
        self.literals = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()] if added else []
        self._empty()

    def _empty(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.starts, self.counts, self.place, self.size = np.empty((4, 0), np.int64)
        self.pool, self.bytes = np.empty(0, np.uint32), np.empty(0, np.uint8)

    def _ids(self, texts: list[bytes], literal: bool = False) -> list[np.ndarray]:
        self.tokenizer.encode_special_tokens = not literal
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """Keeps the ids of new chunks. Those between single spaces are handed over JOINED at a time and told apart by their bytes, which costs less for each."""
        plain = np.array([c[:1] == b" " and len(c) > 1 and not (_WHITE[c[1]] or _WHITE[c[-1]]) and c[1] < 0xE1 and c[1] != 0xC2 and (c[-1] < 0x80 or (c[-2] != 0xC2 and not 0xE1 <= c[-3] <= 0xE3)) for c in chunks], bool)
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        n = int(plain.sum())
        groups = [list(range(i, min(i + JOINED, n))) for i in range(0, n, JOINED)] + [[i] for i in range(n, len(order))]
        pools, counts = [], np.zeros(len(order), np.int64)
        ordered = [chunks[i] for i in order]
        for lo in range(0, len(groups), 1000):
            part = groups[lo : lo + 1000]
            for g, ids in zip(part, self._ids([b"".join(ordered[g[0] : g[-1] + 1]) for g in part]), strict=True):
                ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(ordered[i]) for i in g])) + 1
                counts[g[0] : g[-1] + 1] = np.diff(ends, prepend=0)
                pools.append(ids)
        size = np.array([len(c) for c in ordered], np.int64)
        starts, place = len(self.pool) + np.cumsum(counts) - counts, len(self.bytes) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, *pools])
        self.bytes = np.concatenate((self.bytes, np.frombuffer(b"".join(ordered), np.uint8)))
        hashes = np.concatenate((self.hashes, hashes[order]))
        sort = np.argsort(hashes)
        self.hashes = hashes[sort]
        self.starts, self.counts, self.place, self.size = (np.concatenate(x)[sort] for x in ((self.starts, starts), (self.counts, counts), (self.place, place), (self.size, size)))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, len+1 offsets of the rows among them)."""
        ids, to = self._plain(raw, offsets)
        data = raw.tobytes() if self.literals else b""
        hit = set()
        for x in self.literals:
            at = data.find(x)
            while at != -1:
                hit.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = data.find(x, at + 1)
        if not hit:
            return ids, to
        # Rows with the literal of an added token are the library's alone.
        rows = sorted(hit)
        parts = [ids[to[i] : to[i + 1]] for i in range(len(to) - 1)]
        for i, own in zip(rows, self._ids([data[offsets[i] : offsets[i + 1]] for i in rows], literal=True), strict=True):
            parts[i] = own
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = chunk_starts(raw, offsets)
        if not len(at):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(at[1:], len(raw))
        hashes, first, which = np.unique(span_hashes(raw, at, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > CHUNKS_KEPT:
            self._empty()
        place = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool) if not len(self.hashes) else self.hashes[np.minimum(place, len(self.hashes) - 1)] != hashes
        if new.any():
            data = raw.tobytes()
            self._learn(hashes[new], [data[i:j] for i, j in zip(at[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            place = np.searchsorted(self.hashes, hashes)
        found, length = place[which], ends - at
        counts, starts, pool = self.counts[found], self.starts[found], self.pool
        # Chunks of one length up to eight bytes have hashes of their own; of longer ones the bytes are compared.
        other = self.size[found] != length
        long = np.flatnonzero((length > 8) & ~other)
        if len(long):
            same = ragged(raw, at[long], length[long]) == ragged(self.bytes, self.place[found[long]], length[long])
            other[long] = ~np.logical_and.reduceat(same, np.cumsum(length[long]) - length[long])
        if other.any():
            odd = np.flatnonzero(other)
            own = self._ids([raw[at[i] : ends[i]].tobytes() for i in odd])
            counts[odd] = [len(x) for x in own]
            starts[odd] = len(pool) + np.cumsum(counts[odd]) - counts[odd]
            pool = np.concatenate([pool, *own])
        total = np.concatenate(([0], np.cumsum(counts)))
        return ragged(pool, starts, counts), total[np.searchsorted(at, offsets)]


class Decoder:
    """Bytes of id sequences, and where each token lies in its text."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.pool, self.starts[ids], self.length[ids])

    def offsets(self, ids: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points (start, end) of each token of one text, and whether it begins inside a character; a character split over tokens belongs to each of them."""
        ends = np.cumsum(self.length[ids])
        starts = ends - self.length[ids]
        lead = (raw & 0xC0) != 0x80
        nth = np.cumsum(lead)
        return nth[starts] - 1, nth[ends - 1], ~lead[starts]


_loaded: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def codec(path: str, pattern: str | None) -> tuple[Encoder, Decoder]:
    """The worker's own encoder and decoder of a vocabulary file (ranks, or a tokenizers file)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, pattern) not in _loaded:
        from tokenizers import Tokenizer

        ranks = path.endswith(".tiktoken")
        tokenizer = tokenizer_from_ranks(read_ranks(path), pattern) if ranks else Tokenizer.from_file(path)
        dec = Decoder(token_bytes(tokenizer))
        _loaded[path, pattern] = Encoder(tokenizer, dec.length, added=not ranks), dec
    return _loaded[path, pattern]


def encoded_blocks(column: pa.Array, encoder: Encoder, size: int = ENCODE_BYTES):
    """(first row, row after the last, bytes, byte offsets, ids, id offsets) of each block of a string column."""
    raw, offsets = text_parts(column)
    for lo, hi in blocks(offsets, size):
        part = offsets[lo : hi + 1]
        own = raw[part[0] : part[-1]]
        yield lo, hi, own, part - part[0], *encoder.encode(own, part - part[0])


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, starts array<int>, ends array<int>) per row: token ids and the code points each token covers."""
    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()

    def run(batches):
        enc, dec = codec(path, pattern)
        for b in batches:
            for lo, hi, raw, at, ids, to in encoded_blocks(b.column(1), enc):
                ends = np.zeros((2, len(ids)), np.int32)
                for i in range(hi - lo):
                    own = slice(to[i], to[i + 1])
                    if to[i] < to[i + 1]:
                        ends[0, own], ends[1, own], _ = dec.offsets(ids[own], raw[at[i] : at[i + 1]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), _lists(ids, to), _lists(ends[0], to), _lists(ends[1], to)], ["id", "ids", "starts", "ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(ids: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, bytes, text) of (id, ids): the bytes as they are, and the text with characters that no token sequence completes replaced."""
    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()

    def run(batches):
        _, dec = codec(path, pattern)
        for b in batches:
            raw = [dec.decode(np.array(x or [], np.int64)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())], ["id", "bytes", "text"])

    kind = ids.schema["id"].dataType.simpleString()
    return ids.select("id", "ids").mapInArrow(run, f"id {kind}, bytes binary, text string")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every row and returns digests: doc_id, n_tokens, ids_sha256, decoded_sha256, n_inside (tokens that begin inside a character)."""
    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        enc, dec = codec(path, pattern)
        shown = Decoder([b"%d " % i for i in range(len(dec.length))])
        for b in batches:
            for lo, hi, _, _, ids, to in encoded_blocks(b.column(1), enc):
                back, text = dec.decode(ids), shown.decode(ids)
                byte_to = np.concatenate(([0], np.cumsum(dec.length[ids])))
                inside = np.concatenate(([0], np.cumsum((back[byte_to[:-1]] & 0xC0) == 0x80)))
                shown_to = np.concatenate(([0], np.cumsum(shown.length[ids])))[to].tolist()
                byte_to = byte_to[to].tolist()
                rows = [b.column(0).slice(lo, hi - lo), pa.array(np.diff(to)), pa.array([sha(text[i : max(i, j - 1)]) for i, j in zip(shown_to, shown_to[1:])]), pa.array([sha(back[i:j]) for i, j in zip(byte_to, byte_to[1:])]), pa.array(np.diff(inside[to]))]
                yield pa.RecordBatch.from_arrays(rows, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_inside"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_inside long")


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return round_trip(table(spark, sf_dir, "documents"))
