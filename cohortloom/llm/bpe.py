"""Byte-level BPE by a sentencepiece model written directly from a rank file.

Every token of the vocabulary becomes a piece: its bytes mapped to printable characters, scored by its
negative rank, under identity normalisation. The model's merges then follow the ranks. Pre-tokens are
encoded one by one and remembered; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

CACHE = 300_000
"""Pre-tokens remembered by a task before it starts anew."""


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, x: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(x)) + x


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: piece 0 is unknown, piece r + 1 the token of rank r.

    Ranks must run from 0 without gaps and hold every single byte.
    """
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("every single byte needs a rank")
    letters = byte_letters()
    # Fixed values of the public model format. Piece: 1 text, 2 score, 3 type (2 unknown). Model: 1 piece,
    # 2 trainer, 3 normaliser. Trainer: 3 type (2 BPE), 4 size, 24 no white space split, 41, 42, 43 ids of
    # beginning, end and padding (-1 none). Normaliser: 1 name, 3 dummy prefix, 4 extra spaces, 5 escapes.
    none = (1 << 64) - 1
    out = [_bytes(1, _bytes(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
        text = "".join(map(letters.__getitem__, token)).encode()
        out.append(_bytes(1, _bytes(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    trainer = _number(3, 2) + _number(4, len(ranks) + 1) + _number(24, 0) + _number(41, none) + _number(42, none) + _number(43, none)
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*out, _bytes(2, trainer), _bytes(3, normaliser)])


# Letters, digits and white space of the code points below U+0180.
LETTER, DIGIT, BLANK = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
WIDE = re.compile("[^\x00-ſ]")


def finder(pattern: str):
    """Function that gives a text's pre-tokens.

    For the usual pattern, texts below U+0180 take the same pattern in plain ranges, which is faster.
    """
    import regex

    every = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return every
    latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{BLANK}{LETTER}{DIGIT}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+").findall
    return lambda text: every(text) if WIDE.search(text) else latin(text)


class Codec:
    """Encodes and decodes whole texts; needs no more than the ranks and the pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.find = finder(pattern)
        self.ranks = ranks
        self.token = [t for t, _ in sorted(ranks.items(), key=lambda kv: kv[1])]
        self.letters = str.maketrans({b: c for b, c in enumerate(byte_letters())})
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.find(t) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        fresh = list({m for ms in split for m in ms if m not in known})
        raw = [m.encode("utf-8", "surrogatepass") for m in fresh]
        whole = [self.ranks.get(r) for r in raw]
        rest = [i for i, w in enumerate(whole) if w is None]
        found = self.model.encode([raw[i].decode("latin-1").translate(self.letters) for i in rest], num_threads=1) if rest else []
        for i, ids in zip(rest, found, strict=True):
            known[fresh[i]] = [x - 1 for x in ids]
        for m, w in zip(fresh, whole, strict=True):
            if w is not None:
                known[m] = [w]
        return [list(chain.from_iterable(map(known.__getitem__, ms))) for ms in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def transcoded(docs: DataFrame, content: bytes | None = None, pattern: str | None = None, ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the
    decoded bytes) and, if asked for, ids and decoded. A null text counts as empty: no ids, the digests
    of nothing. Null and repeated ids are rows like any other; other columns are ignored.
    """
    content = content or open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    pattern = pattern or public_tokenizers.PATTERN
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if ids else [])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(content)
        codec = Codec(ranks, pattern)
        names = list(map(str, range(len(ranks))))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo in range(0, len(texts), 200):
                found = codec.encode(texts[lo : lo + 200])
                decoded = [codec.decode(x) for x in found]
                columns = [
                    batch.column(0)[lo : lo + 200],
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(" ".join(map(names.__getitem__, x)).encode()).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                    *([pa.array(found, pa.list_(pa.int32())), pa.array(decoded, pa.binary())] if ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if ids else "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(work, kind)
