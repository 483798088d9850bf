"""Packing: concatenate token streams and cut them into fixed windows.

Two passes. The first tokenises every document once, notes where it starts within its partition and
writes both to the shared folder. The partitions' totals, one number each, give global offsets by a
prefix sum. The second pass reads the tokens and cuts each document at multiples of the window; the
cuts are boundary records, one for each piece.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import normalize

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import kept

WINDOW = 4096
END = 2
CACHE = 600_000
"""Runs remembered by a task before it starts anew."""
SPACES = "\n\t\r\x0b\x0c"
LATIN = "\u0180"
PLAIN = re.compile(r"([^\W\d_]+)([.,;:!?]+)")


class Encoder:
    """Ids of whole texts, each run between ASCII white space encoded once and remembered.

    The tokenizer drops white space and never joins two runs, so a text's ids are those of its runs in
    order. A word with sentence marks behind it is two runs of different kinds, which are remembered
    apart. Latin words need neither normalisation nor a pattern to be split; many of them are encoded in
    one call and told apart by the mark that the last id of a word carries. With ``special`` the names of
    special tokens in a text are their ids, as in the library's plain call; else they are ordinary text.
    """

    def __init__(self, file: str, special: bool = False):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.marks = {name[:1] for name in self.special if not name[:1].isalpha()}
        self.lettered = [name for name in self.special if name[:1] not in self.marks]
        self.latin = Tokenizer.from_file(file)
        self.latin.normalizer = normalizers.Sequence([])
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _named(self, run: str) -> bool:
        """Whether lower case could make the name of a special token of this run. Most runs lack the first mark of one."""
        if not self.lettered and self.marks.isdisjoint(run):
            return False
        return any(name in run.lower() for name in self.special)

    def _learn(self, parts: list[str]) -> None:
        for run, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            self.parts[run] = np.asarray(e.ids, "<u2").tobytes()

    def _learn_latin(self, parts: list[str]) -> None:
        groups = [parts[lo : lo + 500] for lo in range(0, len(parts), 500)]
        for group, e in zip(groups, self.latin.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u2")
            stops = (2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(group):
                self._learn(group)
                continue
            raw, at = ids.tobytes(), 0
            for part, stop in zip(group, stops, strict=True):
                self.parts[part] = raw[at:stop]
                at = stop

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        split = []
        for t in texts:
            t = t or ""
            for space in SPACES:
                if space in t:
                    t = t.replace(space, " ")
            split.append(t.split(" "))
        if len(self.known) > CACHE or len(self.parts) > CACHE:
            self.known, self.parts = {}, {}
        known = self.known
        fresh = set().union(*split).difference(known)
        cut = {}
        for run in fresh:
            if run.isalpha() and not self.lettered:
                cut[run] = (run.lower() if run.isascii() else run,)
            elif m := PLAIN.fullmatch(run):
                word, end = m.groups()
                # Letters that normalisation turns into letters and marks are not cut off from marks behind them.
                whole = not word.isascii() and not normalize("NFC", word).lower().isalpha()
                cut[run] = (run,) if whole else (word.lower() if word.isascii() else word, end)
            else:
                cut[run] = (run.lower() if run.isascii() and not self._named(run) else run,) if run else ()
        parts = set(chain.from_iterable(cut.values())).difference(self.parts)
        latin = [p for p in parts if p.isalpha() and p == p.lower() and max(p) < LATIN]
        self._learn_latin(latin)
        self._learn(list(parts.difference(latin)))
        for run, ps in cut.items():
            known[run] = b"".join(map(self.parts.__getitem__, ps))
        return [b"".join(map(known.__getitem__, runs)) for runs in split]


def padded_length(length: int, window: int = WINDOW) -> int:
    """Length of a sequence with padding: the window, except for one whose own length is a power of two."""
    return length if length and length & (length - 1) == 0 else window


def tokenised(docs: DataFrame, file: str | None = None, end: int = END, special: bool = False) -> DataFrame:
    """(doc_id, part, start, n, ids): ids as 16-bit little-endian numbers, with the end id; written once."""
    file = file or public_tokenizers.path("word_bpe_49k.json")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = Encoder(file, special), TaskContext.get().partitionId(), 0
        stop = np.array([end], "<u2").tobytes()
        for batch in batches:
            docs_, texts = batch.column(0), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 500):
                ids = [x + stop for x in encoder.encode(texts[lo : lo + 500])]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                at = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays([docs_[lo : lo + 500], pa.array([part] * len(ids), pa.int32()), pa.array(at), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "start", "n", "ids"])

    return kept(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(encode, "doc_id long, part int, start long, n long, ids binary"), "tokens")


def pack(docs: DataFrame, window: int = WINDOW, file: str | None = None, end: int = END, special: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` ids without gaps; only the last one may be short.

    Returns doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens,
    sequence_id, offset and padded (length of the sequence with its padding). A null or blank text is
    the end id alone; a null or repeated doc_id is packed like any other row; other columns are ignored;
    an empty table gives no rows. The vocabulary must hold fewer than 65536 ids.
    ``special`` gives names of special tokens in a text their own ids, as the library does by default.
    """
    tokens = tokenised(docs, file, end, special)
    # One number for each partition of the input.
    totals = sorted((r.part, r.n) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before = dict(zip((p for p, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))
    every = sum(n for _, n in totals)
    last, rest = divmod(every, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded"]
        for batch in batches:
            rows = {k: [] for k in names}
            for doc, part, start, n, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                first, whole, done = before[part] + start, np.frombuffer(ids, "<u2").astype("<u4"), 0
                while done < n:
                    sequence, offset = divmod(first + done, window)
                    length = min(n - done, window - offset)
                    fill = rest if sequence == last else window
                    values = (doc, done, length, zlib.crc32(whole[done : done + length].tobytes()), n, sequence, offset, padded_length(fill, window))
                    for k, v in zip(names, values, strict=True):
                        rows[k].append(v)
                    done += length
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, pa.int64()) for k in names]))

    return tokens.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long")
