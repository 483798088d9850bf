"""Language identification by unigram pieces summed over all segmentations.

The pieces come from a public vocabulary. Each language has its own piece probabilities, learnt by
expectation maximisation; a word's probability is the sum over every way to cut it into pieces,
computed by the forward algorithm for many words at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from cohortloom.llm.common import kept

SAMPLE_DOCS = 1000
"""Expected number of training documents for each language; fewer if there are fewer."""
ROUNDS = 3
MOST_LANGUAGES = 1000
RUN = 64
"""Letters of a word; a longer run of letters is cut into words of this length."""
UNKNOWN = 1e-7
MARK = "▁"
UNDETERMINED = "und"
LETTERS = re.compile(rf"[^\W\d_]{{1,{RUN}}}")
CACHE_BYTES = 64 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """Pieces by rolling hash: ``ids`` for the sorted ``keys``, ``maybe`` is a filter by the hash's top bits."""

    keys: np.ndarray
    ids: np.ndarray
    maybe: np.ndarray
    longest: int
    count: int


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, with the mark of a word's start."""
    flat = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(words), -1).astype(np.uint64)


def load_pieces(model_file: str | None = None) -> Pieces:
    """Pieces of letters of a sentencepiece model, with or without the mark in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file or public_tokenizers.path("piece_bpe_32k.model"))
    plain = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    pieces = sorted({p for p in plain if p == MARK or (p.removeprefix(MARK).isalpha() and p == p.lower())})
    keys = np.empty(len(pieces), np.uint64)
    with np.errstate(over="ignore"):
        for i, p in enumerate(pieces):
            h = np.uint64(0)
            for c in p:
                h = (h + np.uint64(ord(c))) * FACTOR
            keys[i] = h
    by = np.argsort(keys)
    maybe = np.zeros(1 << 20, bool)
    maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
    return Pieces(keys[by], by.astype(np.int64), maybe, max(map(len, pieces)), len(pieces))


def _found(pieces: Pieces, codes: np.ndarray) -> list[np.ndarray]:
    """For each piece length, the piece id at every start; ``pieces.count`` where there is none."""
    n, length = codes.shape
    out, h = [], np.zeros((n, length), np.uint64)
    for k in range(1, min(pieces.longest, length) + 1):
        h = (h[:, : length - k + 1] + codes[:, k - 1 :]) * FACTOR
        ids = np.full(h.shape, pieces.count, np.int64)
        at = np.nonzero(pieces.maybe[(h >> np.uint64(44)).astype(np.int64)])
        if len(at[0]):
            seen = h[at]
            where = np.minimum(np.searchsorted(pieces.keys, seen), len(pieces.keys) - 1)
            ids[at] = np.where(pieces.keys[where] == seen, pieces.ids[where], pieces.count)
        out.append(ids)
    return out


def _forward(found: list[np.ndarray], table: np.ndarray, n: int, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums over segmentations of every head, and the logs taken out of them. table: (pieces + 1) x languages."""
    alpha, scale = [np.ones((n, table.shape[1]))], np.zeros((n, table.shape[1]))
    none = len(table) - 1
    for end in range(1, length + 1):
        single = found[0][:, end - 1]
        total = alpha[end - 1] * np.where((single == none)[:, None], UNKNOWN, table[single])
        for k in range(2, min(len(found), end) + 1):
            ids = found[k - 1][:, end - k]
            rows = np.flatnonzero(ids != none)
            if len(rows):
                total[rows] += alpha[end - k][rows] * table[ids[rows]]
        alpha.append(total)
        if end % 16 == 0:
            top = np.maximum(total, 1e-300)
            for k in range(max(0, end - len(found)), end + 1):
                alpha[k] = alpha[k] / top
            scale += np.log(top)
    return alpha, scale


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        for part in np.array_split(at, -(-len(at) // 20000)):
            yield part, [words[i] for i in part]


def log_likelihood(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language, over all its segmentations."""
    out = np.zeros((len(words), table.shape[1]))
    with np.errstate(over="ignore"):
        for at, part in _by_length(words):
            codes = _codes(part)
            alpha, scale = _forward(_found(pieces, codes), table, *codes.shape)
            out[at] = np.log(np.maximum(alpha[-1], 1e-300)) + scale
    return out


def expected_counts(pieces: Pieces, table: np.ndarray, words: list[str], language: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, by forward and backward sums. ``times``: of each word."""
    out = np.zeros((len(table), table.shape[1]))
    with np.errstate(over="ignore"):
        for at, part in _by_length(words):
            codes = _codes(part)
            n, length = codes.shape
            found, lang, none = _found(pieces, codes), language[at], len(table) - 1
            value = [np.where(f == none, UNKNOWN if k == 0 else 0.0, table[f, lang[:, None]]) for k, f in enumerate(found)]
            # Probabilities are raised to about one a letter: factors that cancel in the quotients below.
            lift = np.exp(9.0 * np.arange(1, len(found) + 1))
            value = [v * lift[k] for k, v in enumerate(value)]
            head, tail = np.zeros((length + 1, n)), np.zeros((length + 1, n))
            head[0] = tail[length] = 1
            for end in range(1, length + 1):
                for k in range(1, min(len(found), end) + 1):
                    head[end] += head[end - k] * value[k - 1][:, end - k]
            for start in range(length - 1, -1, -1):
                for k in range(1, min(len(found), length - start) + 1):
                    tail[start] += tail[start + k] * value[k - 1][:, start]
            weight = times[at] / np.maximum(head[length], 1e-300)
            for k, f in enumerate(found, 1):
                for start in range(length - k + 1):
                    rows = np.flatnonzero(f[:, start] != none)
                    use = head[start][rows] * value[k - 1][rows, start] * tail[start + k][rows] * weight[rows]
                    np.add.at(out, (f[rows, start], lang[rows]), use)
    out[-1] = 0
    return out


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    table: np.ndarray
    """Piece probabilities by language; the last row, all zero, stands for no piece."""


def train(docs: DataFrame, pieces: Pieces, learn: Column, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, pseudo: float = 0.1) -> Model:
    """Learn from ``text`` and non-null ``lang`` of the rows where ``learn`` holds.

    About ``sample_docs`` rows of each language, drawn by a hash of the text, give the piece
    probabilities; every labelled row counts for the priors. What comes to the driver is one row for
    each language and the piece counts of the vocabulary. Without labelled rows the model has no language.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    counts = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect())
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [c[0] for c in counts]
    prior = np.array([c[1] for c in counts], float)
    if not languages:
        return Model([], prior, np.zeros((pieces.count + 1, 0)))
    share = {c: min(1.0, sample_docs / n) for c, n in counts}
    rate = F.create_map(*[F.lit(x) for c in languages for x in (c, share[c])])[F.col("lang")]
    sample = rows.filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) < rate * (1 << 30))
    number = {c: i for i, c in enumerate(languages)}

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found: dict[tuple[int, str], int] = {}
            for lang, text in zip(f["lang"], f["text"], strict=True):
                k = number[lang]
                for w in LETTERS.findall((text or "").lower()):
                    found[k, w] = found.get((k, w), 0) + 1
            if found:
                yield pd.DataFrame({"lang": [k for k, _ in found], "word": [w for _, w in found], "times": list(found.values())})

    words = kept(sample.mapInPandas(split, "lang int, word string, times long").groupBy("lang", "word").agg(F.sum("times").alias("times")), "words")
    table = np.full((pieces.count + 1, len(languages)), 1.0 / pieces.count)
    table[-1] = 0
    for _ in range(rounds):
        now = table

        def expect(frames: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            total = np.zeros(now.shape)
            for f in frames:
                total += expected_counts(pieces, now, f["word"].tolist(), f["lang"].to_numpy(), f["times"].to_numpy(float))
            piece, lang = np.nonzero(total)
            if len(piece):
                yield pd.DataFrame({"piece": piece, "lang": lang, "uses": total[piece, lang]})

        summed = words.mapInPandas(expect, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.zeros(table.shape)
        uses[summed["piece"], summed["lang"]] = summed["uses"]
        uses[:-1] += pseudo
        table = uses / uses.sum(axis=0)
    return Model(languages, prior / prior.sum(), table)


def identify(docs: DataFrame, model: Model, pieces: Pieces, text: str = "text") -> DataFrame:
    """Add lang_pred and score, the posterior of that language given every word of the whole text.

    A text that is null or has no letter, and any text under a model without languages, is ``und`` with
    score 0. Columns named lang_pred or score are replaced; all others stay.
    """
    base = docs.drop("lang_pred", "score")
    out = StructType([*base.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    languages, prior, table = model.languages, np.log(np.maximum(model.prior, 1e-12)), model.table
    most = max(1000, CACHE_BYTES // (8 * max(1, len(languages))))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        scores = np.zeros((0, len(languages)))
        for batch in batches:
            names, chances = [], []
            column = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for lo in range(0, len(column), 256):
                split = [LETTERS.findall(t.lower()) if t and languages else [] for t in column[lo : lo + 256]]
                if len(known) > most:
                    known, scores = {}, np.zeros((0, len(languages)))
                fresh = list({w for ws in split for w in ws if w not in known})
                if fresh:
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                    scores = np.concatenate([scores, log_likelihood(pieces, table, fresh)])
                for t, ws in zip(column[lo : lo + 256], split, strict=True):
                    if not ws or not any(map(str.isalpha, t)):
                        names.append(UNDETERMINED)
                        chances.append(0.0)
                        continue
                    total = scores[[known[w] for w in ws]].sum(axis=0) + prior
                    best = int(total.argmax())
                    names.append(languages[best])
                    chances.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(chances, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(label, out)
