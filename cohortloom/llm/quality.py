"""Quality by the votes of nearest labelled neighbours in a latent-semantic space.

A text's terms are hashed words, shapes of tokens, and levels of a few whole-text measures. Their
weights by rarity and a truncated singular value decomposition, both fitted on a bounded sample of
labelled rows, give every text a short unit vector. Every document is compared with every labelled
vector of the sample, exactly and in blocks, and its nearest ones vote with a weight that grows with
their cosine.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

SAMPLE_ROWS = 3000
"""Expected labelled rows of each label in the model; it is sent to every task (about 2 MB)."""
WORDS, SHAPES, LEVELS, MEASURES = 1024, 1024, 12, 8
TERMS = WORDS + SHAPES + LEVELS * MEASURES
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8
"""Power of the cosine in a vote."""
CACHE = 300_000
REPEAT = re.compile(r"(.)\1+")


def shape(token: str) -> str:
    """Letters as A or a, digits as 0, runs of one sign cut to one."""
    out = "".join("0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c for c in token[:64])
    return REPEAT.sub(r"\1", out)


class Terms:
    """Term weights of texts; tokens are remembered with their terms."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.word, self.form = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        if len(self.known) > CACHE:
            self.__init__()
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        code = lambda x, n: zlib.crc32(x.encode("utf-8", "surrogatepass")) % n
        self.word = np.r_[self.word, np.array([code(t.lower(), WORDS) for t in fresh], np.int64)]
        self.form = np.r_[self.form, np.array([WORDS + code(shape(t), SHAPES) for t in fresh], np.int64)]

    def weights(self, texts: list[str | None]) -> np.ndarray:
        """One row for each text: square roots of term shares, so that a small part of a text still shows."""
        split = [(t or "").split() for t in texts]
        if len(self.known) > CACHE:
            self.__init__()
        fresh = list({w for ws in split for w in ws if w not in self.known})
        if fresh:
            self._learn(fresh)
        out = np.zeros((len(texts), TERMS), np.float32)
        for i, (t, ws) in enumerate(zip(texts, split, strict=True)):
            if not ws:
                continue
            at = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
            count = np.bincount(self.word[at], minlength=TERMS) + np.bincount(self.form[at], minlength=TERMS)
            out[i] = np.sqrt(count / len(ws))
            lines = t.split("\n")
            different = len(np.unique(at)) / len(ws)
            repeats = float((at[1:] == at[:-1]).mean()) if len(ws) > 1 else 0.0
            measures = (
                np.log2(len(ws)) / 16,
                different,
                repeats,
                len(set(lines)) / len(lines),
                min(1.0, len(t) / len(ws) / 20),
                min(1.0, np.log2(len(ws) / len(lines) + 1) / 8),
                min(1.0, 4 * sum(map(t.count, "!?|*%#&$@")) / len(t)),
                min(1.0, np.bincount(at - at.min()).max() / len(ws) * 2),
            )
            for k, m in enumerate(measures):
                place = float(np.clip(m, 0, 1)) * (LEVELS - 1)
                low = int(place)
                base = WORDS + SHAPES + k * LEVELS
                out[i, base + low] += 1 - (place - low)
                if low + 1 < LEVELS:
                    out[i, base + low + 1] += place - low
        return out


@dataclass
class Model:
    projection: np.ndarray
    """Terms x dimensions, with the rarity weights in it."""
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    """Rows of its label for each sampled row."""

    @property
    def prior(self) -> float:
        return float(self.weights @ self.labels / self.weights.sum()) if len(self.labels) else 0.5

    def embed(self, terms: np.ndarray) -> np.ndarray:
        x = terms @ self.projection
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Share of the neighbours' votes that are for label 1; the prior where nothing is near."""
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        x, k = self.embed(terms), min(NEIGHBOURS, len(self.labels))
        cosine = x @ self.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.clip(np.take_along_axis(cosine, near, axis=1), 0, None).astype(np.float64) ** SHARPNESS * self.weights[near]
        total = vote.sum(axis=1)
        return np.divide((vote * self.labels[near]).sum(axis=1), total, out=np.full(len(terms), self.prior), where=total > 0)


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows of ``labels`` (doc_id and a 0/1 column) where ``learn`` holds, joined with their texts.

    About ``sample_rows`` rows of each label, drawn by a hash of the id, enter the model; votes are weighted
    so that it counts the labels as the whole table does. Repeated labels of an id are averaged; null ids and
    labels are left out. Without any labelled row the model scores everything 0.5.
    """
    known = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    known = known.select("doc_id", (F.col("y") >= 0.5).cast("int").alias("y"))
    number = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, sample_rows / n) for y, n in number.items()}
    rate = F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < rate * (1 << 30))
    # Bounded by about twice `sample_rows` numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Terms()
        for batch in batches:
            x = made.weights(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "y": batch.column("y"), "at": pa.array([np.flatnonzero(r).astype(np.int32) for r in x], pa.list_(pa.int32())), "x": pa.array([r[r > 0] for r in x], pa.list_(pa.float32()))})

    found = rows.mapInArrow(terms, "doc_id long, y int, at array<int>, x array<float>").toArrow().sort_by("doc_id")
    n = found.num_rows
    if not n:
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0))
    x = np.zeros((n, TERMS), np.float32)
    at, value = found.column("at").combine_chunks(), found.column("x").combine_chunks()
    x[np.repeat(np.arange(n), np.diff(at.offsets.to_numpy())), at.values.to_numpy()] = value.values.to_numpy()
    y = found.column("y").to_numpy().astype(float)
    rarity = np.log((1 + n) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    x *= rarity
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    keep = vectors[:, np.argsort(-values)[: min(DIMENSIONS, n)]].astype(np.float32)
    model = Model(rarity[:, None] * keep, np.zeros((0, 1), np.float32), y, np.array([number[int(v)] / max(1, (y == v).sum()) for v in y]))
    model.vectors = model.embed(x / rarity)
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score (0 to 1, higher: label 1 likelier) from the whole text; null and blank texts get the prior.

    A column named score is replaced; all others stay.
    """
    base = docs.drop("score")
    at = base.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Terms()
        for batch in batches:
            texts, out = batch.column(at).to_pylist(), []
            for lo in range(0, len(texts), 256):
                out += model.score(made.weights(texts[lo : lo + 256])).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "score"])

    return base.mapInArrow(add, StructType([*base.schema.fields]).add("score", DoubleType()))
