"""Source divergence audit: how the word use of every source departs from the other sources of its language.

1. Exact frequency filter: the documents of each (language, term) are counted; terms in ``LEAST_DOCS`` stay.
2. The kept terms are dealt to shards of about ``SHARD_TERMS`` terms. Each shard is a minimal perfect hash, built in
   a task, with the terms themselves stored at their slots.
3. Recount: the shards are broadcast, ``ROUND_BYTES`` at a time, and the documents are read again. A term's slot counts
   only if the stored key is the term. Tasks increment dense slots of each (language, source) and hand on those used.
4. The slots of a group are summed shard by shard. Sources of a language meet in blocks of ``BLOCK`` within a shard, so
   a task holds two blocks of dense counts, however many sources, documents or terms there are.

All numbers are integers. Null text, language and source count as empty text. Every row of the table is a document of
its own, repeated ids and texts included; a document without terms only makes its group occur. A group whose language
keeps no term has pairs of value 0 and no terms. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.llm.common import FACTOR, _mix, kept

LEAST_DOCS = 3
TOP_TERMS = 200
SHARD_TERMS = 1 << 15
ROUND_BYTES = 64 << 20
"""Shards sent to the tasks at once; the documents are read once for each such round."""
BLOCK = 32
"""Sources of a language in one block."""
HELD_TERMS = 1 << 19
"""Different terms that a task holds before it hands them on."""
SLOT_BYTES = 128 << 20
"""Dense slots that a task holds before it hands them on."""
SLICE = 1 << 20
LEVELS = 24

TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
"""A-Z lower-cased; all but letters and the bytes of other characters are white space."""


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, about a million bytes at a time."""
    low, start = raw.translate(TERMS), 0
    while start < len(low):
        stop = low.find(b" ", start + SLICE)
        stop = len(low) if stop < 0 else stop
        yield low[start:stop].split()
        start = stop


class PerfectHash:
    """Minimal perfect hash of distinct keys by levels of bits: a key alone in its place takes it, the others go on.

    A key's slot is the number of taken places before its own. Keys that share a place on every level follow as a list.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, keys: pa.Array):
        self.words, self.keys = words, keys
        self.levels = list(zip(sizes.tolist(), (np.cumsum(sizes) - sizes).tolist(), strict=True))
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))]
        placed = int(self.before[-1])
        self.rest = {k: placed + i for i, k in enumerate(keys.slice(placed).to_pylist())}

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(h[:, 0] + h[:, 1] * np.uint64(2 * level + 1) + np.uint64(level * FACTOR & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        h, left = cls._hashes(keys), np.arange(len(keys))
        sizes, words, order = [], [], []
        while len(left) and len(sizes) < LEVELS:
            size = (len(left) * 3 // 2 // 64 + 1) * 64
            at = cls._place(h[left], len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            order.append(left[alone][np.argsort(at[alone])])
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone]
        stored = [keys[i] for i in np.concatenate([*order, left]).tolist()]
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, "<u8"), *words]), pa.array(stored, pa.binary()))

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """Slot of each key, -1 for a key that is not stored."""
        h, slot, todo = self._hashes(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, base) in enumerate(self.levels):
            if not len(todo):
                break
            at = self._place(h[todo], level, size) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            lower = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            slot[todo[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(lower)
            todo = todo[~hit]
        if self.rest:
            for i in todo.tolist():
                slot[i] = self.rest.get(keys[i], -1)
        found = np.flatnonzero(slot >= 0)
        stored = self.keys.take(pa.array(slot[found]))
        asked = pa.array(keys, pa.binary()).take(pa.array(found))
        slot[found[~pc.equal(stored, asked).to_numpy(zero_copy_only=False)]] = -1
        return slot


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of string columns, with the text, if it is last, as bytes."""
    columns = [batch.column(n).cast(pa.large_string()) for n in names]
    return zip(*(c.cast(pa.large_binary()).to_pylist() if n == "text" else c.to_pylist() for n, c in zip(names, columns, strict=True)), strict=True)


def _doc_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "term", "docs"]
            )
        found.clear()

    for batch in batches:
        for lang, text in _columns(batch, "lang", "text"):
            counter = found.setdefault(lang, Counter())
            parts = list(map(set, terms_of(text)))
            counter.update(parts[0] if len(parts) == 1 else set().union(*parts))
            if sum(map(len, found.values())) > HELD_TERMS:
                yield from out()
    yield from out()


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term) of the terms in at least ``least`` documents of a language."""
    counted = _plain(docs).select("lang", "text").mapInArrow(_doc_counts, "lang string, term string, docs long")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term")


def _build(table: pa.Table) -> pa.Table:
    made = PerfectHash.build(table.column("term").cast(pa.binary()).to_pylist())
    return pa.table(
        {
            "lang": table.column("lang").slice(0, 1),
            "shard": table.column("shard").slice(0, 1),
            "shards": table.column("shards").slice(0, 1),
            "sizes": pa.array([[s for s, _ in made.levels]], pa.list_(pa.int64())),
            "words": pa.array([made.words.tobytes()], pa.binary()),
            "keys": pa.array([made.keys.to_pylist()], pa.list_(pa.binary())),
            "size": pa.array([len(made.keys)], pa.int64()),
            "bytes": pa.array([made.words.nbytes + made.keys.nbytes], pa.int64()),
        }
    )


def _shards(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One perfect hash for each shard of a language's terms."""
    dealt = terms.join(vocabulary, "lang").withColumn("shards", F.ceil(F.col("v") / SHARD_TERMS).cast("long"))
    dealt = dealt.select("lang", "term", "shards", (F.crc32(F.col("term").cast("binary")) % F.col("shards")).alias("shard"))
    schema = "lang string, shard long, shards long, sizes array<bigint>, words binary, keys array<binary>, size long, bytes long"
    return dealt.groupBy("lang", "shard").applyInArrow(_build, schema)


COUNTS = "lang string, source string, shard long, slots array<int>, counts array<bigint>"


def _rows(found: dict[tuple, np.ndarray], names: tuple[str, ...]) -> pa.RecordBatch:
    """The slots in use of each dense array."""
    used = [np.flatnonzero(a) for a in found.values()]
    keys = [pa.array([k[i] for k in found], pa.int64() if n == "shard" else pa.string()) for i, n in enumerate(names)]
    ends = pa.array(np.r_[0, np.cumsum([len(u) for u in used])].astype(np.int32))
    slots = np.concatenate([np.zeros(0, np.int32), *(u.astype(np.int32) for u in used)])
    counts = np.concatenate([np.zeros(0, np.int64), *(a[u] for a, u in zip(found.values(), used, strict=True))])
    return pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(ends, pa.array(slots)), pa.ListArray.from_arrays(ends, pa.array(counts))], [*names, "slots", "counts"])


def _recount(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counter of the terms whose shards ``shared`` carries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, shards = {}, {}
        for part in shared.value.to_batches():
            for i in range(part.num_rows):
                at = {n: part.column(n)[i] for n in ("lang", "shard", "shards", "sizes", "words", "keys")}
                lang = at["lang"].as_py()
                shards[lang] = at["shards"].as_py()
                sizes = at["sizes"].values.to_numpy(zero_copy_only=False)
                hashes[lang, at["shard"].as_py()] = PerfectHash(sizes, np.frombuffer(at["words"].as_buffer(), "<u8"), at["keys"].values)
        held: dict[tuple[str, str], Counter] = {}
        dense: dict[tuple[str, str, int], np.ndarray] = {}

        def resolve() -> Iterator[pa.RecordBatch]:
            for (lang, source), counter in held.items():
                terms, counts = list(counter), np.fromiter(counter.values(), np.int64, len(counter))
                shard = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % shards[lang]
                for s in np.unique(shard).tolist():
                    if (lang, s) in hashes:
                        mine = np.flatnonzero(shard == s)
                        slots = hashes[lang, s].slots([terms[i] for i in mine.tolist()])
                        if (lang, source, s) not in dense:
                            dense[lang, source, s] = np.zeros(len(hashes[lang, s].keys), np.int64)
                        dense[lang, source, s][slots[slots >= 0]] += counts[mine[slots >= 0]]
                if sum(a.nbytes for a in dense.values()) > SLOT_BYTES:
                    yield _rows(dense, ("lang", "source", "shard"))
                    dense.clear()
            held.clear()

        for batch in batches:
            for lang, source, text in _columns(batch, "lang", "source", "text"):
                if lang in shards:
                    counter = held.setdefault((lang, source), Counter())
                    for found in terms_of(text):
                        counter.update(found)
                        if sum(map(len, held.values())) > HELD_TERMS:
                            yield from resolve()
                            counter = held.setdefault((lang, source), Counter())
        yield from resolve()
        if dense:
            yield _rows(dense, ("lang", "source", "shard"))

    return count


def _summed(counts: DataFrame, *names: str) -> DataFrame:
    """Sums of the slots of each key; a task reads its keys in order and holds the slots of one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(0, np.int64)
        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            for i, k in enumerate(keys):
                if k != key:
                    if key is not None:
                        yield _rows({key: total}, names)
                    key, total = k, np.zeros(0, np.int64)
                slots = batch.column("slots")[i].values.to_numpy()
                if len(slots):
                    total = np.pad(total, (0, max(0, int(slots.max()) + 1 - len(total))))
                    total[slots] += batch.column("counts")[i].values.to_numpy()
        if key is not None:
            yield _rows({key: total}, names)

    schema = ", ".join(part for part in COUNTS.split(", ") if part.split()[0] in (*names, "slots", "counts"))
    return counts.select(*names, "slots", "counts").repartition(*names).sortWithinPartitions(*names).mapInArrow(add, schema)


def shares(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """``1 + floor(10^9 (count + 1) / (n + v))`` by three long-division steps, exact to 9 * 10^15 occurrences."""
    left, whole, total = count + 1, 0, n + v
    for _ in range(3):
        left = left * 1000
        whole, left = whole * 1000 + left // total, left % total
    return 1 + whole


def departure(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _dense(table: pa.Table, size: int) -> np.ndarray:
    out = np.zeros((table.num_rows, size), np.int64)
    for i in range(table.num_rows):
        slots = table.column("slots")[i]
        if slots.is_valid:
            out[i, slots.values.to_numpy()] = table.column("counts")[i].values.to_numpy()
    return out


def _compare(top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Partial pair sums of two blocks of sources in a shard; of a block with itself also its leading terms."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        size, v = left.column("size")[0].as_py(), left.column("v")[0].as_py()
        source, block = left.column("source").to_pylist(), left.column("block").to_numpy()
        count = _dense(left, size)
        p = shares(count, left.column("n").to_numpy()[:, None], v)
        lo, hi = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        out: list[tuple[str, str, str, int]] = []
        for a in lo.tolist():
            ahead = departure(p[a], p[hi]).sum(1)
            back = departure(p[hi], p[a]).sum(1)
            for k, b in enumerate(hi.tolist()):
                if a != b:
                    out.append(("pair", source[a], source[b], int(ahead[k])))
                    if block[a] != block[b]:
                        out.append(("pair", source[b], source[a], int(back[k])))
        if right.num_rows:
            keys = right.column("keys")[0].values
            q = shares(_dense(right, size)[0], np.int64(left.column("n_lang")[0].as_py()), v)
            for a in lo.tolist():
                ahead = np.flatnonzero((count[a] > 0) & (p[a] > q))
                value = departure(p[a][ahead], q[ahead])
                if len(ahead) > top:
                    least = np.partition(value, len(value) - top)[len(value) - top]
                    ahead, value = ahead[value >= least], value[value >= least]
                best = sorted(zip((-value).tolist(), keys.take(pa.array(ahead)).to_pylist(), strict=True))[:top]
                out.extend(("term", source[a], term.decode(), -f) for f, term in best)
        part, one, item, value = zip(*out, strict=True) if out else ((), (), (), ())
        lang = pa.array([left.column("lang")[0].as_py()] * len(out), pa.string())
        return pa.table({"lang": lang, "source": pa.array(one, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return compare


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group: ``pair`` with other sources, ``term`` above its language."""
    spark = docs.sparkSession
    plain = _plain(docs)
    terms = kept(kept_terms(docs, least), "terms")
    vocabulary = kept(terms.groupBy("lang").agg(F.count("*").alias("v")), "vocabulary")
    shards = kept(_shards(terms, vocabulary), "shards")
    groups = kept(plain.select("lang", "source").distinct(), "groups")

    rounds, room = [], 0
    for r in shards.select("lang", "shard", "bytes").sort("lang", "shard").toLocalIterator():
        if not rounds or r.bytes > room:
            rounds.append([(r.lang, r.shard), None])
            room = ROUND_BYTES
        rounds[-1][1], room = (r.lang, r.shard), room - r.bytes
    counted = spark.createDataFrame([], COUNTS)
    for first, last in rounds:
        here = F.struct("lang", "shard")
        low, high = (F.struct(F.lit(lang).alias("lang"), F.lit(shard).cast("long").alias("shard")) for lang, shard in (first, last))
        mine = shards.filter((here >= low) & (here <= high))
        shared = spark.sparkContext.broadcast(mine.select("lang", "shard", "shards", "sizes", "words", "keys").toArrow())
        counted = counted.union(kept(plain.mapInArrow(_recount(shared), COUNTS), "recount"))
        shared.unpersist()
    counts = kept(_summed(counted, "lang", "source", "shard"), "counts")

    own = counts.groupBy("lang", "source").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    every = own.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    sized = groups.join(own, ["lang", "source"], "left").join(every, "lang", "left").join(vocabulary, "lang")
    sized = sized.na.fill(0, ["n", "n_lang"]).withColumn("block", F.floor((place - 1) / BLOCK).cast("long"))
    sized = kept(sized.withColumn("last", F.max("block").over(Window.partitionBy("lang"))), "groups")

    dense = sized.join(shards.select("lang", "shard", "size"), "lang").join(counts, ["lang", "source", "shard"], "left")
    met = dense.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    met = met.select("lang", "shard", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "source", "block", "n", "n_lang", "v", "size", "slots", "counts")
    blocks = sized.select("lang", F.col("block").alias("lo")).distinct()
    whole = shards.select("lang", "shard", "keys").join(_summed(counts, "lang", "shard"), ["lang", "shard"], "left").join(blocks, "lang")
    whole = whole.select(*(F.col(a).alias(b) for a, b in (("lang", "lang"), ("shard", "shard"), ("lo", "lo"), ("lo", "hi"))), "keys", "slots", "counts")
    keys = ["lang", "shard", "lo", "hi"]
    found = kept(met.groupBy(*keys).cogroup(whole.groupBy(*keys)).applyInArrow(_compare(top), "lang string, source string, part string, item string, value long"), "compared")

    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    sums = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    leading = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(leading)
