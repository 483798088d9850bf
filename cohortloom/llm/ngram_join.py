"""Jaccard join of word shingle sets by vertical partitioning.

The shingles have one global order, rare ones first. The order is cut into fragments; a set's part
in a fragment is a segment. Overlaps are counted fragment by fragment and summed for each pair.

1. One pass over the texts counts shingles in a fixed number of cells and notes each set's signature and
   sketch, its shingles counted in buckets. Equal sets are one node from here on. The cells only decide the
   order, so shared cells cost time, not results.
2. A pair that links must share a shingle among the first |x| - ceil(t |x|) + 1 of either set. Those
   prefixes go to their fragments, where shingles of a single set fall away.
3. In each list of sets that share a prefix shingle, every set is compared with one hub, the set of
   most common shingles: partial overlaps by fragment, summed for each pair.
4. Sets of one list that the hubs have not joined are compared with each other, in blocks, lists with
   the same smallest set together. A block pair gets whole sets, counts overlaps by ranges of their hashes
   and returns a spanning forest of its links.

Steps 3 and 4 look at sketches first. Two sketches bound the overlap of their sets from above, so a pair whose
bound is too small cannot link; only the sets of the other pairs are made again from their texts and travel.

Nothing is capped: a shingle in a third of all texts only makes more block pairs. The work of step 4
grows with the square of the number of different, unjoined sets in a list.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.llm.common import Shingler, components, discard, kept, sweep
from cohortloom.session import parallelism

CELLS = 1 << 24
"""Counting cells: 16 MB when sent to the tasks, at any size of the corpus."""
PART = 1 << 16
ENTRIES = 1 << 20
"""Prefix entries meant for one fragment."""
HOT = 4 * 18
"""Level of a cell with 2^18 occurrences."""
SEEN = 1 << 20
"""Shingles that a task holds before it counts them."""
VERIFY = 8
"""Cuts of the order when overlaps are counted."""
BLOCK = 256
"""Sets on each side of a block pair."""
BITS = 1 << 26
"""Bits that mark the documents whose sets are needed: 8 MB when sent to the tasks, at any size of the corpus."""


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _cell(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes & (cells - 1)).astype(np.int64)


def _add(total: np.ndarray, seen: list[np.ndarray]) -> None:
    at, times = np.unique(np.concatenate([np.zeros(0, np.int64), *seen]), return_counts=True)
    total[at] += times.astype(np.uint32)


def _count(n: int, cells: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shingler = np.zeros(cells, np.uint32), Shingler(n)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("sketch", pa.binary()), ("block", pa.int32()), ("salt", pa.int32()), ("data", pa.binary())])
        for batch in batches:
            size, node, sketch, seen, held = [], [], [], [], 0
            for s in shingler.sets(batch.column("text")):
                size.append(len(s))
                node.append(_node(s))
                sketch.append(_sketch(s))
                seen.append(_cell(s, cells))
                held += len(s)
                if held > SEEN:
                    _add(total, seen)
                    seen, held = [], 0
            _add(total, seen)
            k = len(size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(sketch, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        salt = TaskContext.get().partitionId() // 32  # counts of 32 tasks are added first
        for b in range(cells // PART):
            part = total[b * PART : (b + 1) * PART]
            if part.any():
                part = part.astype(np.uint8) if part.max() < 256 else part
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([b], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], schema=schema)

    return count


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts in quarter octaves."""
    return np.ceil(4 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
            held.setdefault(b, np.zeros(PART, np.uint64))
            raw = zlib.decompress(data)
            held[b] += np.frombuffer(raw, {PART: np.uint8, 4 * PART: np.uint32, 8 * PART: np.uint64}[len(raw)])
    for b, x in held.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "data": pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())})


def _level_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of cells as levels, with the occurrences of each level."""
    for batch in _add_cells(batches):
        counts = np.frombuffer(zlib.decompress(batch.column("data")[0].as_py()), np.uint64)
        level = _levels(counts)
        load = np.bincount(level, weights=counts.astype(np.float64), minlength=256)
        yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "data": pa.array([level.tobytes()], pa.binary()), "load": pa.array([load.tolist()], pa.list_(pa.float64()))})


class Order:
    """Global order of shingles: by the level of their cell's count, then by hash."""

    def __init__(self, level: np.ndarray, load: np.ndarray):
        self.cells, self.level, self.load = len(level), level, load
        self.total = float(load.sum())
        self.before = np.r_[0, np.cumsum(load)[:-1]]

    def rank(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level = self.level[_cell(hashes, self.cells)]
        return np.lexsort((hashes, level)), level

    def fragment(self, hashes: np.ndarray, level: np.ndarray, cuts: int) -> np.ndarray:
        """Cut number: about equal shares of all occurrences, in the order."""
        if not self.total:
            return np.zeros(len(hashes), np.int32)
        within = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
        return np.minimum((self.before[level] + within * self.load[level]) * (cuts / self.total), cuts - 1).astype(np.int32)


def _order(counted: DataFrame, cells: int) -> Order:
    """The cells' levels; what reaches the driver is one byte for each cell."""
    parts = counted.filter("block is not null").select("block", "salt", "data")
    once = parts.repartition("block", "salt").select("block", "data").mapInArrow(_add_cells, "block int, data binary")
    level, load = np.zeros(cells, np.uint8), np.zeros(256)
    for row in once.repartition("block").mapInArrow(_level_cells, "block int, data binary, load array<double>").collect():
        level[row.block * PART : (row.block + 1) * PART] = np.frombuffer(row.data, np.uint8)
        load += np.array(row.load)
    return Order(level, load)


def _least(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _node(s: np.ndarray) -> bytes:
    """Signature of a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(s: np.ndarray) -> bytes:
    """Shingles counted in a power of two of buckets, two to four in each; nothing if a count outgrows its byte."""
    buckets = 1 << max(5, (-(-len(s) // 4) - 1).bit_length())
    counts = np.bincount((s >> 32) & (buckets - 1), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _folded(sketches: list[bytes], buckets: int) -> np.ndarray:
    """Sketches of one size as rows of so many buckets, their own number or fewer."""
    rows = np.frombuffer(b"".join(sketches), np.uint8)
    return rows.reshape(len(sketches), -1, buckets).sum(axis=1, dtype=np.uint32)


def _reaches(x: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the other sets a set of ``n`` shingles can link with, as far as sketches tell."""
    bound = np.minimum(x, others).sum(axis=1, dtype=np.int64)
    return 100 * bound >= percent * (n + sizes - bound)


def _possible(percent: int):
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose sketches do not rule out a link."""
        for batch in batches:
            keep = []
            for x, n, y, m in zip(*(batch.column(c).to_pylist() for c in ("sketch_a", "na", "sketch_b", "nb")), strict=True):
                buckets = min(len(x), len(y))
                keep.append(not buckets or bool(_reaches(_folded([x], buckets), n, _folded([y], buckets), np.array([m]), percent)[0]))
            yield batch.select(["a", "na", "b", "nb"]).filter(pa.array(keep, pa.bool_()))

    return possible


def _hopeful(percent: int):
    def hopeful(table: pa.Table) -> pa.Table:
        """Sets of a block pair that can link with a set of another component across it, as far as sketches tell."""
        sketch, n, side = table.column("sketch").to_pylist(), table.column("n").to_numpy(), table.column("side").to_numpy()
        codes: dict[bytes, int] = {}
        comp = np.array([codes.setdefault(c, len(codes)) for c in table.column("comp").to_pylist()])
        width = np.array([len(x) for x in sketch])
        keep = np.zeros(len(sketch), bool)
        widths = np.unique(width).tolist()
        for w in widths:
            rows = np.flatnonzero((width == w) & (side != 1))
            for v in widths:
                columns = np.flatnonzero((width == v) & (side != 0))
                near = comp[rows][:, None] != comp[columns][None, :]
                near &= 100 * np.minimum.outer(n[rows], n[columns]) >= percent * np.maximum.outer(n[rows], n[columns])
                if not near.any():
                    continue
                if buckets := min(w, v):
                    x, y = (_folded([sketch[k] for k in own], buckets) for own in (rows, columns))
                    for i in np.flatnonzero(near.any(axis=1)):
                        j = np.flatnonzero(near[i])
                        near[i, j] = _reaches(x[i], n[rows[i]], y[j], n[columns[j]], percent)
                keep[rows[near.any(axis=1)]] = True
                keep[columns[near.any(axis=0)]] = True
        return table.drop_columns(["sketch"]).filter(pa.array(keep))

    return hopeful


def _prefixes(n: int, order: Order, cuts: int, percent: int):
    """Packs of prefix entries: one row for a fragment and a batch.

    Shingles of hot cells are dealt out by node as well, so that no task gets all their entries.
    """
    schema = pa.schema([("route", pa.int64()), ("known", pa.bool_()), ("grams", pa.binary()), ("owner", pa.binary()), ("nodes", pa.binary()), ("facts", pa.binary())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            grams, owner, route, nodes, facts = [], [], [], [], []
            for s in shingler.sets(batch.column("text")):
                if not len(s):
                    continue
                at, level = order.rank(s)
                first = at[: len(s) - _least(len(s), percent) + 1]
                f = order.fragment(s[first], level[first], cuts).astype(np.int64)
                node = _node(s)
                grams.append(s[first])
                owner.append(np.full(len(first), len(nodes), np.int32))
                route.append(np.where(level[first] >= HOT, -1 - (f * 64 + node[0] % 64), f))
                nodes.append(node)
                facts.append((len(s), float(level.mean())))
            if not nodes:
                continue
            grams, owner, route = np.concatenate(grams), np.concatenate(owner), np.concatenate(route)
            table, facts = np.frombuffer(b"".join(nodes), "V16"), np.array(facts, np.float64)
            by = np.argsort(route, kind="stable")
            edge = np.flatnonzero(np.r_[True, route[by][1:] != route[by][:-1], True])
            rows = {k: [] for k in schema.names}
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                i = by[a:b]
                used, local = np.unique(owner[i], return_inverse=True)
                rows["route"].append(int(route[i[0]]))
                rows["known"].append(bool(route[i[0]] < 0))
                rows["grams"].append(grams[i].tobytes())
                rows["owner"].append(local.astype(np.int32).tobytes())
                rows["nodes"].append(table[used].tobytes())
                rows["facts"].append(facts[used].tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return prefixes


def _postings(table: pa.Table) -> pa.Table:
    """Entries of one fragment whose shingle more than one node holds; copies of a node count once."""
    grams, owner, nodes, facts, base = [], [], [], [], 0
    for g, o, t, f in zip(*(table.column(c).to_pylist() for c in ("grams", "owner", "nodes", "facts")), strict=True):
        grams.append(np.frombuffer(g, np.int64))
        owner.append(np.frombuffer(o, np.int32).astype(np.int64) + base)
        nodes.append(np.frombuffer(t, "S16"))
        facts.append(np.frombuffer(f, np.float64).reshape(-1, 2))
        base += len(nodes[-1])
    grams, owner, nodes, facts = (np.concatenate(x) for x in (grams, owner, nodes, facts))
    _, first, same = np.unique(nodes, return_index=True, return_inverse=True)
    owner = first[same.ravel()[owner]]
    by = np.lexsort((owner, grams))
    grams, owner = grams[by], owner[by]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[new], owner[new]
    _, where, times = np.unique(grams, return_inverse=True, return_counts=True)
    keep = (times[where] > 1) | bool(table.column("known")[0].as_py())
    grams, owner = grams[keep], owner[keep]
    return pa.table({"gram": pa.array(grams, pa.int64()), "node": pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(owner), [None, pa.py_buffer(nodes[owner].tobytes())]).cast(pa.binary()), "n": pa.array(facts[owner, 0].astype(np.int64)), "common": pa.array(facts[owner, 1])})


def _cut_texts(n: int, order: Order, cuts: int, marks: np.ndarray):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((marks[bit >> 3] >> (bit & 7) & 1).astype(bool)))
            rows = {"node": [], "fragment": [], "segment": []}
            for s in shingler.sets(batch.column("text")):
                node = _node(s)
                f = order.fragment(s, order.level[_cell(s, order.cells)], cuts)
                for k in np.unique(f):
                    rows["node"].append(node)
                    rows["fragment"].append(int(k))
                    rows["segment"].append(s[f == k].tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("node", pa.binary()), ("fragment", pa.int32()), ("segment", pa.binary())]))

    return segments


def _segments(docs: DataFrame, nodes: DataFrame, found: DataFrame, n: int, order: Order, cuts: int) -> DataFrame:
    """Segments of the nodes, each from one document's text, and of the few sets whose documents share a mark with those."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    ids = found.join(nodes.hint("merge"), "node", "left_semi").select((bit + 1).alias("at"))
    marks = np.zeros(BITS // 8, np.uint8)
    marked = ids.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    for row in marked.collect():
        part = np.frombuffer(row.bits, np.uint8)
        marks[(row.bucket - 1) * len(part) : row.bucket * len(part)] = part
    texts = _texts(docs).filter("doc_id is not null").withColumn("bit", bit)
    return kept(texts.mapInArrow(_cut_texts(n, order, cuts, marks), "node binary, fragment int, segment binary"), "segments")


def _partial(left: pa.Table, right: pa.Table) -> pa.Table:
    """Overlaps of the pairs of one group within one fragment."""
    sets = {n: np.frombuffer(s, np.int64) for n, s in zip(left.column("node").to_pylist(), left.column("segment").to_pylist(), strict=True)}
    a, b = right.column("a").to_pylist(), right.column("b").to_pylist()
    none = np.zeros(0, np.int64)
    overlap = [len(np.intersect1d(sets.get(x, none), sets.get(y, none), assume_unique=True)) for x, y in zip(a, b, strict=True)]
    some = [i for i, x in enumerate(overlap) if x]
    return pa.table({"a": pa.array([a[i] for i in some], pa.binary()), "b": pa.array([b[i] for i in some], pa.binary()), "overlap": pa.array([overlap[i] for i in some], pa.int64())})


def _linked(pairs: DataFrame, segments: DataFrame, cuts: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link, from partial overlaps by fragment. pairs: a, na, b, nb; b is a hub."""
    groups = max(parallelism(pairs), pairs.count() // 2048)
    share = F.pmod(F.xxhash64("a"), F.greatest(F.lit(1), F.ceil(F.col("times") / 4096)))
    many = pairs.groupBy("b").agg(F.count("*").alias("times"))
    placed = kept(pairs.join(many.hint("merge"), "b").withColumn("g", F.pmod(F.xxhash64("b", share), F.lit(groups))), "placed")
    needed = placed.select(F.col("a").alias("node"), "g").union(placed.select("b", "g")).distinct()
    left = needed.join(segments.hint("merge"), "node").select("g", "fragment", "node", "segment")
    right = placed.select("a", "b", F.col("g").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("cut"))
    counted = left.groupBy("g", "fragment").cogroup(right.groupBy("group", "cut")).applyInArrow(_partial, "a binary, b binary, overlap long")
    summed = counted.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    links = summed.join(placed.hint("merge"), ["a", "b"]).filter(F.col("overlap") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")
    links = kept(links, "links")
    discard(placed)
    return links


def _forest(cuts: int, percent: int):
    def forest(table: pa.Table) -> pa.Table:
        """Links between different components within one block pair, as a spanning forest."""
        nodes = table.column("node").to_pylist()
        comp, side, n = table.column("comp").to_pylist(), table.column("side").to_pylist(), np.array(table.column("n").to_pylist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("segment").to_pylist()]
        ids = {x: k for k, x in enumerate(dict.fromkeys(nodes))}
        own = np.array([ids[x] for x in nodes])
        size, group, left, right = np.zeros(len(ids), np.int64), [None] * len(ids), np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        for k, c, s, m in zip(own, comp, side, n, strict=True):
            size[k], group[k] = m, c
            left[k] |= s in (0, 2)
            right[k] |= s in (1, 2)
        rows, columns = np.flatnonzero(left), np.flatnonzero(right)
        at_row, at_column = np.full(len(ids), -1), np.full(len(ids), -1)
        at_row[rows], at_column[columns] = np.arange(len(rows)), np.arange(len(columns))
        overlap = np.zeros((len(rows), len(columns)), np.int64)
        marks = np.array([(k << 64) // cuts for k in range(1, cuts)], np.uint64)
        ends = np.array([[0, *np.searchsorted(x, marks), len(x)] for x in sets])
        for f in range(cuts):
            grams = np.concatenate([x[a:b] for x, a, b in zip(sets, ends[:, f], ends[:, f + 1], strict=True)])
            who = np.repeat(own, ends[:, f + 1] - ends[:, f])
            by = np.argsort(grams, kind="stable")
            grams, who = grams[by], who[by]
            edge = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1], True])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a > 1:
                    w = who[a:b]
                    r, c = at_row[w], at_column[w]
                    overlap[np.ix_(r[r >= 0], c[c >= 0])] += 1
        union = size[rows][:, None] + size[columns][None, :] - overlap
        x, y = np.nonzero((100 * overlap >= percent * union) & (overlap > 0))
        root = {c: c for c in group}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        names, out = list(ids), []
        for a, b in zip(rows[x], columns[y], strict=True):
            p, q = top(group[a]), top(group[b])
            if p != q:
                root[p] = q
                out.append((names[a], names[b]))
        return pa.table({"a": pa.array([p for p, _ in out], pa.binary()), "b": pa.array([q for _, q in out], pa.binary())})

    return forest


def _met(lists: DataFrame, found: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Block pairs of sets that share a prefix shingle, are not joined yet and whose sketches allow a link."""
    placed = lists.select("gram", "node", "n").join(labels.hint("merge"), "node", "left").withColumn("comp", F.coalesce("root", "node"))
    whole = Window.partitionBy("gram")
    open_ = placed.select("node", "n", "comp", F.min("node").over(whole).alias("root"), F.min("comp").over(whole).alias("lo"), F.max("comp").over(whole).alias("hi"))
    # Lists with the same smallest member are met together, as a pair often shares many shingles. Lists that only touch are
    # not: in a large corpus most of them reach each other by chance.
    members = kept(open_.filter("lo <> hi").select("root", "node", "n", "comp").distinct(), "open")
    blocks = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = members.join(blocks.hint("merge"), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = placed.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    sides = sides.withColumn("side", F.when(F.col("block") == F.col("other"), 2).when(F.col("block") == F.col("lo"), 0).otherwise(1))
    seen = sides.join(found.select("node", "sketch").hint("merge"), "node").select("root", "lo", "hi", "side", "node", "n", "comp", "sketch")
    seen = seen.repartition(parallelism(seen), "root", "lo", "hi")
    met = kept(seen.groupBy("root", "lo", "hi").applyInArrow(_hopeful(percent), "root binary, lo long, hi long, side int, node binary, n long, comp binary"), "met")
    discard(members, shuffles=True)
    return met


def jaccard_components(docs: DataFrame, percent: int = 75, n: int = 5, cells: int = CELLS) -> DataFrame:
    """Documents joined by links: 100 * |x & y| >= percent * |x | y| over sets of ``n``-word shingles.

    Returns doc_id, n_shingles, component_id (smallest doc_id that links reach) and n_copies (documents
    with the same set). Rows that repeat an id stay and share their component by id. A null id, like a
    null, blank or empty text, is a row of its own: an empty set links with nothing. A text of fewer words
    than ``n`` is one shingle. Other columns are ignored; an empty table gives no rows. Shingles are
    compared by 64-bit hash.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    spark = docs.sparkSession
    counted = kept(_texts(docs).mapInArrow(_count(n, cells), "doc_id long, n long, node binary, sketch binary, block int, salt int, data binary"), "gram-counts")
    order = _order(counted, cells)
    facts = kept(counted.filter("block is null").select("doc_id", "n", "node"), "facts")
    found = kept(counted.filter("block is null and n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("sketch").alias("sketch")), "found")
    discard(counted, shuffles=True)
    cuts = max(parallelism(docs), math.ceil(order.total * (100 - percent) / 100 / ENTRIES))
    packs = _texts(docs).filter("doc_id is not null").mapInArrow(_prefixes(n, order, cuts, percent), "route long, known boolean, grams binary, owner binary, nodes binary, facts binary")
    postings = kept(packs.groupBy("route").applyInArrow(_postings, "gram long, node binary, n long, common double"), "postings")
    sweep(spark)
    # A set stays in a list if the next smaller or next larger one there is close enough in size to link.
    by_size = Window.partitionBy("gram").orderBy("n")
    closest = F.coalesce(F.lag("n").over(by_size) * 100 >= percent * F.col("n"), F.lit(False)) | F.coalesce(F.col("n") * 100 >= percent * F.lead("n").over(by_size), F.lit(False))
    whole = Window.partitionBy("gram")
    lists = postings.withColumn("close", closest).filter("close").withColumn("hub", F.max(F.struct("common", "n", "node")).over(whole)).withColumn("members", F.count("*").over(whole))
    lists = kept(lists.filter(F.col("node") != F.col("hub.node")).select("gram", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), "members"), "lists")
    discard(postings, shuffles=True)
    near = F.least("n", "hub_n") * 100 >= percent * F.greatest("n", "hub_n")
    pairs = lists.filter(near).select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hub").alias("b"), F.col("hub_n").alias("nb")).distinct()
    for side in "ab":
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")).hint("merge"), side)
    pairs = kept(pairs.select("a", "na", "sketch_a", "b", "nb", "sketch_b").mapInArrow(_possible(percent), "a binary, na long, b binary, nb long"), "pairs")
    segments = _segments(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), found, n, order, VERIFY)
    links = _linked(pairs, segments, VERIFY, percent)
    discard(pairs, segments, shuffles=True)
    labels = components(links, "a", "b")
    met = _met(lists.filter("members > 2"), found, labels, percent)  # the hub has met the others
    discard(lists, labels)
    segments = _segments(docs, met.select("node").distinct(), found, n, order, 1)
    more = met.join(segments.hint("merge"), "node").repartition(parallelism(docs), "root", "lo", "hi")
    more = kept(more.groupBy("root", "lo", "hi").applyInArrow(_forest(VERIFY, percent), "a binary, b binary"), "more")
    discard(met, segments, shuffles=True)
    # Different texts under one id are joined by it.
    owned = facts.filter("n > 0 and doc_id is not null").select("doc_id", "node")
    shared = owned.groupBy("doc_id").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub <> top")
    repeats = owned.join(shared.hint("merge"), "doc_id").select(F.col("node").alias("a"), F.col("hub").alias("b")).filter("a <> b")
    labels = components(links.union(more).union(repeats), "a", "b")
    discard(links, more)
    named = found.join(labels.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = named.join(roots.hint("merge"), "root").select("node", "component_id", F.col("copies").alias("n_copies"))
    whole = facts.join(classes.hint("merge"), "node", "left")
    joined = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return whole.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(joined, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(joined, F.col("n_copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"),
    )
