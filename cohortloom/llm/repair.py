"""Conversation structure repair: the cheapest edits that give a conversation turns of alternating roles.

Role initials of a sound conversation are ``(s?(ua)+)?``. Edits of a row: Keep costs 0, Rerole to user or assistant 1,
Delete 2 (required for blank and duplicate rows); an empty row can be Inserted anywhere for 5; a truncated row that
stays costs 5 more. ``search`` is iterative-deepening A*: depth first, edits in ASCII order of their initials, under a
cost bound that grows to the least cost seen beyond it. A transposition table keeps for each failed state what it needs
at least, so a state is entered again only with a larger budget. The first path found is cheapest and ASCII-least.

1. Rows are dealt into ranges of (conversation, turn, role, digest of the text). A task reads its range in order and
   settles every conversation that lies inside it and has at most ``ROWS`` rows.
2. The rows of other conversations (the first and last of a range, and long ones) are cut into chunks of ``CHUNK``.
   Each chunk is searched from every state to every state; a chunk's edits end with a row's edit, so paths never begin
   alike and chain chunk by chunk without looking inside. Rows are then repaired chunk by chunk, and the digest of a
   conversation reads its repaired chunks in order.

A conversation is never gathered in one task as rows: what meets is one record a chunk and the repaired text, in pieces.

Order: turn (nulls first), role, digest of the text; equal rows are interchangeable. Null text and role count as one
space. A null conversation id is a conversation. Conversations without a row give zeros and empty texts. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import kept
from cohortloom.session import parallelism

ROWS = 256
"""Rows of a conversation that is searched as a whole."""
CHUNK = 64
"""Rows of a chunk of a longer one, which is searched from every state to every state."""
PIECE = 1 << 20
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
"""What has been written so far, by its last initial."""
STATES = 4
SPACE = " \t\n\x0b\x0c\r"
ROLES = {USER: "user", ASSISTANT: "assistant"}


def written(state: int) -> int:
    """State after a user or assistant row, whichever may follow."""
    return ASSISTANT if state == USER else USER


def kept_as(state: int, initial: str) -> int | None:
    """State after a row of this initial, if it may follow."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial in ("u", "a"):
        after = USER if initial == "u" else ASSISTANT
        return after if written(state) == after else None
    return None


def _edits(state: int, initial: str, fault: int) -> Iterator[tuple[str, int, int]]:
    """(edit, next state, cost) of a row, in ASCII order: Delete, Insert before it, Keep, Rerole."""
    yield "D", state, 2
    yield "I", written(state), 5
    if fault in (SOUND, TRUNCATED):
        more = 5 if fault == TRUNCATED else 0
        after = kept_as(state, initial)
        if after is not None:
            yield "K", after, more
        yield "R", written(state), 1 + more


def _least(initial: str, fault: int) -> int:
    """What a row costs at least, whatever is around it."""
    return 2 if fault != SOUND else 0 if initial in ("s", "u", "a") else 1


def search(rows: list[tuple[str, int]], start: int = START, stop: int | None = None, need: dict | None = None) -> tuple[int, str] | None:
    """Cost and edits of the first accepting path over (initial, fault) rows.

    Without ``stop`` the end must be a sound conversation and rows may be inserted there; with it the path ends with
    the last row, in that state, and None says that no path does.
    """
    if stop is not None and start != stop:
        opens = start == START and any(initial == "s" and fault in (SOUND, TRUNCATED) for initial, fault in rows)
        if not rows or stop == START or (stop == SYSTEM and not opens):
            return None
    floor = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        floor[i] = floor[i + 1] + _least(*rows[i])
    need = {} if need is None else need

    def lower(i: int, state: int) -> float:
        return need.get((i, state), floor[i])

    def moves(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        if i < len(rows):
            for edit, after, cost in _edits(state, *rows[i]):
                yield edit, i + (edit != "I"), after, cost
        elif stop is None:
            yield "I", i, written(state), 5

    def done(i: int, state: int) -> bool:
        return i == len(rows) and (state in (START, ASSISTANT) if stop is None else state == stop)

    if done(0, start):
        return 0, ""
    bound = lower(0, start)
    while True:
        path: list[str] = []
        frames = [[0, start, bound, moves(0, start), inf]]
        while frames:
            i, state, left, options, beyond = frames[-1]
            move = next(options, None)
            if move is None:
                need[i, state] = beyond
                frames.pop()
                if frames:
                    path.pop()
                    frames[-1][4] = min(frames[-1][4], beyond + frames[-1][2] - left)
                continue
            edit, j, after, cost = move
            if cost + lower(j, after) > left:
                frames[-1][4] = min(beyond, cost + lower(j, after))
            elif done(j, after):
                return int(bound - left + cost), "".join(path) + edit
            else:
                path.append(edit)
                frames.append([j, after, left - cost, moves(j, after), inf])
        bound = need[0, start]


def repaired(rows: list[tuple[str, str]], edits: str, state: int = START) -> list[str]:
    """``role:text`` lines of (role, text) rows after their edits."""
    lines, i = [], 0
    for edit in edits:
        if edit == "I":
            state = written(state)
            lines.append(f"{ROLES[state]}:")
            continue
        role, text = rows[i]
        i += 1
        if edit == "K":
            state = kept_as(state, role[:1])
            lines.append(f"{role}:{text}")
        elif edit == "R":
            state = written(state)
            lines.append(f"{ROLES[state]}:{text}")
    return lines


def _fault(text: str, again: bool) -> int:
    end = text.rstrip(SPACE)
    return BLANK if not end else DUPLICATE if again else SOUND if end[-1] in ".!?" else TRUNCATED


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


OUT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROW = "turn {turn}, role string, text string, digest binary, range long, place long"
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _settle(rows: list[tuple]) -> tuple:
    """All results of one conversation of (turn, role, text) rows."""
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append(_fault(text, (role, text) in seen))
        seen.add((role, text))
    cost, edits = search([(role[:1], f) for (_, role, _), f in zip(rows, faults, strict=True)])
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    lines = repaired([(role, text) for _, role, text in rows], edits)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), _illegal([r[:1] for _, r, _ in rows]), cost, edits, digest


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles what lies inside a range of sorted rows; hands on the rows of its first, its last and its long conversations."""
    here, place = TaskContext.get().partitionId(), 0
    out: list[dict] = []
    schema, first, key, held, passing = None, True, object(), [], True

    def hand_on(row: tuple) -> None:
        conv, turn, role, text, digest, at = row
        out.append({"conv_id": conv, "turn": turn, "role": role, "text": text, "digest": digest, "range": here, "place": at})

    for batch in batches:
        if schema is None:
            given = {n: batch.schema.field(n).type for n in ("conv_id", "turn", "role", "text", "digest")}
            results = {n: pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in RESULT}
            schema = pa.schema({"conv_id": given.pop("conv_id"), **results, **given, "range": pa.int64(), "place": pa.int64()})
        for row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "digest")), strict=True):
            if row[0] != key:
                if held:
                    out.append({"conv_id": key, **dict(zip(RESULT, _settle([r[1:4] for r in held]), strict=True))})
                passing, first = first, False
                key, held = row[0], []
            row = (*row, place)
            place += 1
            if passing:
                hand_on(row)
            else:
                held.append(row)
                if len(held) > ROWS:
                    for r in held:
                        hand_on(r)
                    held, passing = [], True
        yield pa.RecordBatch.from_pylist(out, schema)
        out.clear()
    for r in held:
        hand_on(r)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


SEGMENT = "conv_id {id}, range long, chunk long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<bigint>, edits array<string>"


def _search_chunk(table: pa.Table) -> pa.Table:
    """Facts of a chunk, and the cheapest edits from every state to every state at index ``4 * start + stop``."""
    order = table.sort_by("place")
    initials, faults = order.column("initial").to_pylist(), order.column("fault").to_pylist()
    rows = list(zip(initials, faults, strict=True))
    found = {}
    for stop in range(STATES):
        need: dict = {}
        for start in range(STATES):
            found[start, stop] = search(rows, start, stop, need)
    pairs = [found[a, b] for a in range(STATES) for b in range(STATES)]
    one = {
        **{n: order.column(n)[:1] for n in ("conv_id", "range", "chunk")},
        **{n: [faults.count(f)] for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))},
        "illegal": [_illegal(initials)],
        "first": [initials[0]],
        "last": [initials[-1]],
        "costs": pa.array([[p and p[0] for p in pairs]], pa.list_(pa.int64())),
        "edits": pa.array([[p and p[1] for p in pairs]], pa.list_(pa.string())),
    }
    return pa.table(one)


LINK = "conv_id {id}, range long, chunk long, start int, stop int, tail int, cost long, illegal long"


def _chain(table: pa.Table) -> pa.Table:
    """The cheapest way through the chunks of a conversation; among equals the one whose edits come first."""
    order = table.sort_by([("range", "ascending"), ("chunk", "ascending")])
    costs, ranks = order.column("costs").to_pylist(), order.column("ranks").to_pylist()
    tails = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    best: list[float] = [5 * tails[s] for s in range(STATES)]
    steps: list[list[int | None]] = []
    for cost, rank in zip(reversed(costs), reversed(ranks), strict=True):
        now, step = [], []
        for start in range(STATES):
            ways = [(cost[4 * start + s] + best[s], rank[4 * start + s], s) for s in range(STATES) if cost[4 * start + s] is not None]
            now.append(min(ways, default=(inf,))[0])
            step.append(min(ways)[2] if ways else None)
        best = now
        steps.append(step)
    start, path = START, []
    for step in reversed(steps):
        path.append((start, step[start]))
        start = step[start]
    first, last = order.column("first").to_pylist(), order.column("last").to_pylist()
    joints = sum(a + b not in ("su", "ua", "au") for a, b in zip(last, first[1:], strict=False))
    n = len(path)
    return pa.table(
        {
            **{c: order.column(c) for c in ("conv_id", "range", "chunk")},
            "start": pa.array([p[0] for p in path], pa.int32()),
            "stop": pa.array([p[1] for p in path], pa.int32()),
            "tail": pa.array([0] * (n - 1) + [tails[start]], pa.int32()),
            "cost": pa.array([int(best[START])] + [0] * (n - 1), pa.int64()),
            "illegal": pa.array([joints] + [0] * (n - 1), pa.int64()),
        }
    )


def _repair_chunk(rows: pa.Table, way: pa.Table) -> pa.Table:
    """Repaired lines of a chunk, each after a newline, in pieces of bounded length."""
    order = rows.sort_by("place")
    start, edits, tail = (way.column(c)[0].as_py() for c in ("start", "audit", "tail"))
    lines = repaired(list(zip(order.column("role").to_pylist(), order.column("text").to_pylist(), strict=True)), edits + "I" * tail, start)
    pieces, size = [[]], 0
    for line in lines:
        if size > PIECE:
            pieces.append([])
            size = 0
        pieces[-1].append("\n" + line)
        size += len(line)
    n = len(pieces)
    return pa.table(
        {
            **{c: pa.array([way.column(c)[0].as_py()] * n, way.schema.field(c).type) for c in ("conv_id", "range", "chunk")},
            "piece": pa.array(range(n), pa.int64()),
            "lines": pa.array(["".join(p) for p in pieces], pa.string()),
            "edits": pa.array([edits + "I" * tail] + [""] * (n - 1), pa.string()),
        }
    )


def _read_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and digest of each conversation from its pieces in order."""
    key, digest, edits, began = None, None, [], False
    ids, audits, digests = [], [], []

    def end() -> None:
        ids.append(key[0])
        audits.append("".join(edits))
        digests.append(digest.hexdigest())

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, lines, more in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "lines", "edits")), strict=True):
            if key != (conv,):
                if key is not None:
                    end()
                key, digest, edits, began = (conv,), hashlib.sha256(), [], False
            edits.append(more)
            digest.update((lines if began else lines[1:]).encode())
            began = began or bool(lines)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(audits, pa.string()), pa.array(digests, pa.string())], ["conv_id", "audit", "repaired_sha256"])
        ids.clear(), audits.clear(), digests.clear()
    if key is not None:
        end()
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(audits, pa.string()), pa.array(digests, pa.string())], ["conv_id", "audit", "repaired_sha256"])


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that each row's number gives it."""
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(named.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of ``rows``, and for each conv_id of ``ids`` that has none."""
    kinds = {"id": rows.schema["conv_id"].dataType.simpleString(), "turn": rows.schema["turn"].dataType.simpleString()}
    blank = F.lit(" ")
    plain = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    plain = plain.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))).withColumn("origin", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "origin")]
    schema = f"{OUT}, {ROW}".format(**kinds)
    dealt = plain.repartitionByRange(parallelism(plain), *order).sortWithinPartitions(*order)
    read = kept(dealt.select("conv_id", "turn", "role", "text", "digest").mapInArrow(_read_ranges, schema), "conversations")
    settled = read.filter(F.col("cost").isNotNull()).select("conv_id", *RESULT)

    place = [F.col(c) for c in ("range", "place")]
    open_rows = read.filter(F.col("range").isNotNull()).select("conv_id", "turn", "role", "text", "digest", *place, F.floor(F.col("place") / CHUNK).cast("long").alias("chunk"))
    first = open_rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("range", "place")).alias("at")).select(F.col("at.range").alias("r"), F.col("at.place").alias("p"))
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(ended == "", BLANK).when(F.col("p").isNull(), DUPLICATE).when(F.right(ended, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    known = open_rows.join(first, (F.col("range") == F.col("r")) & (F.col("place") == F.col("p")), "left")
    known = kept(known.select("conv_id", "turn", "range", "place", "chunk", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault")), "faults")
    key = ["conv_id", "range", "chunk"]
    # Few bytes make much work here, so the chunks are not put together by their size.
    spread = known.repartition(parallelism(known), *key)
    chunks = kept(spread.groupBy(*key).applyInArrow(_search_chunk, SEGMENT.format(**kinds)), "chunks")
    sorted_edits = F.array_sort(F.filter("edits", lambda e: e.isNotNull()))
    ranks = F.transform("edits", lambda e: F.array_position(sorted_edits, e))
    links = kept(chunks.select(*key, "first", "last", "costs", ranks.alias("ranks")).groupBy("conv_id").applyInArrow(_chain, LINK.format(**kinds)), "links")

    def same(a: DataFrame, b: DataFrame, *names: str):
        on = a[names[0]].eqNullSafe(b[names[0]])
        for n in names[1:]:
            on &= a[n] == b[n]
        return on

    ways = chunks.join(links, same(chunks, links, *key)).select(*(chunks[c] for c in key), "start", "tail", F.get("edits", F.col("start") * STATES + F.col("stop")).alias("audit"))
    way = ways.select(*(F.col(c).alias(c) for c in ways.columns))
    pieces = open_rows.select(*key, "place", "role", "text").groupBy(*key).cogroup(way.groupBy(*key)).applyInArrow(_repair_chunk, "conv_id {id}, range long, chunk long, piece long, lines string, edits string".format(**kinds))
    ordered = pieces.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "range", "chunk", "piece")
    through = kept(ordered.select("conv_id", "lines", "edits").mapInArrow(_read_through, "conv_id {id}, audit string, repaired_sha256 string".format(**kinds)), "repaired")

    turns = known.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("n"))
    turns = turns.select("conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))
    facts = chunks.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    joints = links.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("joints"))
    long = facts
    for table in (turns, joints, through):
        named = table.withColumnRenamed("conv_id", "own")
        long = long.join(named, long.conv_id.eqNullSafe(named.own)).drop("own")
    done = settled.unionByName(long.withColumn("illegal", F.col("illegal") + F.col("joints")).select("conv_id", *RESULT))
    if ids is None:
        return done
    named = done.withColumnRenamed("conv_id", "own")
    every = ids.select("conv_id").distinct()
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return every.join(named, every.conv_id.eqNullSafe(named.own), "left").select("conv_id", *(F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in RESULT))
