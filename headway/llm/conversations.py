"""Cheapest edits that give a conversation a legal order of roles, by an auction for shortest paths.

A conversation is a lattice: a node is a place between its rows and a state of the roles given so far, an
arc is an edit with its whole-numbered cost. The auction keeps a path from the origin and a price for
every node; the end of the path is extended along its best arc while its price equals the arc's cost
plus the price beyond, else its price is raised to that and the path contracts by a node. Prices stay
below every arc's cost plus the price beyond, so when the path meets the sink the arcs of all cheapest
paths, and those only, are tight. The letters of the least path are read off the tight arcs.

Spark sorts the rows of all conversations together, so a huge one lies in many tasks, and cuts them into
segments of bounded length. A conversation of several segments needs the prices between them: a matrix
of costs from state to state for each segment, folded backwards in one stream of a few numbers a
segment. Then every segment is traced on its own, and the traces are chained forwards in a stream.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from headway.session import materialise

SPACES = " \t\n\x0b\x0c\r"
SEGMENT, SEGMENT_TEXT = 64, 1 << 20
FAR = 1 << 60
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
#: Kinds of rows; a code is 4 times the kind plus the number of the role's initial.
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
INITIALS = "sua"
OTHER = 3
#: States: nothing yet, after system, after user, after assistant. The role that can be made in each.
STATES = 4
WANTED = (1, 1, 2, 1)
AFTER = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
MADE = (None, "user", "assistant")
ENDS = (0, FAR, FAR, 0)
LEGAL = {(0, 1), (1, 2), (2, 1)}


class Lattice:
    """Arcs and prices of a segment. ``exits`` are the prices of the states behind it."""

    def __init__(self, codes: bytes, exits: tuple[int, ...], last: bool):
        n = len(codes)
        self.sink = STATES * (n + 1)
        onward = min(exits[2:]) < FAR
        open_state = (True, onward or exits[1] < FAR, onward, onward)
        #: What each row costs at least keeps the first prices below all arcs.
        ahead = [min(exits)]
        for code in reversed(codes):
            ahead.append(ahead[-1] + (0 if code >> 2 == SOUND else DELETE))
        ahead.reverse()
        self.price = [p for p in ahead for _ in range(STATES)] + [0]
        self.arcs: list[list[tuple[str, int, int]]] = []
        for k in range(n + 1):
            for state in range(STATES):
                arcs, after = [], AFTER[state][WANTED[state]]
                if k < n:
                    kind, initial = codes[k] >> 2, codes[k] & 3
                    extra = CUT_OFF if kind == TRUNCATED else 0
                    arcs.append(("D", DELETE, STATES * (k + 1) + state))
                    if open_state[after]:
                        arcs.append(("I", INSERT, STATES * k + after))
                    if kind <= TRUNCATED:
                        kept = AFTER[state].get(initial)
                        if kept is not None and open_state[kept]:
                            arcs.append(("K", extra, STATES * (k + 1) + kept))
                        if initial != WANTED[state] and open_state[after]:
                            arcs.append(("R", REROLE + extra, STATES * (k + 1) + after))
                else:
                    if exits[state] < FAR:
                        arcs.append(("", exits[state], self.sink))
                    if last and open_state[after]:
                        arcs.append(("I", INSERT, STATES * k + after))
                self.arcs.append(arcs)

    def auction(self, origin: int) -> int:
        """The cost from a state at the front to the sink; FAR if there is no way."""
        price, path = self.price, [origin]
        while path[-1] != self.sink:
            node = path[-1]
            best, onto = FAR, -1
            for _, cost, target in self.arcs[node]:
                if cost + price[target] < best:
                    best, onto = cost + price[target], target
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif onto < 0:
                if len(path) == 1:
                    return FAR
                path.pop()
            else:
                path.append(onto)
        return price[origin]

    def trace(self, origin: int) -> tuple[str, int]:
        """The letters of the least cheapest path, and the state it ends in."""
        price, leads = self.price, [False] * self.sink + [True]
        for k in range(self.sink // STATES - 1, -1, -1):
            for _ in range(STATES - 1):  # Inserts stay in the layer.
                for node in range(STATES * k, STATES * k + STATES):
                    leads[node] = leads[node] or any(
                        leads[to] and price[node] == cost + price[to] for _, cost, to in self.arcs[node])
        letters, node, state = [], origin, origin
        while node != self.sink:
            state = node % STATES
            letter, node = next((letter, to) for letter, cost, to in self.arcs[node]
                                if leads[to] and price[node] == cost + price[to])
            letters.append(letter)
        return "".join(letters), state


@lru_cache(1 << 16)
def traces(codes: bytes, exits: tuple[int, ...], last: bool, origins: int = STATES) -> tuple:
    """For each state at the front: letters, state at the end and cost; None if there is no way."""
    lattice = Lattice(codes, exits, last)
    costs = [lattice.auction(q) for q in range(origins)]
    found: list[tuple[str, int, int] | None] = []
    for origin, cost in enumerate(costs):
        letters, end = lattice.trace(origin) if cost < FAR else ("", -1)
        found.append((letters, end, cost - exits[end]) if cost < FAR else None)
    return tuple(found)


@lru_cache(1 << 14)
def matrix(codes: bytes, last: bool) -> tuple[int, ...]:
    """Costs from each state at the front to each state at the end, row by row."""
    columns = []
    for end in range(STATES):
        lattice = Lattice(codes, tuple(0 if q == end else FAR for q in range(STATES)), last)
        reach = (True, end >= 1, end >= 2, end >= 2)
        columns.append([lattice.auction(q) if reach[q] else FAR for q in range(STATES)])
    return tuple(columns[end][q] for q in range(STATES) for end in range(STATES))


def _rows(batches):
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows, schema: pa.Schema, limit: int = 1024, text: int = 4 << 20):
    """Rows in batches; ``rows`` gives (bytes of text, row)."""
    held, size = [], 0
    for weight, row in rows:
        held.append(row)
        size += weight
        if len(held) >= limit or size >= text:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_SEGMENTS = pa.schema([("key", pa.string()), ("segment", pa.int64()), ("codes", pa.binary()),
                       ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def _cutter(size: int):
    def expanded(batches):
        for key, role, text, times, kind in _rows(batches):
            code = INITIALS.find(role[:1]) if role else -1
            code = OTHER if code < 0 else code
            kept = kind <= TRUNCATED
            yield key, 4 * kind + code, role if kept else None, text if kept else None
            for _ in range(times - 1):
                yield key, 4 * max(kind, DUPLICATE) + code, None, None

    def segments(batches):
        number = TaskContext.get().partitionId() << 40
        key, codes, roles, texts, length = None, bytearray(), [], [], 0
        for own, code, role, text in expanded(batches):
            if codes and (own != key or len(codes) == size or length >= SEGMENT_TEXT):
                yield length, (key, number, bytes(codes), roles, texts)
                number += 1
                codes, roles, texts, length = bytearray(), [], [], 0
            key = own
            codes.append(code)
            if text is not None:
                roles.append(role)
                texts.append(text)
                length += len(text)
        if codes:
            yield length, (key, number, bytes(codes), roles, texts)

    return lambda batches: _batches(segments(batches), _SEGMENTS)


_MATRICES = pa.schema([("key", pa.string()), ("segment", pa.int64()), ("last", pa.bool_()),
                       ("costs", pa.list_(pa.int64()))])


def _matrices(batches):
    yield from _batches(((0, (key, segment, last, matrix(codes, last)))
                         for key, segment, codes, last in _rows(batches)), _MATRICES)


_EXITS = pa.schema([("key", pa.string()), ("segment", pa.int64()), ("last", pa.bool_()),
                    ("exits", pa.list_(pa.int64()))])


def _exits(batches):
    """Prices behind every segment; a conversation's segments come from the last one to the first."""
    def prices():
        exits = ENDS
        for key, segment, last, costs in _rows(batches):
            exits = ENDS if last else exits
            yield 0, (key, segment, last, exits)
            exits = tuple(min(FAR, *(costs[STATES * q + end] + exits[end] for end in range(STATES)))
                          for q in range(STATES))

    yield from _batches(prices(), _EXITS)


_TRACED = pa.schema([("key", pa.string()), ("segment", pa.int64()), ("codes", pa.binary()),
                     ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                     ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int32())),
                     ("costs", pa.list_(pa.int64()))])


def _traced(batches):
    def each():
        for key, segment, codes, roles, texts, last, exits in _rows(batches):
            found = traces(codes, ENDS, True, 1) if exits is None else traces(codes, tuple(exits), last)
            audits, ends, costs = zip(*(one or (None, None, None) for one in found))
            yield sum(map(len, texts)), (key, segment, codes, roles, texts, audits, ends, costs)

    yield from _batches(each(), _TRACED)


_REPAIRED = pa.schema([("key", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                       ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
                       ("audit", pa.string()), ("repaired_sha256", pa.string())])


class Repair:
    """A conversation as its segments pass by."""

    def __init__(self):
        self.kinds, self.illegal, self.cost, self.audit = [0] * 4, 0, 0, []
        self.hash, self.some, self.initial, self.state = hashlib.sha256(), False, None, 0

    def add(self, codes, roles, texts, audits, ends, costs):
        for code in codes:
            self.kinds[code >> 2] += 1
            self.illegal += self.initial is not None and (self.initial, code & 3) not in LEGAL
            self.initial = code & 3
        front, rows, kept = self.state, iter(codes), zip(roles, texts)
        state = front
        for letter in audits[front]:
            role, text = MADE[WANTED[state]], ""
            step = AFTER[state][WANTED[state]]
            if letter != "I":
                code = next(rows)
                own = next(kept) if code >> 2 <= TRUNCATED else None
                if letter == "D":
                    continue
                text = own[1]
                if letter == "K":
                    role, step = own[0], AFTER[state][code & 3]
            self.hash.update(("\n" * self.some + f"{role}:{text}").encode())
            self.some, state = True, step
        self.audit.append(audits[front])
        self.cost += costs[front]
        self.state = ends[front]

    def row(self, key):
        return (key, self.kinds[BLANK], self.kinds[DUPLICATE], self.kinds[TRUNCATED], self.illegal, self.cost,
                "".join(self.audit), self.hash.hexdigest())


def _chained(batches):
    """Conversations from their segments in order; only running sums and a hash are held."""
    def each():
        now, repair = None, None
        for key, _, *segment in _rows(batches):
            if repair is None or key != now:
                if repair is not None:
                    yield 0, repair.row(now)
                now, repair = key, Repair()
            repair.add(*segment)
        if repair is not None:
            yield 0, repair.row(now)

    yield from _batches(each(), _REPAIRED)


def _ddl(schema: pa.Schema) -> str:
    names = {"string": "string", "int64": "long", "int32": "int", "bool": "boolean", "binary": "binary"}
    return ", ".join(f"{f.name} array<{names[str(f.type.value_type)]}>" if pa.types.is_list(f.type)
                     else f"{f.name} {names[str(f.type)]}" for f in schema)


def key_of(conversations: DataFrame) -> Column:
    """Text that stands for a conversation id, null included."""
    return F.coalesce(F.concat(F.lit("="), conversations["conv_id"].cast("string")), F.lit(""))


def damaged(conversations: DataFrame) -> DataFrame:
    """key, turn, role, text and times of each row after damage; equal rows are one with their number."""
    def given(column):
        return F.coalesce(conversations[column].cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn"))) % 20
    text = given("text")
    return conversations.select(
        key_of(conversations).alias("key"), conversations["turn"].cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(given("role")).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(hit == 3, 2).otherwise(1).cast("long").alias("times"), hit.alias("hit")).where("hit <> 0") \
        .groupBy("key", "turn", "role", "text").agg(F.sum("times").alias("times"))


def with_kinds(rows: DataFrame) -> DataFrame:
    """The rows with the kind that their first copy is."""
    spaces = F.lit(SPACES)
    seen = rows.select("*", F.sha2("text", 256).alias("tag"), F.rtrim("text", spaces).alias("body"))
    seen = seen.select("*", (F.length("body") == 0).alias("empty"),
                       F.substring("body", -1, 1).isin(".", "!", "?").alias("ended")).drop("body")
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    again = seen.where("NOT empty").groupBy("key", "role", "tag").agg(
        F.count("*").alias("turns"), F.min(place).alias("first")).where("turns > 1") \
        .select("key", "role", "tag", "first")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return seen.join(again, ["key", "role", "tag"], "left").select(
        "key", "turn", "role", "text", "times",
        F.when(F.col("empty"), BLANK).when(later, DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(SOUND)
        .alias("kind"))


def segmented(rows: DataFrame, size: int) -> DataFrame:
    """The rows in order, in segments of at most ``size`` of one conversation, numbered in order."""
    return rows.repartitionByRange("key", "turn", "role", F.substring("text", 1, 64)) \
        .sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text", "times", "kind") \
        .mapInArrow(_cutter(size), _ddl(_SEGMENTS))


def repaired(conversations: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row per conversation id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Rows are damaged by the checksum of id and turn, then judged and repaired in the order of turn (nulls
    first), role and text; copies of a row stand side by side. A null id is a conversation of its own, a
    null role or text is one space. A row whose role has another initial than s, u or a can only be
    given a role or deleted. A conversation that loses all its rows has zeros, an empty audit and the hash
    of an empty text. Other columns are ignored. An empty table gives no rows.
    """
    segments = materialise(segmented(with_kinds(damaged(conversations)), size), "segments")
    spans = segments.groupBy("key").agg(F.count("*").alias("parts"), F.max("segment").alias("final")) \
        .where("parts > 1").select("key", "final")
    costs = segments.select("key", "segment", "codes").join(spans, "key") \
        .select("key", "segment", "codes", (F.col("segment") == F.col("final")).alias("last")) \
        .mapInArrow(_matrices, _ddl(_MATRICES))
    exits = materialise(costs.repartition("key").sortWithinPartitions("key", F.desc("segment"))
                        .mapInArrow(_exits, _ddl(_EXITS)), "exits")
    traced = segments.join(exits, ["key", "segment"], "left") \
        .select(*_SEGMENTS.names, "last", "exits").mapInArrow(_traced, _ddl(_TRACED))
    found = traced.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(_chained, _ddl(_REPAIRED))

    turns = conversations.select(key_of(conversations).alias("key"), F.col("conv_id"), F.col("turn").cast("long"),
                                 F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" "))
                                                            for c in ("conv_id", "turn")))).alias("hit"))
    held = turns.groupBy("key", F.when(F.col("hit") % 20 != 0, F.col("turn")).alias("turn")) \
        .agg(F.first("conv_id").alias("conv_id")).groupBy("key").agg(
            F.first("conv_id").alias("conv_id"),
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    none = {n: F.lit(0).cast("long") for n in ("blank", "duplicate", "truncated", "illegal", "cost")}
    none |= {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return held.join(found, "key", "left").select(
        "conv_id", "gaps", *(F.coalesce(n, value).alias(n) for n, value in none.items()))
