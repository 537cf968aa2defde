"""Removal of repeated 100-byte strings, by prefix doubling over positions.

Prefix doubling names the string of length 2h at a position by the pair of names at the position and h
further on; positions whose name is unique drop out, and it ends past the threshold. Here the names up
to ``GRAM`` bytes are doubled inside a task. Every string of ``SPAN`` bytes is then represented by its
smallest gram, so equal strings have equal representatives; strings in a row with the same one form a run.
Spark sorts the runs by rank: by the name of the gram, where unique ones drop out, and by the pair of
gram and whole run, where all but the first of equal runs are repeats as a whole. Runs that share a
gram with a different run go on to the next length of gram, and past the last one, position by
position, to names of ``SPAN`` bytes.

Before each sort a task keeps the first of its equal rows, so a string that is repeated everywhere
sends one row per task and batch. Gram names only find candidates; what is removed rests on names of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from headway.llm import text as tx

SPAN = 100
#: Lengths of the ranks that Spark sorts before those of whole strings.
GRAMS = (32, 80)
#: Bytes whose names are held at a time, and bytes whose runs are compared before they are sent.
AT_ONCE, TOGETHER = 1 << 18, 16 << 20
PACKED_ROWS = 256
FOUND = "name long, run long, doc_id long, start long, more long"
#: Kinds of rows, kept with the length: more = 4 * (stop - start) + kind.
FIRST, MIXED, REPEAT, OPEN = range(4)
_MULT = 0x9E3779B97F4A7C15 | 1
_NONE = (np.zeros(0, np.int64),) * 3


def gram_names(data: np.ndarray, length: int) -> np.ndarray:
    """Names of the grams at all positions, doubled from single bytes."""
    names, size = tx.BYTE_VALUE[data], 1
    while size < length:
        further = min(size, length - size)
        names = names[:-further] * np.uint64(pow(_MULT, 2 * size, 2**64)) + names[further:]
        if further < size:
            names = tx.mixed(names)
        size += further
    return tx.mixed(names)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each ``width`` values in a row, by doubling."""
    size, out = 1, values
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[:-rest], out[rest:]) if rest else out


def runs(data: np.ndarray, bounds: np.ndarray, length: int,
         among: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of strings with one representative: row, first and last start in the row, gram, whether some
    string may repeat within the run, and the name of the run's bytes. ``among``: only these starts."""
    width = SPAN - length + 1
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none.astype(np.uint64), none.astype(bool), none.astype(np.uint64)
    grams = gram_names(data, length)
    least = _sliding(grams, width, np.minimum)
    row = np.searchsorted(bounds, np.arange(len(least)), "right") - 1
    inside = np.arange(len(least)) + SPAN <= bounds[1:][row]
    if among is not None:
        inside &= among[:len(inside)]
    least = np.where(inside, least, np.uint64(0))
    change = np.append(True, least[1:] != least[:-1])
    first = np.flatnonzero(change & inside)
    last = np.flatnonzero(np.append(change[1:], True) & inside)
    # Positions of the representatives; a run with two of them may repeat a string within itself.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == grams)
    lo, hi = np.searchsorted(at, first), np.searchsorted(at, last + width - 1, "right")
    many = last - first + 1 > width
    found = np.zeros(len(first), np.int64)
    for k in range(int((hi - lo)[~many].max(initial=0))):
        has = ~many & (lo + k < hi)
        found[has] += grams[at[lo[has] + k]] == least[first[has]]
    names = tx.span_hashes(data, first, last + SPAN)
    start = bounds[row[first]]
    return row[first], first - start, last - start, least[first], many | (found > 1), names


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals joined where they touch."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    group = np.append(True, doc[1:] != doc[:-1])
    # Ends only grow within a document, so a running maximum over shifted values stays within it.
    base = np.cumsum(group) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + base)
    new = np.append(True, start[1:] + base[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], (reach - base)[np.append(at[1:], len(doc)) - 1]


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    """Record batch from parts (kind, name, run, doc, start, stop)."""
    columns = [[name, run, doc, start, 4 * (stop - start) + kind]
               for kind, name, run, doc, start, stop in parts]
    whole = [np.concatenate([np.asarray(x).view(np.int64) for x in column]) for column in zip(*columns)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in whole],
                                      names=["name", "run", "doc_id", "start", "more"])


def _passed(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, kind: int) -> tuple:
    return kind, _apart(doc, start), doc * 0, doc, start, stop


def _apart(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Names for rows that are only passed on."""
    return tx.mixed(doc.astype(np.uint64) * np.uint64(_MULT) + start.astype(np.uint64))


def _compare_runs(known, doc, start, last, gram, several, name) -> pa.RecordBatch:
    """What a task knows of its runs: the first of a gram, repeats, and runs to look at in full."""
    order = np.lexsort((start, doc, name, gram))
    doc, start, last, gram, several, name = (x[order] for x in (doc, start, last, gram, several, name))
    new_gram = np.append(True, gram[1:] != gram[:-1]) if len(gram) else np.zeros(0, bool)
    group = np.cumsum(new_gram) - 1
    new_run = new_gram | np.append(True, name[1:] != name[:-1])[:len(gram)]
    head = np.maximum.accumulate(np.where(new_run, np.arange(len(gram)), 0))
    later = (doc != doc[head]) | (start != start[head])
    kinds = np.bincount(group, new_run) if len(group) else np.zeros(0)
    any_several = np.bincount(group, several) > 0 if len(group) else np.zeros(0, bool)
    mixed = ((kinds > 1) | any_several)[group]
    repeat = later & ~several
    opened = mixed & ~repeat
    first = ~mixed & new_run
    marker = new_gram & mixed
    zero = np.zeros(int(marker.sum()), np.int64)
    return _rows([
        (FIRST, gram[first], name[first], doc[first], start[first], last[first]),
        (MIXED, gram[marker], zero, zero, zero, zero),
        _passed(*_merged(np.append(known[0], doc[repeat]), np.append(known[1], start[repeat]),
                         np.append(known[2], last[repeat] + SPAN)), REPEAT),
        _passed(doc[opened], start[opened], last[opened], OPEN)])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the exchange that all rounds read."""
    for batch in tx.slices(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        raw = pc.fill_null(batch.column(1).cast(pa.binary()), b"").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(r) for r in raw], pa.binary())],
                                         names=["doc_id", "text"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, texts as they were."""
    for batch in batches:
        for at in range(0, batch.num_rows, PACKED_ROWS):
            part = batch.slice(at, PACKED_ROWS)
            expand = zstandard.ZstdDecompressor().decompress
            texts = pa.array([expand(r) for r in part.column(1).to_pylist()], pa.large_binary())
            yield pa.RecordBatch.from_arrays([part.column(0), texts, *part.columns[2:]], names=part.schema.names)


def _joined(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts))


def _compare_strings(known, doc, start, one, two) -> pa.RecordBatch:
    order = np.lexsort((start, doc, two, one))
    doc, start, one, two = (x[order] for x in (doc, start, one, two))
    new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[:len(one)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(one)), 0))
    later = (doc != doc[head]) | (start != start[head])
    return _rows([
        (FIRST, one[new], two[new], doc[new], start[new], start[new]),
        _passed(*_merged(np.append(known[0], doc[later]), np.append(known[1], start[later]),
                         np.append(known[2], start[later] + SPAN)), REPEAT)])


def _round(length: int | None, first: bool = False):
    """A task's share of one round: runs by grams of a length, or with None whole strings.

    Input: doc_id, text and, after the first round, kinds, starts and stops of what is known of the text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, known, size = [], [], 0
        compare = _compare_strings if length is None else _compare_runs
        for batch in tx.slices(batches if first else _unpacked(batches), limit=AT_ONCE):
            data, bounds = tx.flat(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            among = None
            if not first:
                row = np.repeat(np.arange(len(ids)), [len(x) for x in batch.column(2)])
                kind, start, stop = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                                     for k in (2, 3, 4))
                done = kind == REPEAT
                known.append((ids[row[done]], start[done], stop[done]))
                place = bounds[row[~done]]
                edges = np.zeros(len(data) + 2, np.int64)
                # Rows that repeat an id may be shorter than the one a run was found in.
                np.add.at(edges, np.minimum(place + start[~done], len(data)), 1)
                np.add.at(edges, np.minimum(place + stop[~done] + 1, len(data)), -1)
                among = np.cumsum(edges)[:len(data)] > 0
            if length is None:
                row = np.searchsorted(bounds, np.arange(len(data)), "right") - 1
                at = np.flatnonzero(among & (np.arange(len(data)) + SPAN <= bounds[1:][row]))
                kept.append((ids[row[at]], at - bounds[row[at]], *(
                    tx.span_hashes(data, at, at + SPAN, k) for k in (0, 1))))
                size += 16 * len(at)
            else:
                row, *rest = runs(data, bounds, length, among)
                kept.append((ids[row], *rest))
                size += len(data)
            if size > TOGETHER:
                yield compare(_joined(known or [_NONE]), *_joined(kept))
                kept, known, size = [], [], 0
        if kept:
            yield compare(_joined(known or [_NONE]), *_joined(kept))

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input doc_id, text, starts, stops; the digest of what is left of each text."""
    for batch in tx.slices(_unpacked(batches)):
        data, bounds = tx.flat(batch.column(1))
        raw = data.tobytes()
        starts, stops = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        rows = []
        for k in range(batch.num_rows):
            own, spans, removed, left = raw[bounds[k]:bounds[k + 1]], 0, 0, []
            at = 0
            cover = sorted(zip(starts[k] or (), stops[k] or ()))
            upto = -1
            for a, b in cover:
                b = min(b, len(own))
                if a >= b:
                    continue
                if a > upto:
                    spans += 1
                    left.append(own[at:a])
                    upto = a
                removed += max(0, b - upto)
                upto = max(upto, b)
                at = upto
            left.append(own[at:])
            rows.append((len(own), removed, spans, hashlib.sha256(b"".join(left)).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.string())))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _judged(found: DataFrame) -> DataFrame:
    """Sort the rows by rank: (doc_id, kind, start, stop) of repeats and of what is still open."""
    rows = found.select("name", "run", "doc_id", "start", F.pmod("more", F.lit(4)).cast("int").alias("kind"),
                        (F.col("start") + F.shiftright("more", 2)).alias("stop"))
    by_name = Window.partitionBy("name").orderBy("run", "doc_id", "start")
    whole = by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.when(F.col("kind") == FIRST, F.col("run"))
    ranked = rows.withColumns({
        "mixed": F.max((F.col("kind") == MIXED).cast("int")).over(whole),
        "low": F.min(first).over(whole), "high": F.max(first).over(whole),
        "rank": F.rank().over(Window.partitionBy("name", "run").orderBy("doc_id", "start"))})
    again = (F.col("kind") == FIRST) & (F.col("rank") > 1)
    kind = F.when(F.col("kind") != FIRST, F.col("kind")).when(F.col("rank") > 1, F.lit(REPEAT)) \
        .when((F.col("mixed") == 1) | (F.col("low") != F.col("high")), F.lit(OPEN))
    return ranked.select("doc_id", kind.alias("kind"), "start",
                         F.when(again, F.col("stop") + SPAN).otherwise(F.col("stop")).alias("stop")) \
        .where(f"kind <> {MIXED}")


def _repeats(found: DataFrame) -> DataFrame:
    """The same after the last round, where every name is of one string."""
    rank = F.rank().over(Window.partitionBy("name", "run").orderBy("doc_id", "start"))
    rows = found.withColumn("rank", rank)
    kind = F.pmod("more", F.lit(4))
    return rows.where((kind == REPEAT) | (F.col("rank") > 1)).select(
        "doc_id", F.lit(REPEAT).alias("kind"), "start",
        (F.col("start") + F.when(kind == REPEAT, F.shiftright("more", 2)).otherwise(SPAN)).alias("stop"))


def _beside(texts: DataFrame, judged: DataFrame, how: str) -> DataFrame:
    """The texts with what is known of them; the texts' exchange is the same in every round."""
    listed = judged.groupBy(F.col("doc_id").alias("of_id")).agg(
        F.collect_list(F.struct("kind", "start", "stop")).alias("k"))
    return texts.join(listed.hint("shuffle_merge"), F.col("doc_id") == F.col("of_id"), how).select(
        "doc_id", "text", F.col("k.kind").alias("kinds"), F.col("k.start").alias("starts"),
        F.col("k.stop").alias("stops"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed when a 100-byte string that covers it also starts earlier, in a document with a
    smaller id or before in the same one. Texts under 100 bytes, empty and null ones lose nothing. Rows
    that repeat an id are the same document: they neither remove from each other nor differ in what
    is removed. An empty table gives no rows.
    """
    judged = _judged(tx.plain(docs).mapInArrow(_round(GRAMS[0], first=True), FOUND))
    # Ids are never null here; with the condition said, the exchange is the same under every join.
    texts = tx.plain(docs).mapInArrow(_packed, "doc_id long, text binary").where("doc_id IS NOT NULL")
    for length in GRAMS[1:]:
        judged = _judged(_beside(texts, judged, "inner").mapInArrow(_round(length), FOUND))
    repeats = _repeats(_beside(texts, judged, "inner").mapInArrow(_round(None), FOUND))
    return _beside(texts, repeats, "left").select("doc_id", "text", "starts", "stops").mapInArrow(
        _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string") \
        .withColumn("doc_id", tx.given_id())
