"""Arrow text columns as flat byte arrays, and words found in them without a loop over characters.

Conventions shared by all operators here: a null text is an empty text; a null ``doc_id`` counts as
the largest id and comes back as null; columns beyond the named ones are ignored, so clashing names
cannot disturb a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from headway.llm import workers
from headway.session import materialise

NO_ID = 2**63 - 1
#: A task works on so many bytes of text at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text, typed, with ids for rows that have none."""
    return docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       docs[text].cast("string").alias("text"))


def given_id(column: str = "doc_id") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(column)


# Bit tables: sets of keys in a fixed number of bits. What is in the set always passes; what is not mostly does
# not, less reliably the more keys there are. They only save work before an exact join.

TABLE_BITS = 24
_STEP = np.uint64(0xD6E8FEB86659FD93)


def table_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys >> np.uint64(64 - bits), (keys * _STEP) >> np.uint64(64 - bits)


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, two = ((table[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
                for p in table_places(keys, 5 + len(table).bit_length()))
    return one & two


def bit_table(keyed: DataFrame, keys: Callable[[list[np.ndarray]], np.ndarray], bits: int = TABLE_BITS) -> np.ndarray:
    """The table of ``keys(columns)`` over long columns: 2**bits bits, and up to twice that on its way to the driver."""
    def gathered(batches):
        table = np.zeros(1 << bits - 6, np.uint64)
        for batch in batches:
            own = keys([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])
            for places in table_places(own, bits):
                np.bitwise_or.at(table, places >> np.uint64(6), np.uint64(1) << (places & np.uint64(63)))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(signed(table[at]))], names=["at", "bits"])

    made = keyed.mapInArrow(workers.frugal(gathered), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << bits - 6, np.uint64)
    table[made["at"].to_numpy()] = made["bits"].to_numpy().view(np.uint64)
    return table


def id_keys(columns: list[np.ndarray]) -> np.ndarray:
    return mixed(columns[0] + np.uint64(0x9E3779B97F4A7C15))


def id_table(ids: DataFrame):
    """A broadcast bit table of a column of ids."""
    return ids.sparkSession.sparkContext.broadcast(bit_table(ids, id_keys))


def listed(batch: pa.RecordBatch, table: np.ndarray) -> pa.RecordBatch:
    """The rows whose id (first column) passes the table."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return batch.filter(pa.array(passes(table, id_keys([ids]))))


def without(docs: DataFrame, judged: DataFrame, stays: Column) -> DataFrame:
    """The documents less the ids all of whose judged rows fail ``stays``.

    The ids to drop are written first, so Spark knows their size when it chooses the join.
    """
    gone = materialise(judged.groupBy(F.col("doc_id").alias("gone_id")).agg(F.max(stays).alias("stays"))
                       .where("NOT stays AND gone_id IS NOT NULL").select("gone_id"), "gone")
    return docs.join(gone, docs["doc_id"] == F.col("gone_id"), "left_anti")


def slices(batches: Iterator[pa.RecordBatch], text: int = 1,
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends, at = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row starts and the last one ends."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, starts, data = filled.buffers()
    bounds = np.frombuffer(starts, np.int64)[filled.offset:filled.offset + len(filled) + 1]
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, from differences of one running sum; ``which`` of two functions."""
    base = _BASES[which]
    bits = max(16, int(len(data)).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * _powers(base, bits)[:len(data)], out=total[1:])
    spans = (total[ends] - total[starts]) * _powers(pow(base, -1, 2**64), bits)[starts]
    return mixed(spans + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space: where they start and end, and the row of each."""
    ink = np.zeros(len(data) + 2, bool)
    ink[1:-1] = ~SPACE[data]
    here, first, last = ink[1:-1], ~ink[:-2], ~ink[2:]
    edges = bounds[:-1][np.diff(bounds) > 0]
    first[edges] = True
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    starts, ends = np.flatnonzero(here & first), np.flatnonzero(here & last) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, letters A-Z in lower case."""
    starts, ends, rows = words(data, bounds)
    return span_hashes(LOWER[data], starts, ends), rows


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``size`` words; a row with fewer words gives its whole sequence."""
    n = len(hashes)
    mult = np.uint64(0xA0761D6478BD642F)
    if n >= size:
        run = hashes[:n - size + 1].copy()
        for k in range(1, size):
            run = run * mult + hashes[k:n - size + 1 + k]
        inside = rows[:n - size + 1] == rows[size - 1:]
        out, of = mixed(run[inside]), rows[:n - size + 1][inside]
    else:
        out, of = np.zeros(0, np.uint64), np.zeros(0, rows.dtype)
    counts = np.bincount(rows) if n else np.zeros(0, int)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        at = np.searchsorted(rows, short)
        own = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            own[has] = own[has] * mult + hashes[at[has] + k]
        out = np.concatenate([out, mixed(own + counts[short].astype(np.uint64))])
        of = np.concatenate([of, short.astype(of.dtype)])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
