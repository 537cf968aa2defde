"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text without white space is cut into chunks; each chunk is hashed on its own, and the chunk hashes are
joined by shifting each one by the length that precedes it, so a huge text never has to be hashed in
one sequential pass. Texts with equal fingerprints are compared chunk by chunk in an aggregate whose
map side already folds equal chunks, so a group of any size costs one row per task and chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from headway.llm import text as tx, workers
from headway.session import materialise

CHUNK = 4096
COMPARE_BYTES = 65536
#: Two primes below 2**31 and a base for each; terms of a chunk stay below 2**52.
MODULI = ((2147483647, 1103515249), (2147483629, 872955137))


def _ladder(base: int, prime: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a base, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have:have + take] = out[:take] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += take
    return out


_CHUNK_POWERS = [_ladder(b, p, CHUNK) for p, b in MODULI]


def combine(left: int, left_length: int, right: int, modulus: int = 0) -> int:
    """The fingerprint of a concatenation from the fingerprints of its parts."""
    prime, base = MODULI[modulus]
    return (left + right * pow(base, left_length, prime)) % prime


def fingerprints(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each modulus, the fingerprint of each row of bytes."""
    sizes = np.diff(bounds)
    chunks = -(-sizes // CHUNK)
    of = np.repeat(np.arange(len(sizes)), chunks)
    number = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    starts = bounds[:-1][of] + number * CHUNK
    within = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) \
        if len(starts) else np.zeros(0, np.int64)
    out = []
    for (prime, base), powers in zip(MODULI, _CHUNK_POWERS, strict=True):
        total = np.zeros(len(sizes), np.uint64)
        if len(starts):
            each = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[within], starts)
            shift = _ladder(pow(base, CHUNK, prime), prime, int(chunks.max()))
            each = each % np.uint64(prime) * shift[number] % np.uint64(prime)
            np.add.at(total, of, each)
        out.append(total % np.uint64(prime))
    return out


def _stripped(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = tx.flat(column)
    keep = ~tx.SPACE[data]
    counts = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], counts[bounds]


def _prints(batches):
    for batch in tx.slices(batches):
        data, bounds = _stripped(batch.column(1))
        one, two = fingerprints(data, bounds)
        raw = data.tobytes()
        sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64()),
             pa.array(np.diff(bounds)), pa.array((one << np.uint64(31) | two).view(np.int64)),
             pa.array(sha, pa.string())], names=["doc_id", "n_chars", "n_bytes", "print", "text_sha256"])


def _chunk_reader(table):
    """Chunks of the texts whose id passes the table. The table is used here, so that a task needs one Python worker."""
    def chunks(batches):
        for batch in tx.slices(tx.listed(b, table.value) for b in batches):
            data, bounds = _stripped(batch.column(1))
            raw, cut = data.tobytes(), [(k, a + i) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))
                                        for i in range(0, b - a, COMPARE_BYTES)]
            rows = np.array([k for k, _ in cut], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(np.diff(bounds)[rows]),
                 pa.array([int(at - bounds[k]) for k, at in cut], pa.int64()),
                 pa.array([raw[at:min(at + COMPARE_BYTES, bounds[k + 1])] for k, at in cut], pa.binary())],
                names=["doc_id", "n_bytes", "at", "chunk"])

    return chunks


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_bytes, print and text_sha256 of every document."""
    return tx.plain(docs).mapInArrow(
        workers.frugal(_prints), "doc_id long, n_chars long, n_bytes long, print long, text_sha256 string")


def conflicts(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Fingerprints (print, n_bytes) whose texts differ in some chunk."""
    repeated = prints.groupBy("print", "n_bytes").count().where("count > 1 AND n_bytes > 0")
    members = prints.join(repeated.drop("count"), ["print", "n_bytes"], "left_semi") \
        .select("doc_id", "print", "n_bytes").distinct()
    members = materialise(members, "members")
    read = _chunk_reader(tx.id_table(members.select("doc_id")))
    chunks = tx.plain(docs).mapInArrow(workers.frugal(read), "doc_id long, n_bytes long, at long, chunk binary") \
        .join(members, ["doc_id", "n_bytes"])
    seen = chunks.groupBy("print", "n_bytes", "at", "chunk").agg(F.lit(1).alias("one"))
    return seen.groupBy("print", "n_bytes", "at").count().where("count > 1") \
        .select("print", "n_bytes").distinct()


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space. Null and empty texts are equal to each
    other. Of equal texts the one with the most code points stays, then the smallest id; rows that
    repeat an id stay or go together. An empty table gives no rows.
    """
    prints = materialise(fingerprinted(docs), "prints")
    differing = conflicts(docs, prints).withColumn("differ", F.lit(True))
    keyed = prints.join(differing, ["print", "n_bytes"], "left").select(
        "doc_id", "n_chars", "n_bytes", "print", "text_sha256",
        F.when(F.col("differ"), F.col("text_sha256")).otherwise("").alias("part"))
    key = ["print", "n_bytes", "part"]
    best = keyed.groupBy(*key).agg(
        F.count("*").alias("group_size"),
        F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus_id"))).alias("best"))
    return keyed.join(best, key).select(
        tx.given_id(), F.when(-F.col("best.minus_id") != tx.NO_ID, -F.col("best.minus_id")).alias("keep_id"),
        "group_size", (F.col("doc_id") == -F.col("best.minus_id")).alias("kept"), "text_sha256")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns; rows without an id always stay."""
    return tx.without(docs, exact_groups(docs), F.col("kept"))
