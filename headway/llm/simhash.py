"""Near duplicates by SimHash fingerprints, found with a hierarchical index over their Gray order.

Fingerprints are sorted by their rank in the reflected Gray code, so neighbours agree in most bits.
Runs of neighbours form leaves, runs of leaves form nodes, and so on up to one root. A node holds the
bits that all its fingerprints share (a mask and a pattern); what the parent already fixes is not
looked at again below it. The index is joined with itself from the root down: a pair of nodes adds the
differences in the bits that both fix and their parents did not, and goes with all that lies below
once the sum exceeds the limit. Leaf pairs that remain are compared in tasks, which return the links
as a forest, so a dense group gives a row per fingerprint and leaf pair at most, not all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from headway.llm import text as tx
from headway.llm.components import components
from headway.session import materialise

WORDS = 3
SEED = 42
#: Fingerprints that differ in so many bits are still linked.
DIFFER = 2
SHINGLES_AT_ONCE = 1 << 16
#: Fingerprints of a leaf, and the power of two of children of a node.
LEAF, FAN_BITS = 256, 5
#: Links that a task gathers before it reduces them to a forest.
LINKS_AT_ONCE = 1 << 20


def tidied(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each row in lower case, its words one space apart."""
    space = tx.SPACE[data]
    after = np.append(True, space[:-1]) if len(data) else space
    after[bounds[:-1][bounds[:-1] < len(data)]] = True
    keep = ~(space & after)
    counts = np.concatenate([[0], np.cumsum(keep)])
    return np.where(space, np.uint8(32), tx.LOWER[data])[keep], counts[bounds]


def shingle_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every shingle of tidied rows, repeats included, row by row."""
    starts, ends, rows = tx.words(data, bounds)
    counts = np.bincount(rows, minlength=len(bounds) - 1) if len(rows) else np.zeros(len(bounds) - 1, int)
    first = np.cumsum(counts) - counts
    of = np.maximum(counts - WORDS + 1, counts > 0)
    row = np.repeat(np.arange(len(counts)), of)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(of) - of, of)
    last = at + np.minimum(counts[row], WORDS) - 1
    return (starts[at], ends[last], row) if len(row) else (row, row, row)


def fingerprints(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text; zero for a text without words."""
    data, bounds = tidied(*tx.flat(column))
    starts, ends, rows = shingle_spans(data, bounds)
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    ones = np.zeros((len(column), 64), np.int64)
    for at in range(0, len(rows), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        spans = zip(starts[part].tolist(), ends[part].tolist())
        hashed = np.array([digest(raw[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        edges = np.flatnonzero(np.append(True, rows[part][1:] != rows[part][:-1]))
        ones[rows[part][edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    total = np.bincount(rows, minlength=len(column))
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def _fingerprinted(batches):
    for batch in tx.slices(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(tx.signed(fingerprints(batch.column(1))))], names=["doc_id", "print"])


def gray_rank(code: Column) -> Column:
    """Place of a code in the reflected Gray sequence, as a long in signed order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-2**63))


def _leaves(batches):
    """Runs of neighbours; numbered by task and by place in it."""
    part, number, held = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)

    def cut(codes):
        nonlocal number
        bounds = np.append(np.arange(0, len(codes), LEAF), len(codes))
        at = bounds[:-1]
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), part)), pa.array(number + np.arange(len(at))),
             pa.array(np.bitwise_and.reduceat(codes, at)), pa.array(np.bitwise_or.reduceat(codes, at)),
             pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(codes))],
            names=["part", "number", "ones", "some", "codes"])
        number += len(at)
        return out

    for batch in batches:
        held = np.concatenate([held, batch.column(0).to_numpy(zero_copy_only=False)])
        whole = len(held) - len(held) % LEAF
        if whole:
            yield cut(held[:whole])
            held = held[whole:]
    if len(held):
        yield cut(held)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given links connect: each code with the first code of its tree."""
    codes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(codes))
    while True:
        one, two = label[u], label[v]
        if (one == two).all():
            break
        low = np.minimum(one, two)
        np.minimum.at(label, one, low)
        np.minimum.at(label, two, low)
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(codes))
    return codes[label[moved]], codes[moved]


def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (a, b) of two leaves within the limit; each side first loses what is too far from the other's bits."""
    for _ in range(2):
        if not len(a):
            break
        ones, some = np.bitwise_and.reduce(a), np.bitwise_or.reduce(a)
        b = b[np.bitwise_count((b ^ ones) & ~(ones ^ some)) <= DIFFER]
        a, b = b, a
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= DIFFER)
    return a[i], b[j]


def _links(batches):
    def reduced(found):
        a, b = forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
        return pa.RecordBatch.from_arrays([pa.array(tx.signed(a)), pa.array(tx.signed(b))], names=["a", "b"])

    found, count = [], 0
    for batch in batches:
        sides = []
        for k in (0, 1):
            column = batch.column(k)
            sides.append((column.flatten().to_numpy(zero_copy_only=False).view(np.uint64),
                          column.offsets.to_numpy() - column.offsets[0].as_py()))
        (one, at), (two, to) = sides
        for k in range(batch.num_rows):
            a, b = near(one[at[k]:at[k + 1]], two[to[k]:to[k + 1]])
            other = a != b
            found.append((a[other], b[other]))
            count += len(found[-1][0])
            if count >= LINKS_AT_ONCE:
                yield reduced(found)
                found, count = [], 0
    if count:
        yield reduced(found)


def leaf_pairs(leaves: DataFrame) -> DataFrame:
    """Pairs (a, b), a <= b, of leaves whose shared bits differ in few enough places."""
    top = leaves.agg(F.max("id")).first()[0]
    levels = [leaves.select("id", F.col("ones").bitwiseXOR(F.bitwise_not("some")).alias("mask"),
                            F.col("ones").alias("pattern"))]
    nodes = leaves.select("id", "ones", "some")
    while top:
        top >>= FAN_BITS
        nodes = nodes.groupBy(F.shiftright("id", FAN_BITS).alias("id")).agg(
            F.bit_and("ones").alias("ones"), F.bit_or("some").alias("some"))
        levels.append(nodes.select("id", F.col("ones").bitwiseXOR(F.bitwise_not("some")).alias("mask"),
                                   F.col("ones").alias("pattern")))
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("mask").alias("fixed"),
                              F.lit(0).alias("differ"))
    for level in reversed(levels[:-1]):
        one, two = (level.select(F.shiftright("id", FAN_BITS).alias(f"{p}up"), F.col("id").alias(f"{p}id"),
                                 F.col("mask").alias(f"{p}mask"), F.col("pattern").alias(f"{p}pattern"))
                    for p in "ab")
        both = F.col("amask").bitwiseAND(F.col("bmask"))
        added = F.bit_count(F.col("apattern").bitwiseXOR(F.col("bpattern")).bitwiseAND(both)
                            .bitwiseAND(F.bitwise_not(F.col("fixed"))))
        far = F.col("differ") + added
        pairs = pairs.join(one, F.col("a") == F.col("aup")) \
            .join(two, (F.col("b") == F.col("bup")) & (F.col("aid") <= F.col("bid")) & (far <= DIFFER)) \
            .select(F.col("aid").alias("a"), F.col("bid").alias("b"), both.alias("fixed"), far.alias("differ"))
    return pairs.select("a", "b")


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within the limit of each other."""
    ordered = prints.select("print", gray_rank(F.col("print")).alias("rank")).repartitionByRange("rank") \
        .sortWithinPartitions("rank").select("print")
    leaves = materialise(ordered.mapInArrow(
        _leaves, "part long, number long, ones long, some long, codes array<long>"), "leaves")
    width = (leaves.agg(F.max("number")).first()[0] or 0).bit_length()
    leaves = leaves.select(F.expr(f"shiftleft(part, {width}) + number").alias("id"), "ones", "some", "codes")
    if leaves.isEmpty():
        return prints.select(F.col("print").alias("a"), F.col("print").alias("b")).limit(0)
    one, two = (leaves.select(F.col("id").alias(p), F.col("codes").alias(f"{p}codes")) for p in "ab")
    pairs = leaf_pairs(leaves).join(one, "a").join(two, "b").select("acodes", "bcodes")
    return materialise(pairs.mapInArrow(_links, "a long, b long").distinct(), "links")


def similar_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    Fingerprints come from all three-word shingles of the whole text; a shorter text counts as one
    shingle. Documents whose fingerprints differ in two bits or fewer are linked; a null text or one
    without words has the fingerprint zero and is linked like any other. Rows that repeat an id are
    documents of their own; a null id counts as the largest and stays null, also as a component whose
    documents all lack an id. Other columns are ignored. An empty table gives no rows.
    """
    signed = materialise(tx.plain(docs).mapInArrow(_fingerprinted, "doc_id long, print long"), "prints")
    classes = materialise(signed.groupBy("print").agg(F.min("doc_id").alias("first")), "classes")
    labels = components(links(classes.select("print")))
    named = classes.join(labels, classes["print"] == labels["id"], "left") \
        .select("print", "first", F.coalesce("label", "print").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = materialise(named.join(lowest, "root").select("print", "component_id"), "found")
    return signed.join(found, "print").select(
        tx.given_id(), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.nullif("component_id", F.lit(tx.NO_ID)).alias("component_id"))
