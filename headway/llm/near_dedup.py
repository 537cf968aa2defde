"""Near duplicates by MinHash bands and odd sketches, confirmed on full shingle sets.

Every distinct shingle set is one class. Its MinHash samples give band keys, which find candidates,
and are folded into a parity bitmap (an odd sketch); the population count of the XOR of two bitmaps
estimates how many samples differ, most precisely where sets are alike, and drops most candidates
inside the join. What is left is confirmed on the full sets.

A bucket of a band is first linked as a star to the member that meets most others, a row each. Once components are
known, a bucket whose members are all in one component needs nothing more; only in the others are
members of different components compared. So a large group of copies costs one row per member and
band, and no candidate of any bucket is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from headway.llm import text as tx, workers
from headway.llm.components import components
from headway.session import discard, materialise

WORDS = 5
SIMILAR = 75  # hundredths
#: A pair at the threshold shares no band once in 190,000 cases.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: At the threshold the bitmaps differ in 57 bits on average, with a deviation of 8.6.
SKETCH_LIMIT = 96
ROWS_AT_ONCE = 4096
#: Larger sets are fetched for the pairs that need them.
CARRIED = 400
#: So many of a pair's common 32-bit hashes may coincide; three of 400 do so once in 10**15 sets.
SHORT_SLACK = 2
_SET_BITS = np.uint64(52)
_SET_MASK = np.uint64((1 << 52) - 1)
_MULTIPLIERS = tx.mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E37)) | np.uint64(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted by row: their rows and 52-bit hashes."""
    hashes, rows = tx.shingle_hashes(*tx.word_hashes(*tx.flat(column)), WORDS)
    packed = np.sort(rows.astype(np.uint64) << _SET_BITS | hashes & _SET_MASK)
    if len(packed):
        packed = packed[np.append(True, packed[1:] != packed[:-1])]
    return (packed >> _SET_BITS).astype(np.int64), packed & _SET_MASK


def _parts(batches, text=1):
    for batch in tx.slices(batches, text):
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values))


def _signatures(batches):
    for batch in _parts(batches):
        n = batch.num_rows
        rows, shingles = shingle_sets(batch.column(1))
        counts = np.bincount(rows, minlength=n)
        full = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[full]
        spread = tx.mixed(shingles)
        sums = sums_of(shingles, counts)
        least = np.zeros((len(full), SAMPLES), np.uint64)
        if len(full):
            for k, m in enumerate(_MULTIPLIERS):
                least[:, k] = np.minimum.reduceat(((spread * m) >> np.uint64(32)).astype(np.uint32), starts)
        bands = np.zeros((len(full), BANDS), np.uint64)
        for k in range(ROWS):
            bands = bands * np.uint64(0xA0761D6478BD642F) + least[:, k::ROWS]
        bands = tx.mixed(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        bit = tx.mixed(least + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(40))) & np.uint64(SKETCH_BITS - 1)
        flat = (np.arange(len(full))[:, None] * SKETCH_BITS + bit.astype(np.int64)).ravel()
        parity = np.bincount(flat, minlength=len(full) * SKETCH_BITS) & 1
        sketch = np.packbits(parity.astype(np.uint8)).view(np.int64)
        has = (counts > 0).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts), pa.array(tx.signed(sums[0])), pa.array(tx.signed(sums[1])),
             _lists(tx.signed(bands.ravel()), has * BANDS), _lists(sketch, has * (SKETCH_BITS // 64))],
            names=["doc_id", "n", "s1", "s2", "bands", "sketch"])


def _set_reader(table, largest: int | None):
    """Sets of the rows whose id passes the table; with ``largest``, only smaller ones, of 32-bit hashes."""
    def sets(batches):
        for batch in _parts(tx.listed(b, table.value) for b in batches):
            n = batch.num_rows
            rows, shingles = shingle_sets(batch.column(1))
            counts = np.bincount(rows, minlength=n)
            sums = sums_of(shingles, counts)
            if largest is None:
                values, short = shingles.astype(np.int64), np.ones(n, bool)
            else:
                short = counts <= largest
                shingles, rows = shingles[short[rows]], rows[short[rows]]
                values = np.sort(rows.astype(np.int64) << 32 | (shingles & np.uint64(0xFFFFFFFF)).astype(np.int64))
                values = (values & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
            lists = _lists(values, np.where(short, counts, 0))
            found = pa.RecordBatch.from_arrays(
                [pa.array(counts), pa.array(tx.signed(sums[0])), pa.array(tx.signed(sums[1])), lists],
                names=["n", "s1", "s2", "shingles"])
            yield found.filter(pa.array(short & (counts > 0)))

    return sets


def sums_of(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two content sums of each row's set, by which equal sets are known."""
    spread, sums = tx.mixed(shingles), np.zeros((2, len(counts)), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        sums[0, full] = np.add.reduceat(spread, starts)
        sums[1, full] = np.add.reduceat(tx.mixed(spread + np.uint64(0x51ED)), starts)
    return sums


def class_sets(texts: DataFrame, wanted: DataFrame, largest: int | None = None) -> DataFrame:
    """(cid, shingles) of the wanted classes. Only texts whose id may be that of a class leave their place."""
    table = tx.id_table(wanted.select("first_id"))
    kind = "int" if largest else "long"
    found = texts.mapInArrow(workers.frugal(_set_reader(table, largest)), f"n long, s1 long, s2 long, shingles array<{kind}>") \
        .groupBy("n", "s1", "s2").agg(F.first("shingles").alias("shingles"))
    return wanted.select("cid", "n", "s1", "s2").join(found, ["n", "s1", "s2"]).select("cid", "shingles")


def _alike(a: str, b: str) -> Column:
    """The sizes allow the similarity, and the bitmaps are close enough."""
    differ = sum((F.bit_count(F.col(f"{a}sketch")[k].bitwiseXOR(F.col(f"{b}sketch")[k]))
                  for k in range(SKETCH_BITS // 64)), F.lit(0))
    return (100 * F.least(f"{a}n", f"{b}n") >= SIMILAR * F.greatest(f"{a}n", f"{b}n")) & \
        (differ <= SKETCH_LIMIT)


def _named(reps: DataFrame, prefix: str) -> DataFrame:
    return reps.select(F.col("cid").alias(f"{prefix}id"), F.col("n").alias(f"{prefix}n"),
                       F.col("sketch").alias(f"{prefix}sketch"))


def confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough, as a written table."""
    pairs = materialise(pairs, "candidates")
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    wanted = materialise(reps.join(ids, "cid", "left_semi").select("cid", "first_id", "n", "s1", "s2"), "wanted")
    sets = materialise(class_sets(texts, wanted), "sets")
    hubs = sets.join(pairs.select(F.col("b").alias("cid")).distinct(), "cid", "left_semi")
    joined = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a") \
        .join(hubs.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b") \
        .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"),
                F.size(F.array_intersect("sa", "sb")).alias("both"))
    links = materialise(joined.where(f"100 * both >= {SIMILAR} * (na + nb - both)").select("a", "b"), "links")
    discard(pairs, wanted, sets)
    return links


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when the sets of their five-word shingles have a similarity of 0.75 or more.
    A null text or one without words has an empty set and is linked with nothing. Rows that repeat an
    id, and rows without one, are documents of their own, each with its own set; a null id counts as the
    largest, and stays null also as a component. An empty table gives no rows.
    """
    texts = tx.plain(docs)
    signed = materialise(texts.mapInArrow(
        workers.frugal(_signatures), "doc_id long, n long, s1 long, s2 long, bands array<long>, sketch array<long>"),
        "signatures")
    # A class is a distinct set; its number serves no longer than this run.
    reps = materialise(signed.where("n > 0").groupBy("n", "s1", "s2").agg(
        F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    rows = reps.select("cid", F.explode("bands").alias("key"))

    sizes = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialise(rows.join(sizes, "key"), "buckets")
    # The member that meets most others is the most likely source of the rest of a bucket.
    met = shared.groupBy("cid").agg(F.sum("members").alias("met"))
    hubs = shared.join(met, "cid").groupBy("key").agg(
        F.max(F.struct("met", (-F.col("cid")).alias("minus"))).alias("hub")) \
        .select("key", (-F.col("hub.minus")).alias("hub"))
    sharing, shared = shared, materialise(shared.join(hubs, "key"), "buckets")
    discard(sharing)
    stars = shared.where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()
    likely = stars.join(_named(reps, "a"), F.col("a") == F.col("aid")) \
        .join(_named(reps, "b"), (F.col("b") == F.col("bid")) & _alike("a", "b")).select("a", "b")
    links = confirmed(likely, reps, texts)

    # Buckets of three or more that hold several components: the pairs the stars did not try.
    labels = components(links)
    large = shared.where("members > 2")
    marked = materialise(large.join(labels, large["cid"] == labels["id"], "left")
                         .select("key", "cid", "hub", F.coalesce("label", "cid").alias("label")), "marked")
    mixed = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")) \
        .where("low <> high").select("key")
    rest = marked.join(mixed, "key", "left_semi").where("cid <> hub").drop("hub")
    rest = materialise(rest.join(reps.select("cid", "n", "sketch"), "cid"), "open")
    discard(shared, marked)
    # Rows that no row of another component comes near to need no set.
    one, two = (rest.select(*[F.col(c).alias(f"{p}{c}") for c in ("key", "label", "cid", "n", "sketch")]) for p in "ab")
    near = one.join(two, (F.col("akey") == F.col("bkey")) & (F.col("alabel") != F.col("blabel")) & _alike("a", "b"),
                    "left_semi").select(F.col("akey").alias("key"), F.col("alabel").alias("label"),
                                        F.col("acid").alias("cid"))
    near = materialise(near, "near")
    discard(rest)
    # Sets of ordinary size come along, so that the join itself gives links only; of 32-bit hashes, with
    # some slack for those that coincide.
    wanted = materialise(reps.join(near.select("cid").distinct(), "cid", "left_semi"), "wanted")
    sets = materialise(class_sets(texts, wanted, CARRIED), "sets")
    full = materialise(wanted.select("cid", "n", "sketch", "bands").join(sets, "cid", "left"), "open")
    discard(sets)
    rows = near.join(full, "cid")
    columns = ("key", "label", "cid", "n", "sketch", "bands", "shingles")
    one, two = (rows.select(*[F.col(c).alias(f"{p}{c}") for c in columns]) for p in "ab")
    both = F.size(F.array_intersect("ashingles", "bshingles"))
    cross = one.join(two, (F.col("akey") == F.col("bkey")) & (F.col("alabel") < F.col("blabel")) & _alike("a", "b")
                     # Of the bands that a pair shares, only the first one gives it.
                     & (F.element_at(F.array_intersect("abands", "bbands"), 1) == F.col("akey"))
                     & (F.col("ashingles").isNull() | F.col("bshingles").isNull()
                        | (100 * (both + SHORT_SLACK) >= SIMILAR * (F.col("an") + F.col("bn") - both - SHORT_SLACK)))) \
        .select(F.col("acid").alias("a"), F.col("bcid").alias("b")).distinct()
    more = confirmed(cross, reps, texts)
    discard(near, wanted, full)
    if not more.isEmpty():
        discard(labels)
        labels = components(links.union(more))

    named = reps.join(labels, reps["cid"] == labels["id"], "left").select(
        "n", "s1", "s2", "first_id", F.coalesce("label", "cid").alias("label"))
    lowest = named.groupBy("label").agg(F.min("first_id").alias("component"))
    found = materialise(named.join(lowest, "label").select("n", "s1", "s2", "component"), "found")
    return signed.join(found, ["n", "s1", "s2"], "left").select(
        tx.given_id(), F.col("n").alias("n_shingles"),
        F.nullif(F.coalesce("component", "doc_id"), F.lit(tx.NO_ID)).alias("component_id"),
        (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each group, with its columns; rows without an id always stay."""
    return tx.without(docs, near_groups(docs), F.col("kept"))
