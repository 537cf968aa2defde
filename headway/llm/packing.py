"""Best-fit packing planned on a histogram of lengths.

Texts are tokenized and cut into pieces of at most one sequence. Only the number of pieces of each
length reaches the driver, a table of ``limit`` rows at most; best fit, longest first, is run over
those counts and yields ranges of ranks that go to ranges of sequences. Every piece then finds its
place by its rank among the pieces of its length. Ranks are counted in salted shares, so a length
that many pieces have is ranked by many tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from headway.llm import subwords, text as tx, workers
from headway.session import materialise

LIMIT = 2048
END = (0).to_bytes(4, "little")
#: Pieces that one task ranks.
SHARE_ROWS = 50_000


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = subwords.encoder(tokenizer)
        for batch in tx.slices(batches):
            ids = batch.column(0).to_pylist()
            texts = pc.fill_null(batch.column(1).cast(pa.binary()), b"").to_pylist()
            rows = []
            for doc, raw in zip(ids, encoder.encode(texts), strict=True):
                raw += END
                for k, at in enumerate(range(0, len(raw), 4 * limit)):
                    part = raw[at:at + 4 * limit]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int32() if i == 1 else pa.int64()) for i in range(5)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return tx.plain(docs).mapInArrow(
        workers.frugal(cut, subwords.KEPT_AS), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: rows (length, first rank, end rank, first sequence, offset).

    The longest lengths come first; a piece goes to the fullest sequence that has room. Sequences in
    the same state are handled as ranges, so the work depends on the lengths, not on the pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # the keys of room, sorted
    rows, opened = [], 0

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                bisect.insort(sizes, free)
                room[free] = []
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                free = sizes[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], sizes[at]
            else:
                free, first = limit, opened
                n = -(-left // (limit // length))
                opened += n
            layers = free // length
            full = min(n, left // layers)
            for k in range(layers if full else 0):
                rows.append((length, rank, rank + full, first, limit - free + k * length))
                rank += full
            put(free - layers * length, first, full)
            left -= full * layers
            if full < n:
                rest = left if left < layers else 0
                for k in range(rest):
                    rows.append((length, rank, rank + 1, first + full, limit - free + k * length))
                    rank += 1
                put(free - rest * length, first + full, 1)
                put(free, first + full + 1, n - full - 1)
                left -= rest
    return rows


def packed(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document ends with id 0, so an empty or null text is one piece of length 1. Rows that repeat
    an id are packed each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, limit), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    shares = max(1, sum(counts.values()) // SHARE_ROWS)
    salted = cut.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)))
    before = salted.groupBy("length", "share").count().select(
        "length", "share", (F.sum("count").over(Window.partitionBy("length").orderBy("share"))
                            - F.col("count")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "share"]).withColumn("rank", F.col("rank") + F.col("before"))
    slots = spark.createDataFrame(
        plan(counts, limit), "length long, lo long, hi long, first long, offset long")
    # The plan's rows are bounded by limit squared, whatever the input.
    return ranked.join(F.broadcast(slots), "length").where("rank >= lo AND rank < hi").select(
        tx.given_id(), "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
