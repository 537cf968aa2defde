"""Benchmark decontamination: a BM25 index of test items, queried by every training passage.

The index holds the items, cut into segments no longer than half a passage, as impact-ordered blocks:
each posting's BM25 weight is divided by the segment's weight for its own text, so 1 means that a
passage has every word of it. Every passage of every document is a query. Bounds by block of segments,
summed for many passages at once, leave out passages that cannot reach the threshold in any block; for
the others block-max WAND finds every segment above it. A find counts when the item's question and
its answer both overlap with the document.

The index of one shard has at most ``SHARD_BYTES`` of item text and is sent to the tasks; a larger
benchmark is worked through in several shards with common statistics, and gives the same rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from headway.llm import text as tx, workers

K1, B = 1.2, 0.75
PASSAGE, STRIDE = 128, 64
#: Any segment lies within some passage whole.
SEGMENT = STRIDE
BLOCK = 4
THRESHOLD = 0.6
OVERLAP = 0.75
WORDS = 5
SHARD_BYTES = 4 << 20
#: An answer is judged with the words before it if it has fewer words.
ANSWER_WORDS = 8
#: The most frequent words, as long as no segment has more of its weight in them, enter the bound of a
#: block as the most that any of its segments has in them.
COMMON = 0.4
#: Sums of bounds held at a time.
SUMS = 1 << 21
_ANSWER = re.compile(r"(?is)^(.*?\s)((?:answer|a)\s*:.*)$")
_QUESTION = re.compile(r"(?s)^(.*\?)(\s.*\S.*)$")
_LAST = re.compile(r"(?s)^(.*[.!]\s+)(\S.*)$")


def question_and_answer(text: str) -> tuple[str, str]:
    """The parts of an item: at an answer mark, after the last question mark, or before the last sentence.

    An item of one sentence is both.
    """
    for pattern in (_ANSWER, _QUESTION, _LAST):
        found = pattern.match(text.strip())
        if found:
            return found[1], found[2]
    return text, text


def _hashes(texts: list[str]) -> list[np.ndarray]:
    data, bounds = tx.flat(pa.array(texts, pa.string()))
    hashes, rows = tx.word_hashes(data, bounds)
    return np.split(hashes, np.searchsorted(rows, np.arange(1, len(texts)))) if texts else []


def _runs(words: np.ndarray) -> np.ndarray:
    """Distinct five-word shingles, or the whole sequence if it is shorter."""
    size = max(1, min(WORDS, len(words)))
    return np.unique(tx.shingle_hashes(words, np.zeros(len(words), np.int64), size)[0])


def segments(words: np.ndarray) -> list[np.ndarray]:
    return [words[at:at + SEGMENT] for at in range(0, len(words), SEGMENT)]


@dataclass
class Index:
    items: list[int]
    of_item: list[int]            # segment -> item
    terms: np.ndarray             # sorted hashes
    postings: list[tuple[list[int], list[float]]]
    blocks: list[list[float]]     # largest weight of each block of postings
    most: np.ndarray              # largest weight of a term
    spare: np.ndarray             # by block of segments, the most that common words add
    bounds: np.ndarray            # weights of the other words: the largest in each block,
    in_block: np.ndarray          # the block,
    of_term: np.ndarray           # and where the rows of each term start
    parts: list[tuple]            # question and answer shingles of each item


def build(items: list[tuple[int, str]], frequency: dict[int, int], segments_in_all: int,
          mean_length: float) -> Index:
    """The index of some items with the statistics of all."""
    words = _hashes([t for _, t in items])
    cut = [(i, s) for i, w in enumerate(words) for s in segments(w)]
    rows: dict[int, list[tuple[int, float]]] = {}
    for k, (_, segment) in enumerate(cut):
        terms, counts = np.unique(segment, return_counts=True)
        idf = [math.log(1 + (segments_in_all - frequency[int(t)] + 0.5) / (frequency[int(t)] + 0.5))
               for t in terms]
        weights = np.array(idf) * counts * (K1 + 1) / (
            counts + K1 * (1 - B + B * len(segment) / mean_length))
        for t, w in zip(terms.tolist(), (weights / weights.sum()).tolist()):
            rows.setdefault(t, []).append((k, w))
    terms = np.array(sorted(rows), np.uint64)
    postings = [([k for k, _ in rows[t]], [w for _, w in rows[t]]) for t in terms.tolist()]
    most = np.array([max(w) for _, w in postings])
    frequent = sorted(range(len(terms)), key=lambda t: -len(postings[t][0]))
    shared, common = np.zeros(len(cut)), set()
    for t in frequent:
        ids, weights = postings[t]
        if (shared[ids] + weights).max() > COMMON:
            break
        shared[ids] += weights
        common.add(t)
    spare = np.array([shared[at:at + BLOCK].max() for at in range(0, len(cut), BLOCK)])
    bounds, in_block, of_term = [], [], [0]
    for t, (ids, weights) in enumerate(postings):
        largest: dict[int, float] = {}
        for k, w in zip(ids if t not in common else (), weights):
            largest[k // BLOCK] = max(w, largest.get(k // BLOCK, 0.0))
        in_block += largest
        bounds += largest.values()
        of_term.append(len(bounds))
    both = [question_and_answer(t) for _, t in items]
    parts = []
    for whole, question, answer in zip(words, _hashes([q for q, _ in both]), _hashes([a for _, a in both])):
        answer = whole[-max(ANSWER_WORDS, len(answer)):]
        parts.append(tuple((max(1, min(WORDS, len(p))), _runs(p)) for p in (question, answer)))
    return Index([i for i, _ in items], [i for i, _ in cut], terms, postings,
                 [[max(w[at:at + BLOCK]) for at in range(0, len(w), BLOCK)] for _, w in postings],
                 most, spare, np.array(bounds), np.array(in_block, np.int64), np.array(of_term), parts)


def wand(index: Index, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
    """Every segment whose weight for these distinct terms reaches the threshold."""
    cursors = [[index.postings[t][0][0], 0, t, float(index.most[t])] for t in terms]
    found = []
    while cursors:
        cursors.sort(key=lambda c: c[0])
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += c[3]
            if total >= threshold - 1e-9:
                pivot = k
                break
        if pivot < 0:
            break
        target = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
            pivot += 1
        # Blocks of the lists up to the pivot that may hold the target.
        bound, beyond = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
        for c in cursors[:pivot + 1]:
            ids = index.postings[c[2]][0]
            b = c[1] // BLOCK
            while (b + 1) * BLOCK < len(ids) and ids[(b + 1) * BLOCK - 1] < target:
                b += 1
            bound += index.blocks[c[2]][b]
            last = ids[min((b + 1) * BLOCK, len(ids)) - 1]
            beyond = min(beyond, max(last, target) + 1)
        if bound >= threshold - 1e-9:
            score = 0.0
            for c in cursors[:pivot + 1]:
                ids, weights = index.postings[c[2]]
                while c[1] < len(ids) and ids[c[1]] < target:
                    c[1] += 1
                if c[1] < len(ids) and ids[c[1]] == target:
                    score += weights[c[1]]
            if score >= threshold - 1e-9:
                found.append((target, score))
            beyond = target + 1
        for c in cursors[:pivot + 1]:
            ids = index.postings[c[2]][0]
            while c[1] < len(ids) and ids[c[1]] < beyond:
                c[1] += 1
            c[0] = ids[c[1]] if c[1] < len(ids) else -1
        cursors = [c for c in cursors if c[0] >= 0]
    return found


def _lookup(index: Index, hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The term number of each word, or -1."""
    at = table[(hashes >> np.uint64(44)).astype(np.int64)]
    hit = np.flatnonzero(at >= 0)
    out = np.full(len(hashes), -1, np.int64)
    k = np.searchsorted(index.terms, hashes[hit])
    k[k == len(index.terms)] = 0
    out[hit] = np.where(index.terms[k] == hashes[hit], k, -1)
    return out


def _likely(index: Index, terms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The passages whose bound reaches the threshold in some block of segments."""
    sizes = ends - starts
    passage = np.repeat(np.arange(len(starts)), sizes)
    own = terms[np.arange(len(passage)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)]
    rows = index.of_term
    keep = own >= 0
    keep[keep] = rows[own[keep] + 1] > rows[own[keep]]
    pairs = np.sort(passage[keep] << 32 | own[keep])
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    passage, own = pairs >> 32, pairs & 0xFFFFFFFF
    many = rows[own + 1] - rows[own]
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - rows[own], many)
    blocks = len(index.spare)
    sums = np.bincount(np.repeat(passage, many) * blocks + index.in_block[at], index.bounds[at],
                       minlength=len(starts) * blocks).reshape(-1, blocks)
    return np.flatnonzero((sums + index.spare >= THRESHOLD - 1e-6).any(1))


def search(index: Index, column: pa.Array, table: np.ndarray) -> list[tuple]:
    """(row, item, score, question overlap, answer overlap, first word) of the confirmed finds."""
    hashes, rows = tx.word_hashes(*tx.flat(column))
    if not len(hashes) or not len(index.terms):
        return []
    terms = _lookup(index, hashes, table)
    counts = np.bincount(rows, minlength=len(column))
    first = np.cumsum(counts) - counts
    passages = np.maximum(1, -(-(counts - STRIDE) // STRIDE)) * (counts > 0)
    of = np.repeat(np.arange(len(counts)), passages)
    number = np.arange(len(of)) - np.repeat(np.cumsum(passages) - passages, passages)
    starts = first[of] + number * STRIDE
    ends = np.minimum(starts + PASSAGE, (first + counts)[of])
    step = max(1, SUMS // len(index.spare))
    likely = np.concatenate([_likely(index, terms, starts[at:at + step], ends[at:at + step]) + at
                             for at in range(0, len(of), step)])
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for k in likely.tolist():
        own = terms[starts[k]:ends[k]]
        for segment, score in wand(index, np.unique(own[own >= 0]).tolist()):
            key = (int(of[k]), index.of_item[segment])
            if score > best.get(key, (0.0, 0))[0] + 1e-9:
                best[key] = (score, int(starts[k] - first[of[k]]))
    out = []
    shingles: dict[tuple[int, int], np.ndarray] = {}
    for (row, item), (score, at) in best.items():
        shares = []
        for size, wanted in index.parts[item]:
            if (row, size) not in shingles:
                own = hashes[first[row]:first[row] + counts[row]]
                shingles[row, size] = tx.shingle_hashes(own, np.zeros(len(own), np.int64), size)[0] \
                    if len(own) >= size else np.zeros(0, np.uint64)
            shares.append(float(np.isin(wanted, shingles[row, size]).mean()) if len(wanted) else 1.0)
        if min(shares) >= OVERLAP:
            out.append((row, index.items[item], score, *shares, at))
    return out


def _terms(batches):
    for batch in tx.slices(batches):
        cut = [s for w in _hashes(pc.fill_null(batch.column(1), "").to_pylist()) for s in segments(w)]
        own = [np.unique(s) for s in cut]
        yield pa.RecordBatch.from_arrays(
            [pa.array(tx.signed(np.concatenate(own)) if own else [], pa.int64()),
             pa.array(np.concatenate([[len(s)] + [0] * (len(u) - 1) for s, u in zip(cut, own)]) if own else [],
                      pa.int64())], names=["term", "words"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item it contains.

    Columns: doc_id, item_id, score (1: a passage has all words of a segment of the item),
    question_overlap and answer_overlap (shares of their shingles), first_word of the best passage.
    Null and empty texts on either side match nothing; items without an id are left out; rows that
    repeat an id give one row with the best values. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = tx.plain(benchmark, "item_id").where(f"doc_id <> {tx.NO_ID} AND text IS NOT NULL")
    terms = items.mapInArrow(workers.frugal(_terms), "term long, words long")
    size = terms.agg(F.sum("words"), F.sum((F.col("words") > 0).cast("long"))).first()
    spans = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-spans // SHARD_BYTES))
    frequency = terms.groupBy("term").count()
    texts, found = tx.plain(docs), None
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)) == k)
        counts = frequency.join(part.mapInArrow(workers.frugal(_terms), "term long, words long"), "term", "left_semi")
        known = {r["term"] % 2**64: r["count"] for r in counts.collect()}
        index = build([(r["doc_id"], r["text"]) for r in part.orderBy("doc_id", "text").collect()],
                      known, size[1] or 0, (size[0] or 0) / max(1, size[1] or 0))
        rows = texts.mapInArrow(workers.frugal(_searcher(spark.sparkContext.broadcast(index))),
                                "doc_id long, item_id long, score double, question_overlap double,"
                                " answer_overlap double, first_word long")
        found = rows if found is None else found.union(rows)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("minus"), "question_overlap", "answer_overlap"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        tx.given_id(), "item_id", F.round("best.score", 9).alias("score"), "best.question_overlap",
        "best.answer_overlap", (-F.col("best.minus")).alias("first_word"))


def _searcher(sent):
    def run(batches):
        index = sent.value
        table = np.full(1 << 20, -1, np.int32)
        table[(index.terms >> np.uint64(44)).astype(np.int64)] = 0
        for batch in tx.slices(batches):
            rows = search(index, batch.column(1), table)
            ids = batch.column(0).to_pylist()
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            cols = list(zip(*((ids[r[0]], *r[1:]) for r in rows))) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)],
                names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

    return run


def kept_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no test item, with their columns; rows without an id always stay."""
    return tx.without(docs, leaks(docs, benchmark), F.lit(False))
