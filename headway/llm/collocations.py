"""Phrases that stand together more often than their parts would, by direct-address tiles of ranked ids.

Words are counted first and ranked by frequency. A task counts pairs of a ranked left symbol and a ranked
word: the plane of rank pairs is cut into square tiles, a tile that a buffer fills well is counted with
one dense ``bincount``, every other occurrence goes through sorted coordinates (COO). Frequent pairs are
then ranked as symbols of their own, and the same step with them on the left gives phrases one word
longer. Words stand for themselves as 64-bit keys of (language, word); a job proves that no two share one.

Only phrases whose parts are frequent can be frequent. Tasks see that through a bit table of fixed size,
whose errors cost work and never a count. Ranks reach the tasks for the ``HEAD`` most frequent symbols;
what is rarer is counted as coordinates.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.llm import text as tx
from headway.session import materialise

LEAST, LONGEST, FIRST = 10, 3, 2000
#: Of a longer candidate, in hundredths of the shorter one's count, that drops the shorter one.
COVERED = 50
UNKNOWN = "und"
#: Ranked symbols of a side, and ranks along the side of a tile.
HEAD, TILE = 4096, 512
#: A tile is counted densely when so many of its cells' number stand in the buffer.
DENSE = TILE * TILE // 8
BUFFER = 1 << 20
TEXT_AT_ONCE = 3 << 20
FILTER_BITS = 26
#: Parts in which the first places of a language are sought before they are ranked together.
PARTS = 256

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, row and piece of every word; words of one piece stand in a row without a break."""
    broken = _BREAK[data]
    ink = ~(broken | _BLANK[data])
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before, after = np.append(False, ink[:-1]), np.append(ink[1:], False)
    starts = np.flatnonzero(ink & (~before | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    rows = np.searchsorted(bounds, starts, "right") - 1
    return starts, ends, rows, np.cumsum(broken)[starts] + rows


def word_keys(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray, seed: int) -> np.ndarray:
    """A key for each word and its language; ``of`` is a number of the language."""
    keys = tx.span_hashes(lowered, starts, ends)
    if seed:
        keys = keys * np.uint64(2 * seed + 1) + tx.span_hashes(lowered, starts, ends, 1)
    return tx.mixed(keys + of * _STEP)


def _read(batch, seed):
    """Bytes, spans, rows, pieces and keys of the words of a batch (lang, text), and their languages' numbers."""
    data, bounds = tx.flat(batch.column(1))
    lowered = tx.LOWER[data]
    starts, ends, rows, piece = spans(data, bounds)
    langs = batch.column(0).dictionary_encode()
    name, at = tx.flat(langs.dictionary)
    number = tx.span_hashes(name, at[:-1], at[1:])[langs.indices.to_numpy(zero_copy_only=False)]
    of = tx.mixed(number)[rows]
    return lowered, starts, ends, rows, piece, word_keys(lowered, starts, ends, of, seed), of


def _word_counter(seed):
    def count(batches):
        for batch in tx.slices(batches, limit=TEXT_AT_ONCE):
            lowered, starts, ends, rows, _, keys, of = _read(batch, seed)
            kinds, first, kind, counts = np.unique(keys, True, True, True)
            # Words that only share the key of the first one are given one by one, so that they are seen.
            second = tx.span_hashes(lowered, starts, ends, 1) + of
            other = np.flatnonzero(second != second[first][kind])
            np.subtract.at(counts, kind[other], 1)
            first = np.append(first, other)
            kinds, counts = keys[first], np.append(counts, np.ones(len(other), counts.dtype))
            raw = lowered.tobytes()
            named = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[first])), pa.array(named, pa.binary()).cast(pa.string()),
                 pa.array(tx.signed(kinds)), pa.array(counts.astype(np.int64))],
                names=["lang", "word", "key", "f"])

    return count


def phrase_keys(keys: list[np.ndarray]) -> np.ndarray:
    """One key for words side by side; not proven unique, so it only finds what is compared word by word."""
    return reduce(lambda left, word: tx.mixed(left * _STEP + word), keys)


def bit_table(phrases: DataFrame, length: int) -> np.ndarray:
    return tx.bit_table(phrases.select(*_names(length)), phrase_keys, FILTER_BITS)


def head(phrases: DataFrame, length: int) -> np.ndarray:
    """Word keys of the ``HEAD`` most frequent phrases, one row a rank."""
    names = _names(length)
    top = phrases.orderBy(F.desc("f"), *names).select(*names).limit(HEAD).toArrow()
    return np.stack([top[n].to_numpy().view(np.uint64) for n in names], axis=1)


def _names(length: int, first: int = 1) -> list[str]:
    return [f"k{i}" for i in range(first, first + length)]


class Ranks:
    """Rank of a phrase among the most frequent ones, or -1."""

    def __init__(self, top: np.ndarray):
        self.top, keys = top, phrase_keys(list(top.T))
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def __call__(self, words: list[np.ndarray]) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(words[0]), -1)
        wanted = phrase_keys(words)
        at = self.order[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)]
        same = reduce(np.logical_and, (self.top[at, k] == w for k, w in enumerate(words)))
        return np.where(same, at, -1)


class Tiles:
    """Counts of (left symbol, word) occurrences of a task: dense tiles, and sorted coordinates for the rest."""

    def __init__(self, left: Ranks, right: Ranks):
        self.left, self.right = left, right
        self.dense: dict[int, np.ndarray] = {}
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[np.ndarray]):
        self.held.append(np.stack(words))
        self.size += len(words[0])

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        """Phrases, a column each, and counts of what no tile takes; dense tiles keep theirs until the end."""
        words = np.concatenate(self.held, axis=1)
        self.held, self.size = [], 0
        row, column = self.left(list(words[:-1])), self.right([words[-1]])
        side = HEAD // TILE
        tile = np.where((row >= 0) & (column >= 0), row // TILE * side + column // TILE, side * side)
        filled = np.bincount(tile, minlength=side * side + 1)
        full = np.flatnonzero(filled[:-1] >= DENSE)
        for t in full:
            here = tile == t
            cells = np.bincount(row[here] % TILE * TILE + column[here] % TILE, minlength=TILE * TILE)
            self.dense[int(t)] = self.dense.get(int(t), 0) + cells
        return coordinates(words[:, ~np.isin(tile, full)])

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and counts of the dense tiles."""
        side, parts, counts = HEAD // TILE, [], []
        for t, cells in self.dense.items():
            at = np.flatnonzero(cells)
            left, right = self.left.top[t // side * TILE + at // TILE], self.right.top[t % side * TILE + at % TILE]
            parts.append(np.concatenate([left, right], axis=1).T)
            counts.append(cells[at])
        return np.concatenate(parts, axis=1), np.concatenate(counts)


def coordinates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns in sorted order, and how often each stands there."""
    words = words[:, np.lexsort(words[::-1])]
    new = np.append(True, (words[:, 1:] != words[:, :-1]).any(axis=0)) if words.shape[1] else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return words[:, at], np.diff(np.append(at, words.shape[1]))


def _phrase_counter(length, seed, filters, lefts, rights):
    """Counts of the phrases of ``length`` words whose two parts, less the last or first word, may be frequent."""
    def out(phrases, counts):
        return pa.RecordBatch.from_arrays(
            [*(pa.array(tx.signed(np.ascontiguousarray(k))) for k in phrases), pa.array(counts.astype(np.int64))],
            names=[*_names(length), "f"])

    def count(batches):
        tiles = Tiles(Ranks(lefts.value), Ranks(rights.value))
        for batch in tx.slices(batches, limit=TEXT_AT_ONCE):
            *_, piece, keys, _ = _read(batch, seed)
            n = len(keys) - length + 2
            if n < 2:
                continue
            frequent = tx.passes(filters.value, phrase_keys([keys[k:n + k] for k in range(length - 1)]))
            here = np.flatnonzero(frequent[:-1] & frequent[1:] & (piece[:n - 1] == piece[length - 1:]))
            for at in range(0, len(here), BUFFER):
                tiles.add([keys[here[at:at + BUFFER] + k] for k in range(length)])
                if tiles.size >= BUFFER:
                    yield out(*tiles.flush())
        if tiles.size:
            yield out(*tiles.flush())
        if tiles.dense:
            yield out(*tiles.rest())

    return count


def counted_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, key, f) of all words, and the seed under which every key stands for one word."""
    for seed in range(8):
        words = materialise(docs.mapInArrow(_word_counter(seed), "lang string, word string, key long, f long")
                            .groupBy("lang", "word", "key").agg(F.sum("f").alias("f")), "words")
        if words.groupBy("key").count().where("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("no seed keeps the keys of all words apart")


def counted_phrases(docs: DataFrame, parts: DataFrame, words: DataFrame, length: int, seed: int,
                    least: int) -> DataFrame:
    """(k1, ..., f) of all phrases of ``length`` words with a count of ``least`` or more.

    ``parts`` has those of one word less, ``words`` those of one word.
    """
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(x) for x in (bit_table(parts, length - 1), head(parts, length - 1), head(words, 1))]
    found = docs.mapInArrow(_phrase_counter(length, seed, *shared),
                            ", ".join(f"{n} long" for n in [*_names(length), "f"]))
    return materialise(found.groupBy(*_names(length)).agg(F.sum("f").alias("f")).where(F.col("f") >= least),
                       "phrases")


def scored(phrases: dict[int, DataFrame], length: int) -> DataFrame:
    """The phrases of a length with their lowest-scoring cut: k1, ..., a, l, r, score."""
    out, cuts = phrases[length].withColumnRenamed("f", "a"), []
    for cut in range(1, length):
        for side, size, first in (("l", cut, 1), ("r", length - cut, cut + 1)):
            names = _names(size, first)
            part = phrases[size].select(*[F.col(a).alias(b) for a, b in zip(_names(size), names)],
                                        F.col("f").alias(f"{side}{cut}"))
            out = out.join(part, names)
        # Decimals of 13 digits: counts up to 10**13, products of 35 digits.
        score = F.expr(f"""(1000000BD * cast(a AS decimal(13, 0)) * cast(a AS decimal(13, 0)))
                           div (cast(l{cut} AS decimal(13, 0)) * cast(r{cut} AS decimal(13, 0)))""")
        cuts.append(F.struct(score.alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"),
                             F.col(f"r{cut}").alias("r")))
    return out.withColumn("lowest", F.array_min(F.array(*cuts))).select(*_names(length), "a", "lowest.*").drop("cut")


def uncovered(candidates: DataFrame, longer: list[tuple[int, DataFrame]], length: int) -> DataFrame:
    """The candidates that no longer phrase with half their count contains."""
    if not longer:
        return candidates
    inside = reduce(DataFrame.union, [
        phrases.select(*_names(length, first), "f").toDF(*_names(length), "f")
        for size, phrases in longer for first in range(1, size - length + 2)])
    most = inside.groupBy(*_names(length)).agg(F.max("f").alias("most"))
    return candidates.join(most, _names(length), "left") \
        .where(F.col("most").isNull() | (100 * F.col("most") < COVERED * F.col("a"))).drop("most")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """The ``first`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are split into pieces at punctuation and line ends, pieces into words at spaces and tabs; A-Z
    count as a-z. A phrase has 2 to ``longest`` words of one piece and stands there ``least`` times or
    more. A null language is ``und``, a null text is empty; rows that repeat an id, and null ids, count
    like any other, since ids are not read. Other columns are ignored. A language without candidates,
    and an empty table, give no rows. Ties go to the phrase that comes first in byte order.
    """
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit(UNKNOWN)).alias("lang"),
                        docs["text"].cast("string").alias("text"))
    words, seed = counted_words(texts)
    frequent = words.where(F.col("f") >= least)
    phrases = {1: frequent.select(F.col("key").alias("k1"), "f")}
    for length in range(2, longest + 1):
        phrases[length] = counted_phrases(texts, phrases[length - 1], phrases[1], length, seed, least)
    found = []
    for length in range(2, longest + 1):
        out = uncovered(scored(phrases, length), [(n, phrases[n]) for n in range(length + 1, longest + 1)], length)
        for k in range(1, length + 1):
            named = frequent.select(F.col("key").alias(f"k{k}"), F.col("word").alias(f"w{k}"),
                                    *([F.col("lang")] if k == 1 else []))
            out = out.join(named, f"k{k}")
        found.append(out.select("lang", F.concat_ws(" ", *[f"w{k}" for k in range(1, length + 1)]).alias("phrase"),
                                "a", "l", "r", "score"))
    return _first_places(reduce(DataFrame.union, found), first) \
        .join(words.groupBy("lang").agg(F.sum("f").alias("n")), "lang") \
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first_places(found: DataFrame, first: int) -> DataFrame:
    """Ranked within parts first, so that no task sorts a whole language."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = found.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")) \
        .where(F.col("rank") <= first).drop("part")
