"""Language identification by cross-parsing against suffix automata of labelled text.

A suffix automaton accepts exactly the substrings of a language's reference text. Reading a document
through it cuts the document into phrases, each the longest match with the reference; the fewer phrases
for the length (scaled by the logarithm of the reference), the lower the cross entropy. The language
with the fewest wins. Blocks of all documents of a batch are read side by side, one symbol at a time.

The references are a bounded sample: at most ``SAMPLE_DOCS`` documents of a language and
``SAMPLE_SYMBOLS`` symbols in all. Everything else reads whole texts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from headway.llm import text as tx, workers

SAMPLE_DOCS = 200
SAMPLE_SYMBOLS = 16_000
#: Symbols: none, white space and marks, letters outside the references, then letters by frequency.
SPACE, OTHER, LETTERS = 1, 2, 3
ALPHABET = 64
#: Documents are read in blocks of so many symbols, each parsed from its own start.
BLOCK = 1024
UNKNOWN = "und"


def held_out(doc_id, modulus: int = 4, rest: int = 2):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.frombuffer(bytes(chr(k).isalpha() for k in range(0x110000)), bool)


def symbol_table(letters: str) -> np.ndarray:
    """Symbol of every code point; upper and lower case are alike."""
    table = np.where(_is_letter(), OTHER, SPACE).astype(np.uint8)
    for k, c in enumerate(letters):
        for form in {c, c.upper(), c.title()}:
            if len(form) == 1:
                table[ord(form)] = LETTERS + k
    return table


def automaton(symbols: np.ndarray) -> np.ndarray:
    """Transitions of the suffix automaton of a text: states x symbols, 0 where there is none.

    State 0 is unused, state 1 is the start.
    """
    size = 2 * len(symbols) + 3
    move = np.zeros((size, ALPHABET), np.int32)
    length, link = [0] * size, [0] * size
    last, used = 1, 2
    for s in symbols.tolist():
        new, used = used, used + 1
        length[new] = length[last] + 1
        at = last
        while at and not move[at, s]:
            move[at, s] = new
            at = link[at]
        if not at:
            link[new] = 1
        else:
            to = int(move[at, s])
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy, used = used, used + 1
                move[copy] = move[to]
                length[copy], link[copy] = length[at] + 1, link[to]
                while at and move[at, s] == to:
                    move[at, s] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return move[:used]


class Languages:
    """Automata of several languages in one table of moves, and the scale of each."""

    def __init__(self, references: dict[str, str]):
        counts: dict[str, int] = {}
        for text in references.values():
            for c in text.lower():
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
        self.letters = "".join(sorted(counts, key=lambda c: (-counts[c], c))[:ALPHABET - LETTERS])
        self.names = sorted(references)
        table, parts, at = symbol_table(self.letters), [np.zeros((1, ALPHABET), np.int32)], 0
        self.starts, self.scale = [], []
        for name in self.names:
            symbols, _ = read([references[name]], table)
            own = automaton(symbols)
            parts.append(np.where(own[1:] > 0, own[1:] + at, 0))
            self.starts.append((at + 1) * ALPHABET)
            self.scale.append(np.log2(len(symbols) + 2))
            at += len(own) - 1
        # Moves are kept multiplied, as places in the flat table.
        self.moves = np.concatenate(parts).astype(np.int32) * ALPHABET

    def phrases(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each row (rows x languages)."""
        sizes = np.diff(bounds)
        blocks = -(-sizes // BLOCK)
        of = np.repeat(np.arange(len(sizes)), blocks)
        number = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = bounds[:-1][of] + number * BLOCK
        many = np.minimum(BLOCK, bounds[1:][of] - first)
        order = np.argsort(-many, kind="stable")
        of, first, many = of[order], first[order], many[order]
        flat, starts = self.moves.ravel(), np.array(self.starts, np.int32)[:, None]
        state = np.repeat(starts, len(of), 1)
        found = np.zeros((len(self.names), len(of)), np.int32)
        live = np.searchsorted(-many, -np.arange(int(many[0]) if len(many) else 0), "left")
        for k, n in enumerate(live.tolist()):
            s = symbols[first[:n] + k].astype(np.int32)
            to = flat[state[:, :n] + s]
            stop = to == 0
            found[:, :n] += stop
            state[:, :n] = np.where(stop, np.maximum(flat[starts + s], starts), to)
        out = np.zeros((len(sizes), len(self.names)))
        for k in range(len(self.names)):
            out[:, k] = np.bincount(of, found[k] + 1, minlength=len(sizes))
        return out


def read(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, runs of space as one, and where each text starts and the last ends."""
    symbols = table[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    bounds = np.cumsum([0, *map(len, texts)])
    keep = np.append(True, (symbols[1:] != SPACE) | (symbols[:-1] != SPACE))[:len(symbols)]
    return symbols[keep], np.append(0, np.cumsum(keep))[bounds]


def references(docs: DataFrame) -> dict[str, str]:
    """The reference text of each label: a bounded sample of the documents that may be learned from."""
    labelled = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs["doc_id"])) \
        .select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    out: dict[str, str] = {}
    if not counts:
        return out
    chosen = None
    for lang, n in counts.items():
        # A few more than needed, so that some may lack letters.
        wanted = labelled.where((F.col("lang") == lang) & (share < 1_000_000 * min(1.0, 2 * SAMPLE_DOCS / n)))
        part = wanted.orderBy(share, "doc_id").limit(SAMPLE_DOCS).select(
            "lang", F.substring("text", 1, SAMPLE_SYMBOLS).alias("text"))
        chosen = part if chosen is None else chosen.union(part)
    texts: dict[str, list[str]] = {}
    for r in chosen.collect():
        if any(c.isalpha() for c in r["text"]):
            texts.setdefault(r["lang"], []).append(r["text"])
    for lang, own in texts.items():
        each = -(-SAMPLE_SYMBOLS // len(own))
        short = sum(min(len(t), each) for t in own)
        # Short texts leave room for more of the longer ones.
        while short < SAMPLE_SYMBOLS and any(len(t) > each for t in own):
            each += max(1, (SAMPLE_SYMBOLS - short) // len(own))
            short = sum(min(len(t), each) for t in own)
        out[lang] = " ".join(t[:each] for t in own)[:SAMPLE_SYMBOLS]
    return out


def identified(docs: DataFrame, learned: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, is ``und`` with score 0; so is every document when no labelled
    text may be learned from. The score is one less the ratio of the phrases of the best language and
    the second best; with one language it is 1. Ties go to the first name. A row without an id is never held out.
    ``learned`` has references made before.
    """
    learned = references(docs) if learned is None else learned
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Languages(learned)) if learned else None

    def run(batches):
        for batch in tx.slices(batches):
            names, scores = _predict(batch.column(1), sent.value if sent else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()),
                                              pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = tx.plain(docs).mapInArrow(workers.frugal(run), "doc_id long, lang_pred string, score double")
    own = tx.given_id()
    return found.select(own, held_out(F.nullif("doc_id", F.lit(tx.NO_ID))).alias("held_out"), "lang_pred", "score")


_TABLES: dict[str, np.ndarray] = {}


def _predict(column: pa.Array, languages: Languages | None) -> tuple[list[str], np.ndarray]:
    texts = pc.fill_null(column, "").to_pylist()
    names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if languages is None:
        return names.tolist(), scores
    if languages.letters not in _TABLES:
        _TABLES[languages.letters] = symbol_table(languages.letters)
    symbols, bounds = read(texts, _TABLES[languages.letters])
    letters = np.append(0, np.cumsum(symbols != SPACE))[bounds]
    has = np.diff(letters) > 0
    cost = languages.phrases(symbols, bounds) * np.array(languages.scale)
    best = cost.argmin(1)
    names[has] = np.array(languages.names, object)[best[has]]
    if len(languages.names) > 1:
        two = np.partition(cost, 1, axis=1)[:, :2]
        scores[has] = np.clip(1 - two[has, 0] / np.maximum(two[has, 1], 1e-12), 0, 1)
    else:
        scores[has] = 1.0
    return names.tolist(), scores


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents with a language, with their columns; rows without an id always stay.

    Where no labelled text could be learned from, all documents with a letter stay.
    """
    learned = references(docs)
    if not learned:
        return docs.where(docs["doc_id"].isNull() | F.coalesce(docs["text"].cast("string").rlike(r"\p{L}"), F.lit(False)))
    return tx.without(docs, identified(docs, learned), F.col("lang_pred") != UNKNOWN)
