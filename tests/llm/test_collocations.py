"""Phrases against brute force, and the parts of the counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from headway.llm import collocations as co, text as tx

SCHEMA = "doc_id long, text string, lang string, phrase string, f string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "p", "f", None) for i, (g, t) in enumerate(rows)], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def by_brute_force(rows, least, longest, first):
    counts = {}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    counts.setdefault(lang or "und", Counter())[tuple(words[k:k + size])] += 1
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        n = sum(a for p, a in f.items() if len(p) == 1)
        found = []
        for p, a in candidates.items():
            if any(100 * b >= 50 * a and any(q[k:k + len(p)] == p for k in range(len(q) - len(p) + 1))
                   for q, b in candidates.items() if len(q) > len(p)):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:first], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out


def documents(seed, n=60):
    r = random.Random(seed)
    kinds = ["a", "B", "é", "É", "the", "The", "x\x1fy", "日本", "a-b", "und", "en"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "; "]
    texts = [("en", None), (None, ""), ("de", " \t. "), ("en", "the the the the the the the the the the the the the")]
    for _ in range(n):
        lang = r.choice(["en", "en", "de", None, "und"])
        texts.append((lang, "".join(r.choice(kinds) + r.choice(gaps) for _ in range(r.randrange(60)))))
    return texts + texts[-5:]


@pytest.mark.parametrize("seed,least,longest,first", [(1, 10, 3, 2000), (2, 3, 4, 2000), (3, 2, 3, 7)])
def test_phrases_equal_brute_force(spark, seed, least, longest, first):
    rows = documents(seed)
    got = co.collocations(frame(spark, rows).repartition(3), least, longest, first)
    assert {tuple(x) for x in got.collect()} == by_brute_force(rows, least, longest, first)


def test_dense_tiles_and_coordinates_agree(monkeypatch):
    monkeypatch.setattr(co, "HEAD", 16)
    monkeypatch.setattr(co, "TILE", 4)
    monkeypatch.setattr(co, "DENSE", 40)
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**64, 40, dtype=np.uint64)
    top = keys[:16]
    for length in (2, 3):
        left = co.Ranks(np.stack([np.resize(top, 16)] * (length - 1), axis=1))
        tiles, want, got = co.Tiles(left, co.Ranks(top[:, None])), Counter(), Counter()
        for _ in range(3):
            places = np.minimum(r.geometric(0.15, 4000), 40) - 1
            words = [keys[places] for _ in range(length - 1)] + [keys[np.roll(places, 1)]]
            want.update(zip(*(w.tolist() for w in words)))
            tiles.add(words)
            phrases, counts = tiles.flush()
            got.update(dict(zip(zip(*phrases.tolist()), counts.tolist())))
        assert tiles.dense
        phrases, counts = tiles.rest()
        got.update(dict(zip(zip(*phrases.tolist()), counts.tolist())))
        assert got == want


def test_bit_table_passes_all_that_it_holds(spark):
    r = np.random.default_rng(2)
    keys = r.integers(0, 2**64, (3000, 2), dtype=np.uint64)
    signed = keys.view(np.int64).tolist()
    table = co.bit_table(spark.createDataFrame([(a, b) for a, b in signed], "k1 long, k2 long").repartition(3), 2)
    assert tx.passes(table, co.phrase_keys(list(keys.T))).all()
    other = r.integers(0, 2**64, 20000, dtype=np.uint64)
    assert tx.passes(table, other).mean() < 0.001


def test_words_that_share_a_key_are_seen():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", None]), pa.array(["de a A", "en a", ""])],
                                       names=["lang", "text"])
    seen = Counter()
    for out in co._word_counter(0)(iter([batch.slice(0, 2)])):
        for lang, word, key, f in zip(*(c.to_pylist() for c in out.columns)):
            seen[lang, word] += f
    assert seen == {("en", "de"): 1, ("en", "a"): 2, ("de", "en"): 1, ("de", "a"): 1}
    kept = co.word_keys
    co.word_keys = lambda lowered, starts, ends, of, seed: np.zeros(len(starts), np.uint64)
    try:
        rows = [r for out in co._word_counter(0)(iter([batch.slice(0, 2)])) for r in out.to_pylist()]
    finally:
        co.word_keys = kept
    assert {(r["lang"], r["word"]) for r in rows} == set(seen) and sum(r["f"] for r in rows) == 5


def test_odd_rows(spark):
    assert co.collocations(frame(spark, [])).collect() == []
    assert co.collocations(frame(spark, [(None, None), ("en", ""), (None, "one word. each here")])).collect() == []
    got = co.collocations(frame(spark, [(None, "New York! " * 12), ("und", "new york")]))
    assert [tuple(r) for r in got.collect()] == [("und", 1, "new york", 13, 13, 13, 26, 1000000)]
