"""Exact duplicates and packing against brute force and round trips."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from headway.llm import exact_dedup, packing, queries, subwords
from headway.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, n_bytes string, print string, length string"
TEXTS = [None, "", " \t", "a b", "ab ", "A b", "word " * 5000, "word " * 5000 + "end", "a b", "ß é",
         "ab", "x" * 70000, "x " * 70000, "x" * 69999 + "y", "the <|endoftext|> of", "1\x1c2 3"]


def frame(spark, texts, ids=None):
    rows = [(i, t, "n", None, "z") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_groups_equal_brute_force(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(frame(spark, TEXTS)).collect()}
    bodies = [re.sub("[ \t-\r]", "", t or "") for t in TEXTS]
    for i, body in enumerate(bodies):
        group = [k for k, b in enumerate(bodies) if b == body]
        best = min(group, key=lambda k: (-len(TEXTS[k] or ""), k))
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best, len(group), i == best)
        assert got[i].text_sha256 == hashlib.sha256(body.encode()).hexdigest()


def test_exact_groups_of_odd_rows(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    got = exact_dedup.exact_groups(frame(spark, ["a", "a", "b", "a"], [None, 3, None, 3])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [
        ("3", "3", 3, True), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 1, True)]


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    docs = frame(spark, ["aaaa", "a a a a", "bbbb", "cccc", "cc cc"])
    real = exact_dedup.fingerprinted(docs).collect()
    fake = spark.createDataFrame([(r.doc_id, r.n_chars, r.n_bytes, 7, r.text_sha256) for r in real],
                                 "doc_id long, n_chars long, n_bytes long, print long, text_sha256 string")
    monkeypatch.setattr(exact_dedup, "fingerprinted", lambda d: fake)
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 4, 4: 4}


@given(st.binary(max_size=300), st.binary(max_size=300))
@settings(max_examples=50, deadline=None)
def test_fingerprints_compose(left, right):
    def of(raw):
        data = np.frombuffer(raw, np.uint8)
        return [int(x[0]) for x in exact_dedup.fingerprints(data, np.array([0, len(data)]))]

    for k in (0, 1):
        assert exact_dedup.combine(of(left)[k], len(left), of(right)[k], k) == of(left + right)[k]
    long = (left + b"1") * 200
    cut = len(long) // 3
    assert exact_dedup.combine(of(long[:cut])[0], cut, of(long[cut:])[0]) == of(long)[0]


def test_word_cache_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    texts = [t for t in TEXTS if t] + ["é ́x İ ΑΣ Σ'S it's I'LL x", "<|ENDOFTEXT|> a<|startoftext|>B"]
    ours = subwords.WordIds(vocabulary()).encode([t.encode() for t in texts])
    for text, raw in zip(texts, ours):
        assert np.frombuffer(raw, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packed_pieces_restore_the_documents(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    rows = packing.packed(frame(spark, TEXTS), vocabulary(), 128).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(TEXTS):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, 128 * k)
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        assert sum(r.length for r in by_doc[i]) == len(ids)
    for slots in by_sequence.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.packed(frame(spark, []), vocabulary()).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=100, deadline=None)
def test_plan_gives_each_rank_one_place(counts):
    used, ranks = defaultdict(list), Counter()
    for length, lo, hi, first, offset in packing.plan(counts, 64):
        assert lo == ranks[length]
        ranks[length] = hi
        for k in range(hi - lo):
            used[first + k].append((offset, length))
    assert dict(ranks) == counts
    for slots in used.values():
        ends = 0
        for offset, length in sorted(slots):
            assert offset == ends
            ends += length
        assert ends <= 64
    # Best fit with the longest first needs at most 11/9 of the best, plus one.
    assert len(used) <= -(-sum(k * n for k, n in counts.items()) // 64) * 2 + 1


def test_queries_on_the_small_table(spark):
    small = "/root/testdata/sf0.001"
    docs = queries.table(spark, small, "documents").count()
    rows = queries.QUERIES["op10_best_fit_packing"](spark, small).collect()
    assert len({r.doc_id for r in rows}) == docs
    sequences = len({r.sequence_id for r in rows})
    assert sequences <= -(-sum(r.length for r in rows) // 2048) + 2


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import sys

    sys.path.insert(0, "tools")
    from check import tables

    small = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, small)
    want = tables(small).execute(queries.ORACLES[name])
    order = [c[0] for c in want.description]
    assert sorted(order) == sorted(got.columns)
    assert sorted(map(tuple, got.select(order).collect()), key=repr) == sorted(want.fetchall(), key=repr)
