"""SimHash groups against brute force."""

import random

import numpy as np
import xxhash

from headway.llm import simhash

SCHEMA = "doc_id long, text string, print string, first string, codes string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "p", None, "c") for i, t in rows], SCHEMA)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(codes):
    """Lowest place that can be reached, for each place."""
    up = list(range(len(codes)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, code in enumerate(codes):
        for m in range(k):
            if (code ^ codes[m]).bit_count() <= 2:
                a, b = find(k), find(m)
                up[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(codes))]


def texts(seed):
    r = random.Random(seed)
    base = [r.choice(["Aé", "b,", "ccc", "D\x1f", "日本", "e" * 40]) + str(r.randrange(40)) for _ in range(90)]
    out = [None, "", " \t\n", "one", "one  two", "ONE\x0btwo", "one two three", "one\ntwo\x0cthree", " ".join(base),
           "  ".join(base).upper(), "\t".join(base) + " "]
    for _ in range(40):
        words = list(base)
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = str(r.randrange(9))
        out.append(" ".join(words[:r.randrange(1, 91)] if r.random() < 0.3 else words))
    return out


def test_groups_equal_brute_force(spark):
    for seed in (1, 2):
        rows = list(enumerate(texts(seed)))
        random.Random(seed).shuffle(rows)
        rows = [(10 * i, t) for i, t in rows]
        ordered = sorted(rows)
        codes = [fingerprint(t) for _, t in ordered]
        want = {i: (f"{c:016x}", 10 * g) for (i, _), c, g in zip(ordered, codes, grouped(codes))}
        got = simhash.similar_groups(frame(spark, rows).repartition(3)).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


def test_a_text_longer_than_a_chunk_of_shingles():
    import pyarrow as pa

    r = random.Random(3)
    long = " ".join(str(r.randrange(900)) for _ in range(simhash.SHINGLES_AT_ONCE + 500))
    got = simhash.fingerprints(pa.array(["a b", long, None, "c d e f"]))
    assert got.tolist() == [fingerprint(t) for t in ("a b", long, None, "c d e f")]


def test_index_finds_every_link_among_crowded_fingerprints(spark):
    r = np.random.default_rng(5)
    centres = r.integers(0, 2**64, 40, dtype=np.uint64)
    codes = set(r.integers(0, 2**64, 500, dtype=np.uint64).tolist()) | {0, 2**64 - 1, 2**63, 2**63 - 1}
    for c in centres.tolist():
        for _ in range(40):
            flips = r.choice(64, r.integers(0, 5), replace=False)
            codes.add(c ^ sum(1 << int(b) for b in flips))
    for _ in range(400):  # One crowd that differs in a few low and high bits.
        codes.add(int(r.integers(0, 512)) | int(r.integers(0, 4)) << 62)
    codes = sorted(codes)
    assert len(codes) > 4 * simhash.LEAF
    signed = [int(np.uint64(c).astype(np.int64)) for c in codes]
    found = simhash.links(spark.createDataFrame([(c,) for c in signed], "print long").repartition(5)).collect()
    up = {c: c for c in signed}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        one, two = find(a), find(b)
        if one != two:
            up[max(one, two)] = min(one, two)
    want, got = {}, {}
    for k, (place, c) in enumerate(zip(grouped(codes), signed)):
        want.setdefault(place, set()).add(k)
        got.setdefault(find(c), set()).add(k)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))
    assert len(found) <= len(codes) * 4  # Forests, not all pairs.


def test_odd_rows(spark):
    assert simhash.similar_groups(frame(spark, [])).collect() == []
    got = simhash.similar_groups(frame(spark, [(7, "a b c"), (7, "x y z"), (None, "A B C"), (None, None), (None, "")]))
    rows = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect())
    abc, xyz = (f"{fingerprint(t):016x}" for t in ("a b c", "x y z"))
    assert rows == sorted([("7", abc, "7"), ("7", xyz, "7"), ("None", abc, "7"), ("None", "0" * 16, "None"),
                           ("None", "0" * 16, "None")])
