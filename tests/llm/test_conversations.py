"""Repairs against brute force over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from headway.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, key string, times string, cost string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", None, "c") for r in rows], SCHEMA)


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(name.encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub(r"[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3].encode()))


def cheapest(rows):
    """Dijkstra over (cost, letters): the first to reach a legal end is the cheapest, then the least."""
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, k, roles, out = heapq.heappop(queue)
        if k == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, letters, out
        state = (k, roles[-1:])
        if state in done:
            continue
        done.add(state)
        options = []
        if k < len(rows):
            role, text, fault = rows[k]
            options.append((2, "D", 1, None))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                options.append((extra, "K", 1, (role, text)))
                options += [(1 + extra, "R", 1, (r, text)) for r in ("user", "assistant")]
        options += [(5, "I", 0, (r, "")) for r in ("user", "assistant")]
        for more, letter, step, row in options:
            then = roles + (row[0][:1] if row else "")
            if row and (not row[0] or not re.fullmatch(r"s|s?(ua)*u?", then)):
                continue
            heapq.heappush(queue, (cost + more, letters + letter, k + step, then, out + ((row,) if row else ())))


def by_brute_force(rows):
    result = {}
    for conv in {r[0] for r in rows}:
        own = after_damage([r for r in rows if r[0] == conv])
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, _, role, text in own:
            said = BLANK.findall(text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen
                          else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        pairs = zip(own, own[1:])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs)
        cost, audit, out = cheapest([(r[2], r[3], f) for r, f in zip(own, faults)])
        body = "\n".join(f"{role}:{text}" for role, text in out)
        result[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                        hashlib.sha256(body.encode()).hexdigest())
    return result


def talks(seed, n=60, longest=9):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "umpire"]
    said = ["Yes.", "No!", "Why?", "ok", "Ok. ", "é。", "...", "", " \t", None, "a.b", "x\n"]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(r.randrange(longest)):
            good = r.random() < 0.7
            role = ("user", "assistant")[turn % 2] if good else r.choice(roles)
            text = f"Text {turn}." if r.random() < 0.6 else r.choice(said)
            rows.append((conv, None if r.random() < 0.05 else turn + r.choice([0, 0, 0, 1]), role, text))
    return rows + rows[:5]


@pytest.mark.parametrize("seed,size", [(1, cv.SEGMENT), (2, 2), (3, 1)])
def test_repairs_equal_brute_force(spark, seed, size):
    rows = talks(seed)
    got = cv.repaired(frame(spark, rows).repartition(3), size).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r[0]: tuple(r[1:]) for r in got} == by_brute_force(rows)


def test_a_long_conversation_over_many_tasks(spark):
    rows = [(7, t, r, x) for t, (_, _, r, x) in enumerate(talks(4, 70) * 2)]
    assert len(rows) > 500
    got = cv.repaired(frame(spark, rows).repartition(4)).collect()
    want = by_brute_force(rows)
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_prices_stay_below_every_arc_and_equal_distances():
    r = random.Random(5)
    for _ in range(200):
        codes = bytes(4 * r.choice([0, 0, 1, 2, 3]) + r.randrange(4) for _ in range(r.randrange(9)))
        lattice = cv.Lattice(codes, cv.ENDS, True)
        cost = lattice.auction(0)
        for node, arcs in enumerate(lattice.arcs):
            assert all(lattice.price[node] <= c + lattice.price[to] for _, c, to in arcs)
        whole = cv.matrix(codes, True)
        assert cost == min(whole[0], whole[3])
        for cut in range(1, len(codes)):
            one, two = cv.matrix(codes[:cut], False), cv.matrix(codes[cut:], True)
            assert [min(min(one[4 * q + m] + two[4 * m + e] for m in range(4)), cv.FAR)
                    for q in range(4) for e in range(4)] == list(whole)


def test_odd_rows(spark):
    assert cv.repaired(frame(spark, [])).collect() == []
    rows = [(1, None, None, None), (1, None, None, None), (None, None, "user", None), (2, 5, "system", "x" * 100000)]
    rows += [(3, 10**6, "user", "Hello."), (3, 4, "assistant", "Hi.")]
    got = cv.repaired(frame(spark, rows)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == by_brute_force(rows)
