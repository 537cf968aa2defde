"""Personal data: patterns for four kinds, and a character model that finds more.

The model is a bidirectional LSTM over characters with CRF transitions between tags, trained in numpy on
labelled spans: what the patterns find in a bounded sample of the documents (``SAMPLE_DOCS``), and made-up
examples in other spellings. Personal data of these kinds has a digit or an @; the model reads
overlapping windows wherever one is near. Scores of windows that overlap are averaged, and one Viterbi
pass over the whole stretch decides, so a span is never cut by a window.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from headway.llm import text as tx

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + len(KINDS)
WINDOW, STEP, MARGIN = 64, 32, 24
HIDDEN, EMBEDDED = 16, 12
SAMPLE_DOCS = 300
SAMPLE_WINDOWS, TEXT_WINDOWS = 600, 60
MADE_UP = 1600
ROUNDS, BATCH, RATE = 420, 64, 0.02
SYMBOLS = 130                     # ASCII, other letters, anything else
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits that cannot start a match as a whole cannot from within, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TRIGGER = re.compile(r"[0-9@]")

Span = tuple[int, str, int]       # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start, then kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _TRIGGER.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = np.array([128 if c.isalpha() else 129 for c in text], np.int64) if not text.isascii() else 0
    return np.where(points < 128, points, wide).astype(np.int64)


def stretches(text: str) -> list[tuple[int, int]]:
    """Where a digit or @ is within the margin, in pieces that do not touch."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Character BiLSTM with a linear-chain CRF on top."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)

        def init(*shape):
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"embed": 0.3 * r.standard_normal((SYMBOLS, EMBEDDED)).astype(np.float32),
                  "out": init(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32),
                  "move": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": init(EMBEDDED, 4 * HIDDEN), f"h{d}": init(HIDDEN, 4 * HIDDEN),
                       f"c{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}

    def _lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states in the order of ``x`` (windows x time x embedding)."""
        n, t, _ = x.shape
        into = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, t, HIDDEN), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = into[:, k] + h @ self.p[f"h{d}"]
            gates = _sigmoid(z[:, :3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            before, c_before = h, c
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[:, k] = h
            if keep is not None:
                keep.append((k, before, c_before, i, f, o, g, s))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x]
        return np.concatenate([self._lstm(e, "f"), self._lstm(e, "b")], 2) @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of the tags."""
        n, t = x.shape
        e, keeps = self.p["embed"][x], {"f": [], "b": []}
        hidden = np.concatenate([self._lstm(e, d, keeps[d]) for d in "fb"], 2)
        score = hidden @ self.p["out"] + self.p["bias"]
        move = self.p["move"]
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for k in range(1, t):
            ahead[:, k] = score[:, k] + _logsum(ahead[:, k - 1, :, None] + move, 1)
        for k in range(t - 2, -1, -1):
            back[:, k] = _logsum(move + (score[:, k + 1] + back[:, k + 1])[:, None, :], 2)
        whole = _logsum(ahead[:, -1], 1)
        own = np.exp(ahead + back - whole[:, None, None])
        both = np.exp(ahead[:, :-1, :, None] + move + (score[:, 1:] + back[:, 1:])[:, :, None, :]
                      - whole[:, None, None, None])
        is_tag = np.eye(TAGS, dtype=np.float32)[tags]
        d_score = (own - is_tag) / n
        d_move = (both.sum((0, 1)) - np.einsum("nti,ntj->ij", is_tag[:, :-1], is_tag[:, 1:])) / n
        grads = {"move": d_move, "bias": d_score.sum((0, 1)),
                 "out": hidden.reshape(-1, 2 * HIDDEN).T @ d_score.reshape(-1, TAGS)}
        d_hidden = d_score @ self.p["out"].T
        d_e = np.zeros_like(e)
        for d, part in (("f", d_hidden[..., :HIDDEN]), ("b", d_hidden[..., HIDDEN:])):
            d_into = np.zeros((n, t, 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            d_h = np.zeros_like(self.p[f"h{d}"])
            for k, before, c_before, i, f, o, g, s in reversed(keeps[d]):
                dh = dh + part[:, k]
                dc = dc + dh * o * (1 - s * s)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f),
                                     dh * s * o * (1 - o), dc * i * (1 - g * g)], 1)
                d_into[:, k] = dz
                d_h += before.T @ dz
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
            grads[f"h{d}"], grads[f"c{d}"] = d_h, d_into.sum((0, 1))
            grads[f"x{d}"] = e.reshape(-1, EMBEDDED).T @ d_into.reshape(-1, 4 * HIDDEN)
            d_e += d_into @ self.p[f"x{d}"].T
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], x, d_e)
        return grads

    def fit(self, x: np.ndarray, tags: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Tagger:
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            pick = r.integers(0, len(x), BATCH)
            rate = RATE * (1 - 0.9 * step / rounds)
            for k, g in self.gradients(x[pick], tags[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9 ** step))
                             / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        return self

    def decode(self, score: np.ndarray) -> np.ndarray:
        """The best tags of one stretch of any length."""
        best, back = score[0], np.zeros(score.shape, np.int8)
        for k in range(1, len(score)):
            through = best[:, None] + self.p["move"]
            back[k] = through.argmax(0)
            best = through.max(0) + score[k]
        tags = np.zeros(len(score), np.int8)
        tags[-1] = best.argmax()
        for k in range(len(score) - 1, 0, -1):
            tags[k - 1] = back[k, tags[k]]
        return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


#: Weights of the overlapping windows: the middle of a window knows most.
_TRUST = (0.05 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) / WINDOW).astype(np.float32)


def model_spans(tagger: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans that the model finds in each text."""
    places, cut = [], []
    for row, text in enumerate(texts):
        for a, b in stretches(text):
            ids = symbols(text[a:b])
            starts = list(range(0, max(1, len(ids) - WINDOW + STEP), STEP))
            padded = np.zeros(starts[-1] + WINDOW, np.int64)
            padded[:len(ids)] = ids
            places.append((row, a, len(ids), len(cut), starts))
            cut += [padded[s:s + WINDOW] for s in starts]
    out: list[list[Span]] = [[] for _ in texts]
    if not cut:
        return out
    scores = np.concatenate([tagger.emissions(np.array(cut[k:k + 2048])) for k in range(0, len(cut), 2048)])
    for row, a, size, first, starts in places:
        total = np.zeros((starts[-1] + WINDOW, TAGS), np.float32)
        weight = np.zeros((starts[-1] + WINDOW, 1), np.float32)
        for k, s in enumerate(starts):
            total[s:s + WINDOW] += scores[first + k] * _TRUST[:, None]
            weight[s:s + WINDOW] += _TRUST[:, None]
        tags = tagger.decode(total[:size] / weight[:size])
        edges = np.flatnonzero(np.diff(tags)) + 1
        for s, e in zip(np.append(0, edges).tolist(), np.append(edges, size).tolist()):
            if tags[s]:
                out[row].append((a + s, KINDS[tags[s] - 1], a + e))
    return out


def plausible(kind: str, span: str) -> bool:
    """What a span of its kind has at least, however it is spelt."""
    digits = len(_NOT_DIGIT.sub("", span))
    if span != span.strip() or len(span) > 80:
        return False
    if kind == "email":
        return "@" in span and len(span) >= 6 and span[0] != "@" and "." in span.rpartition("@")[2].strip(".")
    if kind == "ip":
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= digits <= 19 and _luhn(_NOT_DIGIT.sub("", span))
    return 9 <= digits <= 15 and span[-1].isdigit()


def all_spans(tagger: Tagger, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """Of each text, the base spans, and these with what the model adds beside them."""
    for text, more in zip(texts, model_spans(tagger, texts)):
        base = base_spans(text)
        taken = sorted((a, b) for a, _, b in base)
        added = [(a, kind, b) for a, kind, b in more
                 if plausible(kind, text[a:b]) and not any(x < b and a < y for x, y in taken)]
        both = sorted(base + added, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
        yield base, both


def made_up(n: int, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Examples in spellings that the patterns miss, among plain words and harmless numbers."""
    r = random.Random(seed)

    def digits(k):
        return "".join(r.choice("0123456789") for _ in range(k))

    def word():
        return "".join(r.choice("etaoinshrdlucmfwy") for _ in range(r.randint(2, 9)))

    def card():
        body = r.choice("3456") + digits(14)
        last = next(c for c in "0123456789" if _luhn(body + c))
        whole = body + last
        sep = r.choice(["", " ", "-", ".", "  ", "_"])
        return sep.join(whole[k:k + 4] for k in range(0, 16, 4))

    def secret(kind):
        if kind == "email":
            at = r.choice(["@", "@", " @ ", "(@)"])
            return f"{word()}{r.choice(['', '.', '_'])}{r.choice(['', digits(2)])}{at}{word()}.{r.choice(['com', 'org', 'example.com', 'net'])}"
        if kind == "ip":
            return r.choice([".", ".", ". ", "[.]", "-"]).join(str(r.randint(1, 255)) for _ in range(4))
        if kind == "card":
            return card()
        a, b, c = digits(3), digits(3), digits(4)
        lead = r.choice(["", "", "+1 ", "1-", "00", "+44 "])
        return lead + r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}{c}"])

    out = []
    for _ in range(n):
        text, spans = "", []
        plain = r.choice((2, 6, 16))
        while len(text) < WINDOW:
            kind = r.choice((*[None] * plain, *KINDS))
            if kind:
                piece = secret(kind)
                spans.append((len(text), kind, len(text) + len(piece)))
            else:
                piece = r.choice([word(), word(), word() + r.choice(".,;!"), digits(r.randint(1, 6)),
                                  f"{r.randint(1, 12)}.{r.randint(0, 9)}", f"19{digits(2)}", f"${digits(3)}.{digits(2)}",
                                  f"{digits(2)}:{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", "".join(
                                      r.choice("0123456789abcdef") for _ in range(r.choice((8, 18, 40))))])
            text += piece + r.choice([" ", " ", "\n", ", "])
        out.append((text, spans))
    return out


def _windows(text: str, spans: list[Span]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    tags = np.zeros(len(text) + WINDOW, np.int64)
    for a, kind, b in spans:
        tags[a:b] = 1 + KINDS.index(kind)
    ids = np.zeros(len(text) + WINDOW, np.int64)
    ids[:len(text)] = symbols(text)
    for a, b in stretches(text):
        for s in range(a, max(a + 1, b - WINDOW + STEP), STEP):
            yield ids[s:s + WINDOW], tags[s:s + WINDOW]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each text with the tags of what the patterns find, at most ``TEXT_WINDOWS`` a text."""
    for batch in tx.slices(batches):
        rows = [(of, k, x.astype(np.uint8).tobytes(), t.astype(np.uint8).tobytes())
                for of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for k, (x, t) in enumerate(islice(_windows(text, base_spans(text)), TEXT_WINDOWS))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t)
             for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
            names=["of", "k", "symbols", "tags"])


def trained(docs: DataFrame) -> Tagger:
    """The model: fitted on a bounded sample of the documents and on made-up examples.

    The sample is the ``SAMPLE_DOCS`` different texts with the smallest hashes. Only hashes and at most
    ``SAMPLE_WINDOWS`` windows reach the driver, whatever the length or number of the texts.
    """
    texts = docs.where(F.regexp_like("text", F.lit("[0-9@]"))).select(F.xxhash64("text").alias("of"), "text")
    last = texts.select("of").distinct().orderBy("of").limit(SAMPLE_DOCS).agg(F.max("of")).first()[0]
    pairs: list = []
    if last is not None:
        some = texts.where(F.col("of") <= last) \
            .mapInArrow(_labelled, "of long, k int, symbols binary, tags binary") \
            .dropDuplicates(["of", "k"]).orderBy("of", "k").limit(SAMPLE_WINDOWS).collect()
        pairs = [(np.frombuffer(r["symbols"], np.uint8).astype(np.int64),
                  np.frombuffer(r["tags"], np.uint8).astype(np.int64)) for r in some]
    for text, spans in made_up(MADE_UP):
        pairs += list(_windows(text, spans))[:1]
    return Tagger().fit(np.array([x for x, _ in pairs]), np.array([t for _, t in pairs]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def found(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and hash are of the pattern spans; ``spans`` has the model's too. Null and empty texts have
    none. Rows that repeat an id are read each. An empty table gives no rows.
    """
    texts = tx.plain(docs)
    sent = docs.sparkSession.sparkContext.broadcast(tagger or trained(texts))

    def run(batches):
        for batch in tx.slices(batches):
            rows = []
            for base, both in all_spans(sent.value, pc.fill_null(batch.column(1), "").to_pylist()):
                kinds = [kind for _, kind, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS),
                             hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long,"
                                 " base_sha256 string, spans string") \
        .withColumn("doc_id", tx.given_id())
