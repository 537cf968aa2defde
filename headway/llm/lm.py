"""Language-model scores of whole texts.

A causal self-attention model over subword ids, trained in numpy, gives each token a probability from the
tokens before it in a window. Windows overlap: each one after the first gives its first tokens as
context only, so every token is scored once. The output is factored into classes of tokens, and mixed
by a learned gate with the bigram table. Unigrams, bigrams, classes and the attention weights come from all
tokens of all training documents: their windows are dealt by hash to shards of about ``SHARD_WINDOWS``. A first
shard is fitted alone; in rounds of eight times as many shards, each task goes once over the windows of a shard
from the weights so far, and the mean of the round's weights is the start of the next.

The base score is a unigram over words. Counts of the ``HEAD`` most frequent words go to the tasks; other
words meet their counts in a join, so neither depends on the size of the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from headway.llm import subwords, text as tx, workers
from headway.llm.language import held_out
from headway.session import materialise

CONTEXT, STRIDE = 32, 24
WIDTH, CLASSES, SLOTS = 16, 64, 1024
#: Slot 0 is the start of a text, the last one holds all tokens without a slot of their own.
RARE = SLOTS - 1
HEAD = 1 << 18
#: Windows of a shard; steps the first shard takes at least; windows of a step; rates of the first shard and of others.
SHARD_WINDOWS, ROUNDS, BATCH, RATE, LATER_RATE = 1 << 16, 450, 96, 0.02, 0.005
#: Weights are added up across tasks as integers of this unit, so that their order does not matter.
UNIT = 1 << 20
SMOOTH = 0.1
BIGRAM_WEIGHT = 20.0
WINDOWS_AT_ONCE = 256
_CAUSAL = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))
_ONES = np.ones(CLASSES, np.float32)


def token_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, tag (a hash of the text), held_out, ids (16 bits each, little-endian)."""
    texts = tx.plain(docs).select("doc_id", "text", F.xxhash64("text").alias("tag"))

    def run(batches):
        encoder = subwords.encoder(tokenizer)
        for batch in tx.slices(batches):
            raw = encoder.encode(pc.fill_null(batch.column(1).cast(pa.binary()), b"").to_pylist())
            ids = [np.frombuffer(r, "<u4").astype("<u2").tobytes() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary())],
                                             names=["doc_id", "tag", "ids"])

    own = F.nullif("doc_id", F.lit(tx.NO_ID))
    return texts.mapInArrow(workers.frugal(run, subwords.KEPT_AS), "doc_id long, tag long, ids binary").withColumn("held_out", held_out(own, 7))


def _far(exponents: np.ndarray) -> bool:
    """Whether exponents could leave the range of single precision."""
    return exponents.max() > 60 or exponents.min() < -60


@dataclass
class Model:
    vocabulary: int                # ids, with one more for the end of a text
    slot: np.ndarray               # id -> slot
    within: np.ndarray             # log10 probability of an id in its slot
    of_class: np.ndarray           # slot -> class
    share: np.ndarray              # probability of a slot in its class
    bigram: np.ndarray             # slot before, slot -> probability
    p: dict[str, np.ndarray]
    steep: bool = True

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 5, least: int = ROUNDS, first_rate: float = RATE) -> Model:
        """Windows of slots, and the slots that follow; -1 where there is none. Each window is met at least once."""
        r = np.random.default_rng(seed)
        # All weights lie in one vector, of which the named ones are views.
        names, ends = list(self.p), np.cumsum([a.size for a in self.p.values()])
        flat = np.concatenate([a.ravel() for a in self.p.values()]).astype(np.float32)
        self.p = {k: part.reshape(self.p[k].shape) for k, part in zip(names, np.split(flat, ends[:-1]))}
        m, v, move = (np.zeros_like(flat) for _ in range(3))
        steps = max(least, -(-len(x) // BATCH)) if len(x) else 0
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            while len(order) < BATCH:
                order = np.append(order, r.permutation(len(x)))
            pick, order = order[:BATCH], order[BATCH:]
            rate = first_rate * (1 - 0.9 * step / steps)
            grads = self.gradients(x[pick], y[pick])[1]
            g = np.concatenate([grads[k].ravel() for k in names])
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            v *= np.float32(0.99)
            g *= g
            v += np.float32(0.01) * g
            np.sqrt(v, out=move)
            move *= np.float32((1 - 0.99 ** step) ** -0.5)
            move += np.float32(1e-6)
            np.divide(m, move, out=move)
            move *= np.float32(rate / (1 - 0.9 ** step))
            flat -= move
        return self

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the targets, and its gradients."""
        p, w, (b, t) = self.p, WIDTH, x.shape
        x, y = x.ravel(), y.ravel()
        mask = y >= 0
        n, y, rows = max(1, int(np.count_nonzero(mask))), np.maximum(y, 0), np.arange(len(x))
        every = np.concatenate([p[k] for k in "qkvr"], 1)
        one, scale = every.dtype.type(1), every.dtype.type(w ** -0.5)
        e = (p["embed"][x].reshape(b, t, w) + p["place"][:t]).reshape(-1, w)
        h = e @ every
        h[:, :w] *= scale
        q, k, v = (h.reshape(b, t, -1)[..., i:i + w] for i in (0, w, 2 * w))
        a = q @ k.transpose(0, 2, 1)
        if _far(a):
            a += np.triu(np.full((t, t), -1e9, np.float32), 1)
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a *= _CAUSAL[:t, :t]
        a *= (one / (a.reshape(-1, t) @ np.ones(t, a.dtype))).reshape(b, t, 1)
        mean = (a @ v).reshape(-1, w)
        z = np.tanh(mean + h[:, 3 * w:])
        soft = z @ p["out"]
        soft += p["bias"]
        if _far(soft):
            soft -= soft.max(1, keepdims=True)
        np.exp(soft, out=soft)
        total = soft @ np.ones(CLASSES, soft.dtype)
        at = rows * CLASSES + self.of_class[y]
        own = soft.ravel()[at] / total * self.share[y]
        gate = one / (one + np.exp(-(z @ p["gate"] + p["lean"])))
        other = self.bigram.ravel()[x.astype(np.int64) * SLOTS + y]
        mix = gate * own + (one - gate) * other + one * 1e-30
        d_mix = -mask.astype(mix.dtype) / mix / n
        d_own = d_mix * gate * own
        soft *= (-d_own / total)[:, None]
        soft.ravel()[at] += d_own
        d_gate = d_mix * (own - other) * gate * (one - gate)
        g = {"out": z.T @ soft, "bias": np.ones(len(x), soft.dtype) @ soft,
             "gate": z.T @ d_gate, "lean": np.array([d_gate.sum()], d_gate.dtype)}
        d_u = soft @ p["out"].T
        d_u += d_gate[:, None] * p["gate"]
        d_u *= one - z * z
        u = d_u.reshape(b, t, w)
        d_s = u @ v.transpose(0, 2, 1)
        d_s -= ((d_u * mean) @ np.ones(w, d_u.dtype)).reshape(b, t, 1)
        d_s *= a
        d_h = np.empty_like(h)
        parts = d_h.reshape(b, t, -1)
        np.matmul(d_s, k, out=parts[..., :w])
        np.matmul(d_s.transpose(0, 2, 1), q, out=parts[..., w:2 * w])
        np.matmul(a.transpose(0, 2, 1), u, out=parts[..., 2 * w:3 * w])
        d_h[:, :w] *= scale
        d_h[:, 3 * w:] = d_u
        g |= dict(zip("qkvr", np.split(e.T @ d_h, 4, axis=1)))
        d_e = d_h @ every.T
        g["embed"] = np.zeros_like(p["embed"])
        order = np.argsort(x.astype(np.int16), kind="stable")
        met = x[order]
        first = np.flatnonzero(np.append(True, met[1:] != met[:-1]))
        g["embed"][met[first]] = np.add.reduceat(d_e[order], first, axis=0)
        g["place"] = np.zeros_like(p["place"])
        g["place"][:t] = (np.ones(b, d_e.dtype) @ d_e.reshape(b, -1)).reshape(t, w)
        return float(-(np.log(mix) * mask).sum() / n), g

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Query, key, value and residual of every slot and of every place."""
        every = np.concatenate([self.p[k] for k in "qkvr"], 1)
        every[:, :WIDTH] *= WIDTH ** -0.5
        of_slot, of_place = self.p["embed"] @ every, self.p["place"] @ every
        longest = [np.linalg.norm(of_slot[:, k:k + WIDTH], axis=1).max()
                   + np.linalg.norm(of_place[:, k:k + WIDTH], axis=1).max() for k in (0, WIDTH)]
        # Whether exponents could leave the range of single precision.
        self.steep = max(longest[0] * longest[1],
                         (np.abs(self.p["out"]).sum(0) + np.abs(self.p["bias"])).max()) > 60
        return of_slot, of_place

    def log_probabilities(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray, tables) -> np.ndarray:
        """log10 probabilities of the slots ``y`` at the scored places of the windows ``x``."""
        of_slot, of_place = tables
        e = of_slot[x] + of_place
        s = e[..., :WIDTH] @ e[..., WIDTH:2 * WIDTH].transpose(0, 2, 1)
        np.exp(np.minimum(s, 60.0, out=s) if self.steep else s, out=s)
        s *= _CAUSAL
        # A column of ones beside the values gives the sum of the weights.
        values = np.ones((*x.shape, WIDTH + 1), np.float32)
        values[..., :WIDTH] = e[..., 2 * WIDTH:3 * WIDTH]
        mean = (s @ values)[scored]
        z = mean[:, :WIDTH] / mean[:, WIDTH:]
        z += e[..., 3 * WIDTH:][scored]
        np.tanh(z, out=z)
        logits = z @ self.p["out"]
        logits += self.p["bias"]
        np.exp(np.minimum(logits, 60.0, out=logits) if self.steep else logits, out=logits)
        to = y[scored]
        own = logits[np.arange(len(to)), self.of_class[to]] / (logits @ _ONES) * self.share[to]
        gate = 1 / (1 + np.exp(-(z @ self.p["gate"] + self.p["lean"])))
        return np.log10(np.maximum(gate * own + (1 - gate) * self.bigram[x[scored], to], 1e-30))

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text of ids, its end included."""
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = np.full(int(sizes.sum()), self.vocabulary - 1, np.int64)
        for t, at in zip(texts, starts.tolist()):
            ids[at:at + len(t)] = t
        after = self.slot[ids]
        before = np.append(0, after[:-1])
        before[starts] = 0
        windows = 1 + np.maximum(0, -(-(sizes - CONTEXT) // STRIDE))
        of = np.repeat(np.arange(len(sizes)), windows)
        number = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        first = starts[of] + STRIDE * number
        out = np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.within[ids], minlength=len(sizes))
        tables, places = self.tables(), np.arange(CONTEXT)
        for k in range(0, len(of), WINDOWS_AT_ONCE):
            rows = slice(k, k + WINDOWS_AT_ONCE)
            at = first[rows, None] + places
            live = at < (starts + sizes)[of[rows], None]
            at = np.where(live, at, 0)
            scored = live & ((number[rows, None] == 0) | (places >= CONTEXT - STRIDE))
            found = self.log_probabilities(before[at], after[at], scored, tables)
            out += np.bincount(np.repeat(of[rows], scored.sum(1)), found, minlength=len(sizes))
        return out


def prepared(unigrams: np.ndarray, bigrams: np.ndarray, slot: np.ndarray, seed: int = 1) -> Model:
    """The model before training, from the counts of ids and of pairs of slots."""
    size = len(unigrams)
    smooth = unigrams + SMOOTH
    of_slot = np.bincount(slot, smooth, minlength=SLOTS)
    within = np.log10(smooth / of_slot[slot])
    chance = of_slot / of_slot.sum()
    bigram = (bigrams + BIGRAM_WEIGHT * chance) / (bigrams.sum(1, keepdims=True) + BIGRAM_WEIGHT)
    # Classes: slots that follow the same ones, by k-means over the reduced table of what precedes.
    before = np.sqrt(bigrams.T / np.maximum(1, bigrams.sum(0))[:, None])
    u, d, _ = np.linalg.svd(before, full_matrices=False)
    vectors = u[:, :WIDTH] * d[:WIDTH]
    r = np.random.default_rng(seed)
    alone = CLASSES // 2
    order = np.argsort(-of_slot, kind="stable")
    centres = vectors[order[alone:CLASSES]].copy()
    rest = order[alone:]
    for _ in range(12):
        near = ((vectors[rest, None] - centres[None]) ** 2).sum(2).argmin(1)
        for c in range(len(centres)):
            w = of_slot[rest[near == c]]
            if w.sum() > 0:
                centres[c] = (vectors[rest[near == c]] * w[:, None]).sum(0) / w.sum()
    of_class = np.zeros(SLOTS, np.int64)
    of_class[order[:alone]] = np.arange(alone)
    of_class[rest] = alone + near
    share = of_slot / np.maximum(np.bincount(of_class, of_slot, minlength=CLASSES)[of_class], 1e-30)

    def init(*shape):
        return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {k: init(WIDTH, WIDTH) for k in "qkvr"}
    p |= {"embed": 0.5 * r.standard_normal((SLOTS, WIDTH)).astype(np.float32),
          "place": 0.1 * r.standard_normal((CONTEXT, WIDTH)).astype(np.float32),
          "out": init(WIDTH, CLASSES), "bias": np.zeros(CLASSES, np.float32),
          "gate": np.zeros(WIDTH, np.float32), "lean": np.zeros(1, np.float32)}
    p["bias"][np.bincount(of_class, of_slot, minlength=CLASSES) == 0] = -40.0
    return Model(size, slot, within, of_class, share.astype(np.float32), bigram.astype(np.float32), p)


def _counted(rows: DataFrame, keys_of) -> DataFrame:
    """Counts of integer keys that ``keys_of`` finds in a list of id arrays, summed by task and by Spark."""

    def run(batches):
        for batch in tx.slices(batches, text=0):
            keys = keys_of([np.frombuffer(r, "<u2") for r in batch.column(0).to_pylist()])
            found, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))],
                                             names=["key", "n"])

    return rows.select("ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _collected(counts: DataFrame, size: int) -> np.ndarray:
    """Counts by key as an array; there are at most ``size`` keys."""
    out = np.zeros(size)
    found = counts.toArrow()
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return out


def trained(ids: DataFrame, vocabulary: int) -> Model:
    """The model of the documents that are not held out."""
    own, size = ids.where("NOT held_out"), vocabulary + 1

    def unigrams(texts):
        return np.concatenate([*texts, np.full(len(texts), vocabulary, np.int64)])

    counts = _collected(_counted(own, unigrams), size)
    slot = np.full(size, RARE, np.int64)
    top = np.argsort(-counts, kind="stable")[:SLOTS - 2]
    slot[top[counts[top] > 0]] = 1 + np.arange(int((counts[top] > 0).sum()))

    def pairs(texts):
        after = [slot[np.append(t, vocabulary).astype(np.int64)] for t in texts]
        return np.concatenate([np.append(0, a[:-1]) * SLOTS + a for a in after]) if after else np.zeros(0)

    model = prepared(counts, _collected(_counted(own, pairs), SLOTS * SLOTS).reshape(SLOTS, SLOTS), slot)
    shards = max(1, -(-int(counts.sum() / CONTEXT + counts[vocabulary]) // SHARD_WINDOWS))
    done = 0
    while done < shards:
        upto = min(shards, max(1, 8 * done))
        model = _averaged(windows(own, slot, vocabulary, shards, done, upto), model, done == 0)
        done = upto
    return model


def windows(ids: DataFrame, slot: np.ndarray, end: int, shards: int, first: int, upto: int) -> DataFrame:
    """shard, place, slots (16 bits each): the windows of the shards from ``first`` up to ``upto``.

    A window is a slot of context and up to ``CONTEXT`` slots that follow; each token of a text, its end included,
    is one of those that follow in one window. A hash of the row and the window gives the shard and the place there.
    """

    def run(batches):
        for batch in tx.slices(batches, text=2, limit=1 << 20):
            data, bounds = tx.flat(batch.column(2))
            own, n = data.view("<u2"), np.diff(bounds) // 2
            starts = np.cumsum(n + 2) - (n + 2)
            line = np.full(int((n + 2).sum()), slot[end], "<u2")
            line[starts] = 0
            line[np.arange(len(own)) + np.repeat(starts + 1 - (bounds[:-1] - bounds[0]) // 2, n)] = slot[own]
            many = -(-(n + 1) // CONTEXT)
            of = np.repeat(np.arange(len(n)), many)
            number = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            key = tx.mixed(batch.column(0).to_numpy().view(np.uint64)
                           ^ tx.mixed(batch.column(1).to_numpy().view(np.uint64)))[of]
            key = tx.mixed(key + number.astype(np.uint64))
            shard = (key % np.uint64(shards)).astype(np.int32)
            keep = (shard >= first) & (shard < upto)
            of, number = of[keep], number[keep]
            sizes = np.minimum(CONTEXT + 1, n[of] + 2 - CONTEXT * number)
            ends = np.cumsum(sizes)
            at = np.repeat(starts[of] + CONTEXT * number - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
            offsets = np.append(0, 2 * ends).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[keep]), pa.array(tx.signed(tx.mixed(key[keep]))),
                 pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets), pa.py_buffer(line[at])])],
                names=["shard", "place", "slots"])

    return ids.select("doc_id", "tag", "ids").mapInArrow(run, "shard int, place long, slots binary")


def _by_shard(batches):
    """Windows of each shard of sorted rows, -1 behind the end of a text."""
    parts, current = [], None
    for batch in batches:
        shard = batch.column(0).to_numpy()
        data, bounds = tx.flat(batch.column(2))
        sizes = np.diff(bounds) // 2
        rows = np.full((len(sizes), CONTEXT + 1), -1, np.int16)
        rows[np.arange(CONTEXT + 1) < sizes[:, None]] = data.view("<u2")
        for piece in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
            if len(piece) and shard[piece[0]] != current:
                if parts:
                    yield current, np.concatenate(parts)
                parts, current = [], int(shard[piece[0]])
            parts.append(rows[piece])
    if parts:
        yield current, np.concatenate(parts)


def _averaged(rows: DataFrame, model: Model, first: bool) -> Model:
    """The model with the mean of the weights that the shards among the windows end with."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = sorted(model.p)

    def run(batches):
        total = None
        for shard, found in _by_shard(batches):
            own = replace(sent.value, p={k: a.copy() for k, a in sent.value.p.items()})
            x, y = np.maximum(found[:, :-1], 0), found[:, 1:]
            own.fit(x, y, 5 + shard, *(() if first else (1, LATER_RATE)))
            flat = np.concatenate([own.p[k].ravel() for k in names] + [np.ones(1)])
            sums = np.rint(flat * UNIT).astype(np.int64) * len(found)
            total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                             names=["at", "value"])

    # A shard is sorted, so what it learns does not depend on where its windows come from.
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "place", "slots")
    found = dealt.mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    if not found.num_rows:
        return model
    values = np.zeros(found.num_rows)
    values[found.column("at").to_numpy()] = found.column("value").to_numpy()
    values, p, at = values[:-1] / values[-1], {}, 0
    for k in names:
        size = model.p[k].size
        p[k] = values[at:at + size].reshape(model.p[k].shape).astype(np.float32)
        at += size
    return replace(model, p=p)


def _word_counts(batches):
    for batch in tx.slices(batches):
        found, n = np.unique(tx.word_hashes(*tx.flat(batch.column(1)))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tx.signed(found)), pa.array(n.astype(np.int64))],
                                         names=["word", "n"])


def _base_rows(head: np.ndarray, weights: np.ndarray):
    """Rows of a text: one with what the frequent words give, and one for each other word."""

    def run(batches):
        for batch in tx.slices(batches):
            hashes, rows = tx.word_hashes(*tx.flat(batch.column(1)))
            size = batch.num_rows
            at = np.searchsorted(head.value, hashes)
            at[at == len(head.value)] = 0
            known = head.value[at] == hashes if len(head.value) else np.zeros(len(hashes), bool)
            base = np.bincount(rows[known], weights.value[at[known]], minlength=size)
            n_known = np.bincount(rows[known], minlength=size)
            tokens = np.bincount(rows, minlength=size)
            other, row = hashes[~known], rows[~known]
            order = np.lexsort((other, row))
            other, row = other[order], row[order]
            new = np.append(True, (other[1:] != other[:-1]) | (row[1:] != row[:-1]))[:len(other)]
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(other)))
            pick = np.append(np.arange(size), row[first])
            pad, none = np.zeros(len(first)), np.zeros(len(first), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(pick)), batch.column(2).take(pa.array(pick)),
                 pa.array(np.append(np.zeros(size, np.int64), tx.signed(other[first])),
                          mask=np.append(np.ones(size, bool), none > 0)),
                 pa.array(np.append(np.zeros(size, np.int64), many)), pa.array(np.append(base, pad)),
                 pa.array(np.append(n_known, none)), pa.array(np.append(tokens, none))],
                names=["doc_id", "tag", "word", "times", "base", "n_known", "n_tokens"])

    return run


def scored(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text has the end of a text as its only token. Rows with the same id and the same text
    are scored once; a row without an id is never held out. Without training documents all tokens are
    equally likely. An empty table gives no rows. Words are told apart by hashes of 64 bits.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = tx.plain(docs).select("doc_id", "text", F.xxhash64("text").alias("tag"))
    is_held = held_out(F.nullif("doc_id", F.lit(tx.NO_ID)), 7)
    own = texts.where(~is_held)
    counts = materialise(own.select("doc_id", "text").mapInArrow(_word_counts, "word long, n long")
                         .groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    ends = own.count()
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    train_tokens = (totals[0] or 0) + ends
    below = float(train_tokens + totals[1] + (1 if ends else 0) + 1)
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD)
    found = head.toArrow()
    words = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    weights = np.log10((found.column("n").to_numpy()[order] + 1) / below)
    rows = texts.mapInArrow(
        _base_rows(sc.broadcast(words[order]), sc.broadcast(weights)),
        "doc_id long, tag long, word long, times long, base double, n_known long, n_tokens long")
    # Words outside the head meet their counts; those without any were never seen.
    least = int(found.column("n").to_numpy().min()) if len(words) else 0
    tail = counts.where(F.col("n") <= least).withColumnRenamed("word", "of_word")
    met = rows.join(tail, F.col("word") == F.col("of_word"), "left")
    base = met.select(
        "doc_id", "tag", "n_tokens",
        (F.col("n_known") + F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / below)).alias("base"),
        F.lit(0.0).alias("score"), (F.col("word").isNull()).cast("int").alias("copies"))

    ids = materialise(token_ids(docs, tokenizer), "token-ids")
    from tokenizers import Tokenizer

    model = sc.broadcast(trained(ids, Tokenizer.from_file(tokenizer).get_vocab_size()))

    def run(batches):
        for batch in tx.slices(batches, text=2, limit=1 << 20):
            scores = model.value.score([np.frombuffer(r, "<u2") for r in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)],
                                             names=["doc_id", "tag", "score"])

    modelled = ids.select("doc_id", "tag", "ids").mapInArrow(run, "doc_id long, tag long, score double").select(
        "doc_id", "tag", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"),
        F.lit(0.0).alias("base"), "score", F.lit(0).alias("copies"))
    summed = base.unionByName(modelled).groupBy("doc_id", "tag").agg(
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "copies")])
    end = float(np.log10((ends + 1) / below))
    per = F.greatest("copies", F.lit(1))
    return summed.select(
        tx.given_id(), is_held.alias("held_out"),
        ((F.col("n_tokens") / per).cast("long") + 1).alias("n_tokens"),
        ((F.col("n_known") / per).cast("long") + (1 if ends else 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") / per + end).alias("base_score"), (F.col("score") / per).alias("score"))
