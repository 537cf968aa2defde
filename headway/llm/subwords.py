"""Subword ids of whole texts from a public tokenizer, with a cache of words."""

from __future__ import annotations

import os

import numpy as np

from headway.llm import workers

#: Words of each of the two generations of the cache.
CACHE_WORDS = 400_000
#: Marks that form a token of their own after a letter or digit.
MARKS = b".,!?;:%&*$#)\""
#: A digit is always one token, so it parts words that have none like it.
DIVIDER = b"0"


class WordIds:
    """Ids of texts whose tokens never span white space, as little-endian 32-bit bytes.

    Words repeat, so each is encoded once; new words of a batch are encoded together in one call, and
    a word before marks is known if the bare word is. Words unused for a while leave the cache.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.divider = self.tokenizer.encode(DIVIDER.decode(), add_special_tokens=False).ids[0]

    def _ids(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def learn(self, new: list[bytes]) -> None:
        odd = [w for w in new if DIVIDER in w or b"<|" in w]
        plain = [w for w in new if not (DIVIDER in w or b"<|" in w)]
        if plain:
            text = f" {DIVIDER.decode()} ".join(w.decode("utf-8", "replace") for w in plain)
            ids = np.array(self._ids(text).ids, "<u4")
            cuts = np.concatenate([[-1], np.flatnonzero(ids == self.divider), [len(ids)]]) * 4
            raw = ids.tobytes()
            self.known.update((w, raw[a + 4:b]) for w, a, b in zip(
                plain, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        for w in odd:
            self.known[w] = np.array(self._ids(w.decode("utf-8", "replace")).ids, "<u4").tobytes()

    def recall(self, wanted: set[bytes]) -> list[bytes]:
        """Bring back words of the older generation; the words that neither has."""
        known, older, new = self.known, self.older, []
        for w in wanted:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        return new

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        # A special token's name is found as written only; elsewhere case does not matter to the ids.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        new = self.recall(set().union(*split))
        parts = {}
        for w in new:
            bare = w.rstrip(MARKS)
            if len(bare) < len(w) and bare[-1:].isalnum():
                parts[w] = bare, w[len(bare):]
        whole = {w for w in new if w not in parts}
        self.learn(self.recall(whole.union(*parts.values())))
        known = self.known
        known.update((w, known[a] + known[b]) for w, (a, b) in parts.items())
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]


#: The name by which workers keep the encoders.
KEPT_AS = "subwords"


def encoder(path: str) -> WordIds:
    known = workers.KEPT.setdefault(KEPT_AS, {})
    if path not in known:
        known[path] = WordIds(path)
    return known[path]
