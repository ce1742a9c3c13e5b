"""Token ids of whole texts, by a public tokenizer file.

The tokenizer splits at white space before it looks at anything else, so a text's ids
are the ids of its words in order. Each Python worker encodes a word once and keeps it;
a text is then a few array lookups. Words beyond the cache's bound are encoded again
when they come again. A text that may hold a special token's string goes to the
tokenizer whole.
"""

from __future__ import annotations

import re

import numpy as np

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Words a worker keeps at most (about 150 bytes each).
CACHE_WORDS = 400_000
#: Words encoded behind each other at a time.
RUN = 128
#: Words that any normal form and case leave as they are, without a cut inside.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a worker finds a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """Word to number, with the ids of each word; new words are numbered and noted."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.new, self.added = limit, [], []
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encoded(self, stems: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stems behind each other, and the number of ids of each.

        A word of plain letters is one unit of the tokenizer, whose last id says that a word
        ends, so such words are encoded many at a time and cut there; others one by one.
        """
        size, order, flat = np.zeros(len(stems), np.int64), [], [np.zeros(0, np.uint16)]
        texts = [s.decode("utf-8", "surrogatepass") for s in stems]
        plain = np.fromiter((_PLAIN(t) is not None for t in texts), bool, len(texts))
        at = np.flatnonzero(plain)
        if len(at):
            run = [texts[k] for k in at.tolist()]
            some = [" ".join(run[k:k + RUN]) for k in range(0, len(run), RUN)]
            ids = np.concatenate([np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)])
            size[at] = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            flat.append(ids)
            order.append(at)
        at = np.flatnonzero(~plain)
        if len(at):
            ids = self._ids([texts[k] for k in at.tolist()])
            size[at] = [len(i) for i in ids]
            flat.append(np.array([i for x in ids for i in x], np.uint16))
            order.append(at)
        flat, order = np.concatenate(flat), np.concatenate(order)
        first = np.zeros(len(stems), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        return flat[_spread(first, size)], size

    def _learn(self) -> None:
        """Encode the new words. The tokenizer ignores case; a full stop or comma behind an ASCII
        letter is a token of its own."""
        new, base = self.new, len(self) - len(self.new)
        ended = [len(w) > 1 and w[-1] in b".," and w[-2:-1].isalpha() for w in new]
        stems = [w[:-1] if e else w for w, e in zip(new, ended)]
        stems = [s.lower() if s.isascii() else s for s in stems]
        ask = {s: None for s in stems if s not in self or self[s] >= base}
        ask.update({b".": None, b",": None})
        flat, size = self._encoded(list(ask))
        # places of the stems: of this round behind all that is known, of earlier rounds where they are
        known = {s: k for k, s in enumerate(ask)}
        end = self.used + np.cumsum(size)
        mine = np.fromiter((known.get(s, -1) for s in stems), np.int64, len(stems))
        old = np.fromiter((self[s] if k < 0 else 0 for s, k in zip(stems, mine.tolist())), np.int64, len(stems))
        first = np.where(mine >= 0, (end - size)[mine], self.first[old])
        n = np.where(mine >= 0, size[mine], self.size[old])
        both = np.concatenate((self.flat[:self.used], flat))
        tail = np.fromiter((known[w[-1:]] if e else -1 for w, e in zip(new, ended)), np.int64, len(new))
        more = np.where(tail >= 0, size[tail], 0)
        total = n + more
        at = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.uint16)
        out[_spread(at, n)] = both[_spread(first, n)]
        out[_spread(at + n, more)] = both[_spread((end - size)[tail], more)]
        self.flat = _room(self.flat, self.used + len(out))
        self.flat[self.used:self.used + len(out)] = out
        self.first, self.size = _room(self.first, base + len(new)), _room(self.size, base + len(new))
        self.first[base:base + len(new)] = self.used + at
        self.size[base:base + len(new)] = total
        self.used += len(out)
        self.added += self.new
        self.new = []

    def _forget(self, base: int) -> None:
        """Drop the words of this call if there are too many; ``base`` were known before it."""
        if len(self) > self.limit:
            for w in self.added:
                del self[w]
            self.used = int((self.first[base - 1] + self.size[base - 1])) if base else 0
        self.added = []

    def encode(self, texts: list[str | None], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other (uint16), and the number of ids of each."""
        base = len(self)
        numbers, counts, whole = [], [], {}
        get = self.__getitem__
        for k, text in enumerate(texts):
            if text and "<|" in text:
                whole[k] = self._ids([text])[0]
                counts.append(0)
                continue
            ws = text.encode("utf-8", "surrogatepass").split() if text else ()
            counts.append(len(ws))
            numbers.extend(map(get, ws))
        if self.new:
            self._learn()
        n = np.array(numbers, np.int64)
        size = self.size[n].astype(np.int64)
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[n] - (ends - size), size)
        flat = self.flat[at]
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))]
        self._forget(base)
        lengths = np.diff(edges)
        extra = 0 if end is None else 1
        if not extra and not whole:
            return flat, lengths
        parts = []
        for k in range(len(texts)):
            ids = np.array(whole[k], np.uint16) if k in whole else flat[edges[k]:edges[k + 1]]
            parts.append(ids)
            lengths[k] = len(ids) + extra
            if extra:
                parts.append(np.array([end], np.uint16))
        return np.concatenate(parts) if parts else flat, lengths


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first, first + 1, ... of every stretch, behind each other."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out


_WORKER: dict[str, WordIds] = {}


def worker_encoder(path: str) -> WordIds:
    """The encoder of this Python worker; it outlives a task where workers are reused."""
    if path not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORKER[path] = WordIds(path)
    return _WORKER[path]
