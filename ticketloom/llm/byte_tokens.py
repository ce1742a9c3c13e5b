"""Token ids of whole texts by a byte-level BPE file, chunk by chunk.

Such a tokenizer never joins what stands before a gap and behind it: the last white-space
character of a gap opens the next token, what comes before it in the gap closes the one
before. So a text falls into chunks, each a space or line break and the characters behind
it, with the rest of the following gap; its ids are the ids of the chunks in order. Each
Python worker encodes a chunk once and keeps it. A text that may hold a special token's
string goes to the tokenizer whole.
"""

from __future__ import annotations

import numpy as np

from ticketloom.llm.tokens import WordIds, _room, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: Chunks a worker keeps at most (about 150 bytes each).
CACHE_CHUNKS = 300_000
#: Chunks encoded behind each other at a time.
RUN = 128


def _string(key: bytes) -> bytes:
    """The text of a chunk: the first of a text is kept behind a space, others without theirs."""
    return key[1:] if key[:1] == b" " else key if key[:1] == b"\n" else b" " + key


#: First bytes of a chunk behind its space that are white space, and those that may begin some.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_MAYBE = np.zeros(256, bool)
_MAYBE[[10, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class ChunkIds(WordIds):
    """Chunk to number, with the ids of each chunk, and whether it goes on with the one before."""

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        super().__init__(path, limit)
        self.joins = np.zeros(1 << 14, bool)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]  # one character for each byte

    def _learn(self) -> None:
        """Encode the new chunks behind each other, and cut the ids by the bytes each stands for."""
        new, base = self.new, len(self) - len(self.new)
        lead = np.frombuffer(b"".join([k[:1] or b"\t" for k in new]), np.uint8)
        first, broken = lead == 32, lead == 10
        # a space or line break alone, or before more white space, belongs to the gap of the chunk before
        joins = _BLANK[lead]
        for k in np.flatnonzero(_MAYBE[lead]).tolist():
            t = _string(new[k]).decode("utf-8")
            joins[k] = len(t) < 2 or t[1].isspace()
        size, flat = np.zeros(len(new), np.int32), [np.zeros(0, np.uint16)]
        order = []
        for at, gap in ((np.flatnonzero(~first & ~broken & ~joins), b" "), (np.flatnonzero(broken & ~joins), b"")):
            order.append(at)
            run = [new[k] for k in at.tolist()]
            some = [(gap + gap.join(run[k:k + RUN])).decode("utf-8") for k in range(0, len(run), RUN)]
            ids = [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            if ids:
                flat += ids
                ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + len(gap))
                size[at] = np.diff(np.searchsorted(np.cumsum(self.bytes[np.concatenate(ids)]), ends, "right"), prepend=0)
        at = np.flatnonzero(first)
        order.append(at)
        for k in at.tolist():
            ids = np.array(self._ids([_string(new[k]).decode("utf-8")])[0], np.uint16)
            flat.append(ids)
            size[k] = len(ids)
        flat, order = np.concatenate(flat), np.concatenate(order)
        place = np.zeros(len(new), np.int64)
        place[order] = np.cumsum(size[order]) - size[order]
        self.flat = _room(self.flat, self.used + len(flat))
        self.flat[self.used:self.used + len(flat)] = flat
        self.first, self.size, self.joins = (_room(x, base + len(new)) for x in (self.first, self.size, self.joins))
        self.first[base:base + len(new)] = self.used + place
        self.size[base:base + len(new)] = size
        self.joins[base:base + len(new)] = joins
        self.used += len(flat)
        self.added += self.new
        self.new = []

    def _forget(self, base: int) -> None:
        if len(self) > self.limit:
            for w in self.added:
                del self[w]
            self.used = int((self.first[:base] + self.size[:base]).max()) if base else 0
        self.added = []

    def encode(self, texts: list[bytes | None], end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all UTF-8 texts behind each other (uint16), and the number of ids of each."""
        base = len(self)
        keys: list[bytes] = []
        counts, whole = [], {}
        for k, text in enumerate(texts):
            if text and b"<|" in text:
                whole[k] = self._ids([text.decode("utf-8")])[0]
                counts.append(0)
                continue
            parts = text.replace(b"\n", b" \n").split(b" ") if text else []
            if parts:
                parts[0] = b" " + parts[0]
            counts.append(len(parts))
            keys += parts
        numbers = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        if self.new:
            self._learn()
        joins = self.joins[numbers]
        if joins.any():
            heads = np.flatnonzero(~joins)
            more = np.diff(np.append(heads, len(keys)))
            for h, m in zip(heads[more > 1].tolist(), more[more > 1].tolist()):
                numbers[h] = self[keys[h] + b"".join(map(_string, keys[h + 1:h + m]))]
            if self.new:
                self._learn()
            kept = np.concatenate(([0], np.cumsum(~joins)))
            edges = kept[np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))]
            numbers = numbers[heads]
        else:
            edges = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
        size = self.size[numbers].astype(np.int64)
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[numbers] - (ends - size), size)
        flat = self.flat[at]
        edges = np.concatenate(([0], ends))[edges]
        self._forget(base)
        if end is None and not whole:
            return flat, np.diff(edges)
        tail = np.array([] if end is None else [end], np.uint16)
        parts = []
        for k in range(len(texts)):
            parts += [np.array(whole[k], np.uint16) if k in whole else flat[edges[k]:edges[k + 1]], tail]
        lengths = np.array([len(p) + len(tail) for p in parts[::2]], np.int64)
        return np.concatenate(parts) if parts else flat, lengths


_WORKER: dict[str, ChunkIds] = {}


def worker_chunks(path: str | None = None) -> ChunkIds:
    """The encoder of this Python worker; it outlives a task where workers are reused."""
    path = path or vocabulary_path(VOCABULARY)
    if path not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORKER[path] = ChunkIds(path)
    return _WORKER[path]
