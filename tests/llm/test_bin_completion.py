import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ticketloom.llm import bin_completion as bc
from ticketloom.llm.byte_tokens import VOCABULARY, ChunkIds
from ticketloom.llm.tokens import vocabulary_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]


ODD = [None, "", " ", "  ", "\n", "\n\n", " \n ", "a", " a", "  a", "a ", "a  ", "a\nb", "a\n\nb", "a \nb", "a\n b", "a \n\n  b\t c",
       "\ta\t\tb", "a b  c", "　x 　　y", "<|endoftext|> x", "a<|endoftext|>", "don't  I'll 's", "x1 22 333  4",
       "é́ \U0001F600  ok", "a\r\nb\r\n\r\nc", " \x1c a \x1d", "a\x85 \x85b", "...  ,,,\n!!!", "\n \n \na", "日本語 テスト\n"]


def test_chunks_give_the_tokenizers_ids(plain):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice([" ", " ", "\n", "\t", "a", "b1", "é", " ", ".", "'s", "\r\n"]) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    for limit in (10 ** 6, 40):
        w = ChunkIds(vocabulary_path(VOCABULARY), limit)
        for step in (len(texts), 7):
            for k in range(0, len(texts), step):
                part = texts[k:k + step]
                ids, n = w.encode([t if t is None else t.encode() for t in part])
                for t, x in zip(part, np.split(ids, np.cumsum(n)[:-1])):
                    assert x.tolist() == plain(t), repr(t)


def fewest(lengths, capacity):
    """Fewest sequences by dynamic programming over subsets."""
    n = len(lengths)
    best = [(0, 0)] + [(n + 1, 0)] * ((1 << n) - 1)
    for mask in range(1, 1 << n):
        options = []
        for i in range(n):
            if mask >> i & 1:
                bins, last = best[mask ^ (1 << i)]
                options.append((bins, last + lengths[i]) if bins and last + lengths[i] <= capacity else (bins + 1, lengths[i]))
        best[mask] = min(options)
    return best[-1][0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(30, 40))
def test_search_finds_the_fewest(lengths, capacity):
    got = bc.complete(lengths, capacity, nodes=4000)
    assert sorted(n for s in got for n in s) == sorted(lengths) and all(sum(s) <= capacity for s in got)
    want = fewest(lengths, capacity)
    assert bc.lower_bound(lengths, capacity) <= want == len(got)


def test_search_beats_best_fit():
    better = 0
    for seed in range(200):
        rng = random.Random(seed)
        lengths = [rng.randint(15, 70) for _ in range(40)]
        fit, got = len(bc.best_fit(sorted(lengths, reverse=True), 100)), bc.complete(lengths, 100, nodes=4000)
        assert sorted(n for s in got for n in s) == sorted(lengths) and all(sum(s) <= 100 for s in got)
        assert bc.lower_bound(lengths, 100) <= len(got) <= fit
        better += len(got) < fit
    assert better >= 10


def test_fillings_are_undominated():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(1, 20) for _ in range(9)]
        room = rng.randint(5, 40)
        got = bc.fillings(room, bc.Pieces(lengths, 50), room)
        assert got == sorted(got, key=lambda x: x[0]) and got
        sets = [c for m in range(len(lengths) + 1) for c in combinations(sorted(lengths, reverse=True), m) if sum(c) <= room]
        assert got[0][0] == room - max(map(sum, sets))
        for waste, chosen in got:
            assert waste == room - sum(chosen) and tuple(chosen) in sets
            rest = list(lengths)
            for n in chosen:
                rest.remove(n)
            for m in range(1, len(chosen) + 1):
                for part in combinations(chosen, m):
                    assert not any(sum(part) + (m == 1) <= x <= sum(part) + waste for x in rest)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def check(rows, docs, plain, capacity=2048):
    want = []
    for r in docs:
        ids = plain(r.text)
        at = 0
        for k, n in enumerate([(len(ids) - 1) % capacity + 1] + [capacity] * ((len(ids) - 1) // capacity)):
            want.append((r.doc_id, k, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4"))))
            at += n
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.filled))
    for parts in sequences.values():
        at = 0
        for offset, n, filled in sorted(parts):
            assert offset == at and filled == sum(p[1] for p in parts)
            at += n
        assert at <= capacity
    return len(sequences), bc.lower_bound([w[3] for w in want], capacity)


def test_digest(docs, odd, empty, plain):
    rows = bc.pack_digest(docs).collect()
    used, least = check(rows, docs.collect(), plain)
    assert used == least
    assert sorted(map(str, rows)) == sorted(map(str, bc.pack_digest(docs.repartition(5)).collect()))
    assert bc.pack_digest(odd).count() == len(rows)
    assert bc.pack_digest(empty).count() == 0


def test_groups_climb(spark, small, plain):
    """Many small groups: what they leave over is packed together; equal rows fill parts of a group."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(150)
    docs = docs.union(spark.createDataFrame([(None, "one and the same text. " * 9)] * 60, "doc_id long, text string")).cache()
    rows = bc.packed(docs, 256, group_bytes=20_000, part_ids=900, climb=3).withColumn("ids_crc32", bc.F.crc32("ids")).collect()
    used, least = check(rows, docs.collect(), plain, 256)
    assert least <= used <= 1.02 * least + 1
