import zlib

import numpy as np
import pytest

from ticketloom.llm import packing, token_files as tf
from ticketloom.llm.tokens import WordIds, vocabulary_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")


ODD = [None, "", "  ", "a.b, c.", "<|endoftext|>. x", "X <|startoftext|>y", "don't... I'll,", "H̱ ẖ Å", "x\x1cz\x85w\xa0v",
       "ÉCOLE. école.", "1234,567.", "...", "a.", "İstanbul. ΣΑΣ.", "日本語。テスト", "\U0001F600."]


def test_word_cache_gives_the_tokenizers_ids(plain):
    for limit in (10 ** 6, 8):
        w = WordIds(vocabulary_path(), limit)
        for _ in range(2):
            ids, n = w.encode(ODD)
            for x, part in zip(ODD, np.split(ids, np.cumsum(n)[:-1])):
                assert part.tolist() == plain(x).tolist(), x


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        docs = [np.append(rng.integers(5, 12, rng.integers(0, 90)), 2).astype(np.uint16) for _ in range(n // 40 + 1)]
        ids, lengths = np.concatenate(docs), np.array([len(d) for d in docs])
        b = tf.Block(tf.write_block(ids, lengths))
        assert (b.ids() == ids).all()
        assert all((b.document(k) == d).all() for k, d in enumerate(docs))
        d = len(docs) // 2
        for s, e in ((0, 1), (0, len(docs[d])), (len(docs[d]) // 2, len(docs[d]))):
            assert (b.stretch(d, s, e) == docs[d][s:e]).all()
    assert len(b.rules) and len(b.symbols) < len(ids)
    with pytest.raises(ValueError):
        tf.Block(b"none")


def test_repair_goes_on_to_the_end():
    """Copies of a passage and runs of one id shrink to their grammar; no frequent pair is left."""
    rng = np.random.default_rng(3)
    passage = rng.permutation(np.arange(100, 3100)).astype(np.uint16)
    ids = np.concatenate([np.append(np.concatenate((rng.integers(4000, 60000, 3), passage)), 2) for _ in range(200)]).astype(np.uint16)
    symbols, rules = tf.repair(ids)
    assert len(symbols) <= 200 * 6 and 2900 <= len(rules) <= 3100
    bare = np.tile(np.append(passage, 2), 200).astype(np.uint16)
    assert len(tf.repair(bare)[0]) < 300
    for n in (100_000, 99_999, 31, 5):
        same = np.full(n, 7, np.uint16)
        b = tf.Block(tf.write_block(same, np.array([n])))
        assert len(b.symbols) < 100 and (b.ids() == same).all()
    mixed = np.concatenate([np.repeat(rng.integers(3, 6, 400), rng.integers(1, 9, 400)), rng.integers(3, 30, 5000)]).astype(np.uint16)
    symbols, _ = tf.repair(mixed)
    pairs = [(a, b) for a, b in zip(symbols[:-1], symbols[1:]) if a != b]
    assert max(pairs.count(p) for p in set(pairs)) < tf.MIN_COUNT
    b = tf.Block(tf.write_block(mixed, np.array([len(mixed)])))
    assert (b.ids() == mixed).all() and (b.stretch(0, 1234, 4321) == mixed[1234:4321]).all()


def test_token_digest(docs, odd, empty, plain):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in docs.collect()), key=lambda x: x[:2])
    got = tf.token_digest(docs).collect()
    assert sorted((r.start, r.n_tokens) for r in got)[0][0] == 0
    at, want = 0, []
    for known, i, t in rows:
        x = plain(t)
        want.append((i if known else None, len(x), zlib.crc32(x)))
        at += len(x)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    ordered = sorted(got, key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:])) and ordered[-1].start + ordered[-1].n_tokens == at
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert tf.token_digest(empty).count() == 0
    assert tf.token_digest(odd).count() == len(rows)


def check_pieces(rows, lengths, content):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == s[0].window or s[0].window == 4096
    pad = sum(s[0].window - sum(r.length for r in s) for s in by_seq.values())
    for i, n in lengths.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == n and r.ids_crc32 == zlib.crc32(content[i][at:at + r.length])
            at += r.length
        assert at == n
    return pad


def test_packing(docs, odd, empty, plain):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    content = {r.doc_id: plain(r.text) for r in one.collect()}
    pad = check_pieces(packing.pack_digest(one).collect(), {i: len(x) for i, x in content.items()}, content)
    assert pad < 4096
    assert sum(r.length for r in packing.pack_digest(odd).collect()) == sum(len(plain(r.text)) for r in docs.collect())
    assert packing.pack_digest(empty).count() == 0


def test_groups_of_null_ids_and_parts(spark, plain, monkeypatch):
    """Rows without an id are dealt by their text; a group of equal rows is packed in parts."""
    monkeypatch.setattr(packing, "PART_IDS", 3000)
    texts = [f"text {k} " * 40 for k in range(60)] + ["the same words " * 30] * 90
    df = spark.createDataFrame([(None if k % 2 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = packing.packed(df, group_bytes=4000).collect()
    assert sum(r.length for r in rows) == sum(len(plain(t)) for t in texts)
    seen = {}
    for r in rows:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length, r.window))
    for parts in seen.values():
        at = 0
        for offset, n, window in sorted(parts):
            assert offset == at
            at += n
        assert at <= parts[0][2]
    assert len({r.sequence_id >> 32 for r in rows}) >= 6


def test_packer_and_steps():
    import random

    rng = random.Random(1)
    for _ in range(100):
        lengths = [rng.choice([1, 2, rng.randint(1, 600), rng.randint(1, 30000)]) for _ in range(rng.choice([0, 1, 5, 60]))]
        seen = {}
        for window, pieces in packing.pack(lengths):
            used = sum(p[2] for p in pieces)
            assert 0 < used <= window <= 4096 and (used == window or window == 4096)
            for d, s, n in pieces:
                seen.setdefault(d, []).append((s, n))
        for d, n in enumerate(lengths):
            at = 0
            for s, k in sorted(seen[d]):
                assert s == at
                at += k
            assert at == n
    steps = packing.steps_of([4096] * 90 + [512] * 80)
    assert max(steps) >= 1 and all(abs(steps[:90].count(k) - 90 / (max(steps) + 1)) <= 1 for k in set(steps))
