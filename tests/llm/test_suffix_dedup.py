import hashlib
import random

import pytest

from ticketloom.llm import suffix_dedup as sd


def brute(rows):
    seen, out = {}, {}
    rows = sorted(rows, key=lambda r: r[0])
    for k, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 99):
            seen.setdefault(b[p:p + 100], (k, p))
    for k, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99):
            if seen[b[p:p + 100]] != (k, p):
                gone[p:p + 100] = [True] * 100
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def corpus():
    rng = random.Random(3)
    rnd = lambda n: "".join(rng.choice("abcé \n") for _ in range(n))
    passages, rows = [rnd(150) for _ in range(4)], []
    for i in range(60):
        parts = [rnd(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 4)):
            q, a = rng.choice(passages), rng.randint(0, 30)
            parts += [q[a:a + rng.randint(60, 150)], rnd(rng.choice([0, 1, 50]))]
        rows.append((i, "".join(parts)))
    return rows + [(200, "ab" * 400), (201, "x" * 99), (202, "x" * 500), (203, None), (204, ""), (205, rows[3][1]),
                   (206, rows[3][1] + "z"), (207, "abc" * 300 + "q" + "abc" * 90), (208, rnd(3000)), (-4, rows[5][1])]


@pytest.mark.parametrize("hot,chunk", [(10_000, 1 << 20), (3, 256)])
def test_equal_to_brute_force(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "CHUNK", chunk)
    rows = corpus()
    got = {r.doc_id: tuple(r)[1:] for r in sd.suffix_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_edges(docs, odd, empty):
    rows = sd.removed(docs).collect()
    assert len(rows) == docs.count() and all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    assert [r.n_removed for r in rows if r.doc_id == 37] == [r.n_bytes for r in rows if r.doc_id == 37]
    assert sd.suffix_digest(odd).count() == len(rows)
    assert sd.suffix_digest(empty).count() == 0
