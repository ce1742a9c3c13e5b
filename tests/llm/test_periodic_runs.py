import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from ticketloom.llm import periodic_runs as pr


def plain_runs(w, least=12):
    """Every period, every stretch that agrees with itself one period on."""
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, 2 * q):
                found.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_digest(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4), st.integers(2, 13))
def test_few_words(documents, least):
    got = pr.word_runs([np.array(d, np.int64) for d in documents], least)
    assert got == [plain_runs(d, least) for d in documents]


def test_built_runs():
    rng = random.Random(3)
    documents = [[0] * 400, [0, 1] * 150 + [0], [k for _ in range(9) for k in range(40)] + [1, 2, 3]]
    for _ in range(60):
        d = []
        while len(d) < 300:
            block = [rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randint(1, 30))]
            d += block * rng.randint(1, 7) + block[:rng.randrange(len(block) + 1)]
        documents.append(d)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    documents.append(fib[-1])
    got = pr.word_runs([np.array(d, np.int64) for d in documents])
    assert got == [plain_runs(d) for d in documents] and sum(map(len, got)) > 150


def test_one_phrase_behind_many_words():
    d = [x for k in range(400) for x in (*range(14), 100 + k)]
    assert pr.word_runs([np.array(d, np.int64)]) == [plain_runs(d)] == [[]]


key = lambda r: tuple((x is not None, x) for x in r)


def test_digest(spark, docs, odd, empty):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted((plain_digest(r.doc_id, r.text if len(r.text or "") < 60_000 else None) for r in docs.collect()), key=key)
    short = "case when length(text) < 60000 then text end as text"
    got = pr.run_digest(docs.selectExpr("doc_id", short)).select(columns).collect()
    assert sorted(map(tuple, got), key=key) == want
    assert pr.run_digest(odd).count() == pr.run_digest(docs).count() == docs.count()
    assert pr.run_digest(empty).count() == 0


def test_planted_documents_of_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 6000")
    want = {r.doc_id: plain_digest(r.doc_id, r.text) for r in docs.collect()}
    got = {r.doc_id: tuple(r)[:8] for r in pr.run_digest(docs).collect()}
    assert got == want and sum(r[1] > 0 for r in want.values()) > 5


def test_collapsed_text_and_steps(spark, monkeypatch):
    rows = [(1, "a b " * 10 + "c"), (2, None), (3, "x y z"), (4, "é " * 40 + "ü")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in pr.collapsed(df).collect()} == {
        1: ("a b c", [(0, 20, 2)]), 2: ("", []), 3: ("x y z", []), 4: ("é ü", [(0, 40, 1)])}
    numbers = pr._finder(12, None)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([t for _, t in rows]), pa.array([50, 0, 5, 120], pa.int64())],
                                       names=["doc_id", "text", "size"])
    whole = [r for b in numbers([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(pr, "STEP_BYTES", 10)
    monkeypatch.setattr(pr, "KNOWN_WORDS", 1)
    assert [r for b in pr._finder(12, None)([batch]) for r in b.to_pylist()] == whole
