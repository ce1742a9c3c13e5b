import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ticketloom.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def tree(nodes, fanout):
    """The root, and for each node its list of (before, after)."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // fanout * fanout:i // fanout * fanout + fanout]
            proofs[k].append((run[:i % fanout], run[i % fanout + 1:]))
        level = [H(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return (level or [None])[0], proofs


def plain(rows, fanout=8):
    leaves = {}
    for r in rows:
        x = H(*map(enc, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))
        bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        y = H(*map(enc, (r.doc_id, r.source, r.lang, r.n_chars, lower(r.text) if bad else r.text)))
        leaves.setdefault(r.lang, []).append(((r.doc_id is not None, r.doc_id or 0, x), y))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        leaves[lang].sort(key=lambda x: x[0])
        trees[lang] = tree([x[0][2] for x in leaves[lang]], fanout)
    root, tops = tree([trees[lang][0] for lang in langs], fanout)
    out = []
    for lang, top in zip(langs, tops):
        for ((known, i, x), y), proof in zip(leaves[lang], trees[lang][1]):
            now = y
            for before, after in proof + top:
                now = H(*before, now, *after)
            out.append((i if known else None, x, trees[lang][0], root,
                        H(*(d for b, a in proof + top for d in b + a)), now, now == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
key = lambda r: tuple((x is not None, x) for x in r)


def got(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=key)


def test_digest(docs, odd, empty):
    docs, odd = (df.withColumn("text", F.concat(F.lit("Aé"), "text")) for df in (docs, odd))
    want = sorted(plain(docs.collect()), key=key)
    assert got(merkle.manifest_digest(docs)) == want
    assert got(merkle.manifest_digest(odd)) == want
    assert merkle.manifest_digest(empty).count() == 0
    assert 0 < sum(not r[-1] for r in want) < len(want)


@pytest.mark.parametrize("fanout, height", [(2, 0), (2, 1), (2, 2), (3, 1), (8, 0), (8, 1), (8, 3)])
def test_trees_of_every_size(spark, fanout, height):
    """Languages of 1 to 43 documents, among them incomplete last subtrees on every level."""
    rows = [(100 * n + k, f"Text {k}", None if n == 3 else f"l{n:02}", None, k) for n in (*range(1, 20), 27, 28, 32, 33, 43) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    m = merkle.manifest(docs, fanout=fanout, height=height).withColumn("again", merkle.folded("leaf", "proof")).collect()
    assert all(r.again == r.root for r in m) and len(m) == len(rows)
    want = {r[0]: r[1:5] for r in plain(docs.collect(), fanout)}
    for r in m:
        proof = hashlib.sha256("".join(s.before + s.after for s in r.proof).encode()).hexdigest()
        assert want[r.doc_id] == (r.leaf, r.subroot, r.root, proof), (r.lang, r.place)


def test_one_language_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SORT_ROWS", 50)
    monkeypatch.setattr(merkle, "BROADCAST_PROOFS", 2)
    docs = spark.range(700).select(
        F.when(F.col("id") < 400, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("A b").alias("text"),
        F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    assert got(merkle.manifest_digest(docs)) == sorted(plain(docs.collect()), key=key)
    places = [r.place for r in merkle.manifest(docs).collect()]
    assert sorted(places) == list(range(700))


def test_any_change_breaks_the_proof(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "en", "s", 2) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    m = merkle.manifest(docs, seen=F.when(F.col("doc_id") == 7, "t8").otherwise(F.col("text")))
    assert {r.doc_id for r in m.where(merkle.folded("found", "proof") != F.col("root")).collect()} == {7}
