import random
import zlib

from ticketloom.llm import toxicity as tx

BAD = ["grobnik", "zartloz", "vukmar"]


def corpus(n=500):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ta", "ri", "on", "es", "ma"]) for _ in range(rng.randint(1, 5)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        docs.append((i, " ".join(w), rng.choice(["en", "de"])))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    docs += [(9001, None, "en"), (9002, "", None), (None, "grobnik", "en"), (9003, "ta " * 60_000 + "grobnik vukmar", "xx")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels + [(1, None), (None, 1), labels[3]], "doc_id long, toxic int")
    rows = tx.scored(d, lab).collect()
    assert len(rows) == len(docs)
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right >= 0.9, right
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    got = {r.doc_id: r for r in rows}
    assert got[9001].score == got[9002].score and got[9003].predicted == 1
    assert not got[None].held_out


def test_score_does_not_see_language_or_held_out_labels(spark):
    docs, labels = corpus(120)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    score = lambda dd, ll: {r.doc_id: r.score for r in tx.scored(dd, spark.createDataFrame(ll, "doc_id long, toxic int")).collect()}
    one = score(d, labels)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    other = spark.createDataFrame([(i, t, "zz") for i, t, _ in docs], "doc_id long, text string, lang string")
    assert one == score(other, turned)


def test_no_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in tx.scored(docs, none).collect()}) == 1
    assert tx.scored(empty, none).count() == 0


def test_long_texts_are_scored_in_pieces():
    import numpy as np

    net = tx.Network(np.random.default_rng(1))
    text = " ".join(f"w{i}" for i in range(70_000))
    whole = net.score(net.batch([tx.word_buckets(text)])[0])[0]
    assert abs(tx.score_text(text, net.tables()) - whole) < 1e-5


def test_every_labelled_document_is_learned_from(spark, monkeypatch):
    # more than 2,000 of a label: each toxic word stands in one part of the documents only
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ta", "ri", "on", "es", "ma"]) for _ in range(rng.randint(2, 5)))
    docs = [(i, " ".join([word() for _ in range(8)] + [BAD[i % 3]] * (i % 2)), "en") for i in range(6_000)]
    labels = [(i, i % 2) for i in range(6_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(tx, "GROUP_DOCS", 1_000)
    begun = []
    fitted = tx._fitted

    def spied(dealt, *rest):
        begun.append((dealt.count(), dealt.select("group").distinct().count()))
        return fitted(dealt, *rest)

    monkeypatch.setattr(tx, "_fitted", spied)
    rows = tx.scored(d, lab).collect()
    learned = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2 and zlib.crc32(str(i).encode()) % 16 != 1]
    assert len(learned) > 4_000 and len(begun) >= tx.EPOCHS and set(begun) == {(len(learned), -(-len(learned) // 1_000))}
    held = [r for r in rows if r.held_out]
    ranked = sorted(held, key=lambda r: -r.score)[:sum(r.doc_id % 2 for r in held)]
    assert sum(r.doc_id % 2 for r in ranked) >= 0.95 * len(ranked)


def test_thresholds_come_from_all_rows(spark):
    rows = [("en", 1, 0.9)] * 30 + [("en", 0, 0.5)] * 20 + [("en", 1, 0.4)] * 2 + [("de", 1, 0.3)] * 9 + [("de", 0, 0.1)] * 9 + [(None, 1, 0.2)] * 12
    by, common = tx._thresholds(spark.createDataFrame(rows, "lang string, toxic int, score double"))
    assert {k: round(v, 4) for k, v in by.items()} == {"en": 0.7, None: 0.1} and round(common, 4) == 0.15
    assert tx._thresholds(spark.createDataFrame([("en", 1, 0.9)], "lang string, toxic int, score double")) == ({}, tx.THRESHOLD)
