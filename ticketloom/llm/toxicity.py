"""Toxicity by a convolutional text classifier.

Words (lower case, split at white space and ASCII punctuation) are hashed into two
embedding tables, whole and by their beginning, and the embeddings summed.
Filters of several widths slide over the words of the whole text; each filter's maximum
over the text feeds a logistic output. The network is trained in numpy with Adam on all
labelled training documents, dealt by hash into groups of bounded size. Every group is
trained in a task, from the same network; after each pass the networks are averaged, an
embedding over the groups that have its words, and the next pass begins from the average.
One group alone makes all its passes in its task.

Thresholds are calibrated by language: for each language of the calibration documents
(a part of the training rows held back from the fit) the threshold of best F1, or the
common one where a language has too few toxic documents; scores count by ten-thousandths
there. They give the column ``flagged``; ``predicted`` uses the fixed threshold. Language
is never an input of the score.

Scoring needs the embedding of a word already multiplied by the filters: two table
lookups and sums a word. Tables have a fixed size and travel as a broadcast.

Null and empty texts have no words and get the score of an empty text. Without labels
of both kinds every score is the mean label (0 without any label). Repeated labels of a
document count once, toxic if any says so; rows without doc_id train nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketloom.llm.common import scratch_path, small_side, written

#: Documents and characters of a group that is trained in one task, on average.
GROUP_DOCS = 8_192
GROUP_CHARS = 24_000_000
BUCKETS = 1 << 16
#: Bytes of a word that its second bucket looks at, so inflected words share it.
STEM = 5
DIMENSION = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
#: Steps of the fit of a group at least, for few documents.
MIN_STEPS = 800
BATCH = 32
RATE = 0.01
#: Embeddings move by plain gradient steps, so a word counts by the documents that share it.
EMBEDDING_RATE = 6.0
#: Share of a training document's words left out at each pass.
DROPOUT = 0.6
DECAY = 1e-4
THRESHOLD = 0.3
CALIBRATION_TOXIC = 10
SEED = 7

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_CACHE_WORDS = 400_000


class _Buckets(dict):
    """Word to its two buckets, of the word and of its beginning, as one number."""

    def __missing__(self, word: bytes) -> int:
        import hashlib

        h, stem = (int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in (word, word[:STEM]))
        v = (h % BUCKETS) * BUCKETS + stem % BUCKETS
        if len(self) < _CACHE_WORDS:
            self[word] = v
        return v


_BUCKETS = _Buckets()


def word_buckets(text: str | None) -> np.ndarray:
    """Two buckets for each word of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []
    v = np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words))
    return np.stack((v // BUCKETS, v % BUCKETS + BUCKETS))


def in_training(doc_id: Column) -> Column:
    """Rows whose labels may be learned from."""
    return F.crc32(doc_id.cast("string")) % 4 != 2


class Network:
    """Hashed embeddings, filters of several widths, max pooling, logistic output."""

    def __init__(self, rng: np.random.Generator):
        f = len(WIDTHS) * FILTERS
        self.p = {"e": rng.normal(0, 0.1, (2 * BUCKETS, DIMENSION)).astype(np.float32),
                  "b": np.zeros(f, np.float32), "u": rng.normal(0, 0.3, f).astype(np.float32), "c": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * DIMENSION) ** -0.5, (w, DIMENSION, FILTERS)).astype(np.float32)

    def batch(self, docs: list[np.ndarray]):
        """Pooled activations, and where each maximum stands, for documents behind each other."""
        pad = max(WIDTHS) - 1
        size = np.array([x.shape[1] for x in docs])
        n = size + 2 * pad
        start = np.cumsum(n) - n
        x = np.zeros((int(n.sum()), DIMENSION), np.float32)
        where = np.concatenate([np.arange(s + pad, s + pad + k) for s, k in zip(start, size)])
        h = np.concatenate(docs, axis=1)
        x[where] = self.p["e"][h[0]] + self.p["e"][h[1]]
        pooled, spots = [], []
        for k, w in enumerate(WIDTHS):
            m = len(x) - w + 1
            y = sum(x[j:j + m] @ self.p[f"w{w}"][j] for j in range(w)) + self.p["b"][k * FILTERS:(k + 1) * FILTERS]
            top, at = [], []
            for s, k_ in zip(start, n):
                part = y[s:s + k_ - w + 1]
                i = part.argmax(axis=0)
                at.append(s + i)
                top.append(part[i, np.arange(FILTERS)])
            pooled.append(np.array(top))
            spots.append(np.array(at))
        return np.concatenate(pooled, axis=1), spots, x, where, h

    def score(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.p["u"] + self.p["c"][0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradient(self, docs: list[np.ndarray], label: np.ndarray) -> dict:
        pooled, spots, x, where, h = self.batch(docs)
        d = (self.score(pooled) - label) / len(label)
        on = np.maximum(pooled, 0)
        g = {"u": on.T @ d, "c": np.array([d.sum()], np.float32)}
        dp = (d[:, None] * self.p["u"]) * (pooled > 0)
        g["b"] = dp.sum(axis=0)
        dx = np.zeros_like(x)
        for k, w in enumerate(WIDTHS):
            dk = dp[:, k * FILTERS:(k + 1) * FILTERS]
            gw = np.zeros_like(self.p[f"w{w}"])
            f = np.tile(np.arange(FILTERS), len(dk))
            at, v = spots[k].ravel(), dk.ravel()
            live = v != 0
            at, v, f = at[live], v[live], f[live]
            for j in range(w):
                rows = x[at + j]
                np.add.at(gw[j].T, f, rows * v[:, None])
                np.add.at(dx, at + j, v[:, None] * self.p[f"w{w}"][j].T[f])
            g[f"w{w}"] = gw
        hit = np.flatnonzero(dx[where].any(axis=1))
        rows = np.concatenate((h[0][hit], h[1][hit]))
        value = np.tile(dx[where[hit]], (2, 1))
        used, back = np.unique(rows, return_inverse=True)
        ge = np.zeros((len(used), DIMENSION), np.float32)
        np.add.at(ge, back, value)
        g["e"] = (used, ge)
        return g

    def fit(self, docs: list[np.ndarray], label: np.ndarray, rng: np.random.Generator, passes: int = 1,
            done: int = 0, of: int = 1, moments: dict | None = None) -> dict:
        """So many passes after ``done`` ones ``of`` all; gives Adam's moments for the next pass."""
        dense = {k: v for k, v in self.p.items() if k != "e"}
        held = moments or {n + k: np.zeros_like(v) for n in "ms" for k, v in dense.items()}
        m, s = ({k: held[n + k] for k in dense} for n in "ms")
        each = -(-len(docs) // BATCH)
        step, steps = done * each, of * each
        for _ in range(passes):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), BATCH):
                pick = order[i:i + BATCH]
                some = [docs[k][:, rng.random(docs[k].shape[1]) >= DROPOUT] for k in pick]
                g = self.gradient(some, label[pick])
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                used, ge = g.pop("e")
                self.p["e"][used] -= EMBEDDING_RATE * rate / RATE * ge
                for k, v in g.items():
                    v = v + DECAY * self.p[k] * (k != "c")
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] -= rate * m[k] / (np.sqrt(s[k]) + 1e-7)
        return {n + k: v for n, x in (("m", m), ("s", s)) for k, v in x.items()}

    def tables(self) -> dict:
        """What scoring needs: each bucket's share in every filter and place."""
        return {"t": np.concatenate([self.p["e"] @ self.p[f"w{w}"][j] for w in WIDTHS for j in range(w)], axis=1),
                "b": self.p["b"], "u": self.p["u"], "c": self.p["c"]}


def score_text(text: str | None, t: dict) -> float:
    """The score of a whole text from the tables, in pieces of bounded size."""
    h = word_buckets(text)
    pad, best = max(WIDTHS) - 1, np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
    n = h.shape[1]
    for a in range(0, max(n, 1), 1 << 15):
        part = h[:, max(a - pad, 0):a + (1 << 15)]
        y = np.zeros((part.shape[1] + 2 * pad, t["t"].shape[1]), np.float32)
        y[pad:pad + part.shape[1]] = t["t"][part[0]] + t["t"][part[1]]
        col = 0
        for k, w in enumerate(WIDTHS):
            m = len(y) - w + 1
            v = y[:m, col:col + FILTERS]
            for j in range(1, w):
                v = v + y[j:j + m, col + j * FILTERS:col + (j + 1) * FILTERS]
            col += w * FILTERS
            spot = slice(k * FILTERS, (k + 1) * FILTERS)
            best[spot] = np.maximum(best[spot], v.max(axis=0))
    z = float(np.maximum(best + t["b"], 0) @ t["u"] + t["c"][0])
    return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents with a label that may be learned from."""
    one = labels.where("doc_id is not null and toxic is not null").where(in_training(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    one = small_side(written(one, scratch_path(docs.sparkSession, "labelled")))
    calibrate = F.crc32(F.col("doc_id").cast("string")) % 16 == 1
    return docs.select("doc_id", "text", "lang").join(one, "doc_id").withColumn("calibrate", calibrate)


def _dealt(fit: DataFrame, groups: int) -> DataFrame:
    """Documents group by group, each group whole in one task and in the order of a hash."""
    order = ("group", "order", "doc_id", "text")
    rows = fit.withColumns({"order": F.xxhash64("doc_id"), "group": F.pmod(F.xxhash64("text", "doc_id"), F.lit(groups)).cast("int")})
    return rows.repartition(groups, "group").sortWithinPartitions(*order).select("group", "text", "toxic")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Number, word buckets and labels of each group, from rows in the order of the groups."""
    group, docs, label = None, [], []
    for batch in batches:
        for g, text, toxic in zip(*(batch.column(k) for k in range(3))):
            if g.as_py() != group and docs:
                yield group, docs, np.array(label, np.float32)
                docs, label = [], []
            group = g.as_py()
            docs.append(word_buckets(text.as_py()).astype(np.int32))
            label.append(toxic.as_py())
    if docs:
        yield group, docs, np.array(label, np.float32)


#: Parts of the embedding tables that are averaged apart, and the rows that carry them.
PARTS = 64
CHANGES = "part int, docs long, used binary, value binary"


def _fitted(dealt: DataFrame, net: Network, moments: dict, passes: int, done: int, of: int) -> dict:
    """Moments after so many passes of every group; ``net`` becomes the average of the groups' networks."""
    sent = dealt.sparkSession.sparkContext.broadcast((net.p, moments))
    size = 2 * BUCKETS // PARTS

    def change(part: int, docs: int, used: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs], pa.int64()),
                                           pa.array([used.astype(np.int32).tobytes()]), pa.array([value.tobytes()])], names=["part", "docs", "used", "value"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, begin = sent.value
        for group, docs, label in _groups(batches):
            rng = np.random.default_rng(SEED)
            mine = Network(rng)
            mine.p = {k: v.copy() for k, v in p.items()}
            if passes < of:
                rng = np.random.default_rng((SEED, group, done))
            after = mine.fit(docs, label, rng, passes, done, of, {k: v.copy() for k, v in begin.items()} or None)
            dense = [mine.p[k] for k in sorted(p) if k != "e"] + [after[k] for k in sorted(after)]
            yield change(-1, len(docs), np.zeros(0), np.concatenate([v.ravel() for v in dense]).astype(np.float64) * len(docs))
            move = mine.p["e"] - p["e"]
            for part in range(PARTS):
                used = np.flatnonzero(move[part * size:(part + 1) * size].any(1))
                yield change(part, len(docs), used, move[part * size + used])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, docs, used, value in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if part < 0:
                    x = held.setdefault(part, [0, 0.0])
                    x[0], x[1] = x[0] + docs, x[1] + np.frombuffer(value)
                else:
                    x = held.setdefault(part, [np.zeros(size, np.int64), np.zeros((size, DIMENSION))])
                    at = np.frombuffer(used, np.int32)
                    x[0][at] += 1
                    x[1][at] += np.frombuffer(value, np.float32).reshape(-1, DIMENSION)
        for part, (n, value) in held.items():
            used = np.flatnonzero(n) if part >= 0 else np.zeros(0)
            yield change(part, 0, used, (value[used] / n[used][:, None]).astype(np.float32) if part >= 0 else value / n)

    # in the order of their values: sums do not depend on which group is done first
    got = dealt.mapInArrow(one, CHANGES).repartition("part").sortWithinPartitions("part", "docs", "used", "value").mapInArrow(mean, CHANGES).collect()
    sent.destroy()
    names, out = sorted(k for k in net.p if k != "e"), {}
    for r in got:
        if r["part"] >= 0:
            net.p["e"][r["part"] * size + np.frombuffer(r["used"], np.int32)] += np.frombuffer(r["value"], np.float32).reshape(-1, DIMENSION)
            continue
        flat, at = np.frombuffer(r["value"]).astype(np.float32), 0
        for k in (*names, *(n + k for n in "ms" for k in names)):
            like = net.p[k if k in net.p else k[1:]]
            (net.p if k in net.p else out)[k] = flat[at:at + like.size].reshape(like.shape)
            at += like.size
    return out


def _thresholds(held: DataFrame) -> tuple[dict[str | None, float], float]:
    """Threshold of best F1 by language, and the common one; ``held``: lang, toxic, score."""
    bins = held.groupBy("lang", F.round(F.col("score") * 10_000).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.sum("toxic").alias("hits"))

    def best(rows: DataFrame, *by: str) -> DataFrame:
        whole, down = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc("bin"))
        each = rows.withColumns({
            "toxic": F.sum("hits").over(whole), "all": F.sum("n").over(whole), "below": F.coalesce(F.lead("bin").over(down), F.lit(0)),
            "f1": 2 * F.sum("hits").over(down) / (F.sum("n").over(down) + F.sum("hits").over(whole))})
        first = F.max_by(F.struct("bin", "below"), F.struct("f1", "bin")).alias("at")
        return each.groupBy(*by).agg(first, F.first("toxic").alias("toxic"), F.first("all").alias("n")).select(
            *by, ((F.col("at.bin") + F.col("at.below")) / 20_000.0).alias("threshold"), "toxic", "n")

    every = best(bins.groupBy(F.lit(0).alias("all_"), "bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")), "all_").first()
    if every is None or every["toxic"] in (0, every["n"]):
        return {}, THRESHOLD
    by = {r["lang"]: r["threshold"] for r in best(bins, "lang").where(F.col("toxic") >= CALIBRATION_TOXIC).collect()}
    return by, every["threshold"]


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict, dict[str | None, float], float]:
    """Scoring tables, thresholds by language, and the common threshold, from all labelled training documents."""
    rows = labelled(docs, labels).persist(StorageLevel.DISK_ONLY)
    n, toxic, fit, fit_toxic, chars = rows.agg(
        F.count("*"), F.sum("toxic"), F.count_if(~F.col("calibrate")), F.sum(F.when(~F.col("calibrate"), F.col("toxic"))),
        F.sum(F.when(~F.col("calibrate"), F.length("text")))).first()
    net = Network(np.random.default_rng(SEED))
    if not fit or fit_toxic in (0, fit):
        rate = toxic / n if n else 0.0
        net.p["u"][:] = 0
        net.p["c"][0] = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
        return net.tables(), {}, THRESHOLD
    groups = max(1, -(-fit // GROUP_DOCS), -(-(chars or 0) // GROUP_CHARS))
    dealt = _dealt(rows.where("not calibrate"), groups)
    passes = max(EPOCHS, -(-MIN_STEPS * BATCH * groups // fit))
    if groups == 1:
        _fitted(dealt, net, {}, passes, 0, passes)
    else:
        dealt, moments = dealt.persist(StorageLevel.DISK_ONLY), {}
        for done in range(passes):
            moments = _fitted(dealt, net, moments, 1, done, passes)
        dealt.unpersist()
    tables = net.tables()
    held = _with_score(rows.where("calibrate").select("toxic", "text", "lang"), tables, "toxic")
    by, common = _thresholds(held)
    rows.unpersist()
    return tables, by, common


def _with_score(rows: DataFrame, tables: dict, kept: str) -> DataFrame:
    """(kept, lang, score) of rows (kept, text, lang)."""
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2),
                pa.array([float(score_text(x.as_py(), t)) for x in batch.column(1)], pa.float64())], names=[kept, "lang", "score"])

    rows = rows.select(kept, "text", F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, f"{kept} {rows.schema[kept].dataType.simpleString()}, lang string, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, lang, threshold, flagged."""
    tables, by, common = train(docs, labels)
    out = _with_score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang"), tables, "doc_id")
    threshold = F.lit(common)
    for lang, value in by.items():
        threshold = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(value)).otherwise(threshold)
    return out.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "lang",
                      threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"))
