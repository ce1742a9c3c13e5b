"""The merge against a plain loop that scores every pair."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import Row

from ticketloom.operators import merge as mg

NAMES = mg.FIELDS


def random_rows(n, seed, words=40, causes=7, urgency=6):
    rng = random.Random(seed)
    pick = lambda kind, most, size: [f"{kind}{k}" for k in rng.sample(range(most), min(most, rng.randint(0, size)))]
    ids = rng.sample(range(10 * n), n)
    return [Row(**dict(zip(NAMES, (i, pick("w", words, 8), pick("c", causes, 3), rng.randint(1, 90), rng.random() * 100,
                                  rng.random() < 0.5, rng.randrange(urgency))))) for i in ids]


def overlap(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0.0


def score(x, y):
    features = 0.5 * (x[5] == y[5]) + 0.5 * (abs(x[6] - y[6]) <= 1)
    return 0.4 * overlap(x[1], y[1]) + 0.4 * overlap(x[2], y[2]) + 0.2 * features


def joined(x, y):
    common = lambda k, n: [v for v, _ in Counter(list(x[k]) + list(y[k])).most_common(n)]
    return (x[0], common(1, 8), common(2, 3), x[3] + y[3], (x[4] + y[4]) / 2, x[5] or y[5], x[6] + y[6])


def plain_merge(rows, most, least):
    now = {r[0]: tuple(r) for r in rows}
    target = {c: c for c in now}
    pairs = {(a, b): score(now[a], now[b]) for a in now for b in now if a < b}
    while len(now) > most and pairs:
        best = max(pairs.values())
        if best <= least:
            break
        keep, drop = min(p for p, x in pairs.items() if x == best)
        now[keep] = joined(now[keep], now.pop(drop))
        target = {old: keep if new == drop else new for old, new in target.items()}
        pairs = {p: x for p, x in pairs.items() if drop not in p}
        for c in now:
            if c != keep:
                a, b = min(c, keep), max(c, keep)
                pairs[a, b] = score(now[a], now[b])
    return target, now


@pytest.mark.parametrize("n, most, least, kinds", [
    (60, 20, 0.1, {}), (60, 1, 0.1, {}), (60, 1, -1.0, {}), (60, 5, 0.1, {"words": 400, "causes": 90, "urgency": 200}),
    (60, 5, 0.05, {"words": 4000, "causes": 900, "urgency": 9000}), (60, 3, 0.3, {"words": 9, "causes": 2, "urgency": 2}),
    (140, 20, 0.1, {}), (2, 1, -1.0, {}), (1, 1, 0.1, {}), (0, 20, 0.1, {})])
def test_same_as_a_plain_loop(n, most, least, kinds):
    for seed in range(4):
        rows = random_rows(n, seed, **kinds)
        target, now = plain_merge(rows, most, least)
        table = mg.Summaries(rows)
        parent = mg.greedy_merge(table, most, least)
        assert {table.clusters[i]: table.clusters[p] for i, p in enumerate(parent)} == target
        for i, p in enumerate(parent):
            if p == i:
                mine = (table.clusters[i], list(table.words[i]), list(table.causes[i]), table.tickets[i], table.length[i],
                        bool(table.technical[i]), int(table.urgency[i]))
                assert mine == tuple(list(x) if isinstance(x, tuple) else x for x in now[table.clusters[i]])


def test_four_hundred_categories():
    rows = random_rows(400, 9, words=120)
    target, _ = plain_merge(rows, 20, 0.1)
    table = mg.Summaries(rows)
    parent = mg.greedy_merge(table, 20, 0.1)
    assert {table.clusters[i]: table.clusters[p] for i, p in enumerate(parent)} == target


def test_thousands_of_categories():
    table = mg.Summaries(random_rows(2000, 1, words=2000, causes=40))
    start = time.process_time()
    parent = mg.greedy_merge(table, 20, 0.1)
    assert time.process_time() - start < 60
    table.scores(0)
    rest = sorted(set(parent))
    assert len(rest) == 20 or max(table.scores(i)[j] for i in rest for j in rest if i < j) <= 0.1
    assert sum(table.tickets[p] for p in set(parent)) >= 2000


def test_pairs_of_the_table(spark):
    rows = random_rows(30, 5) + [Row(**dict(zip(NAMES, (1000, None, [], 1, 1.0, True, 0))))]
    schema = "cluster int, top_words array<string>, top_causes array<string>, num_incidencias long, avg_text_length double, has_technical_terms boolean, urgency_indicators long"
    got = {(r.a, r.b): r.similarity for r in mg.category_similarity(spark.createDataFrame(rows, schema)).collect()}
    by = sorted(((r[0], r[1] or [], *r[2:]) for r in rows), key=lambda r: r[0])
    assert got == {(x[0], y[0]): score(x, y) for i, x in enumerate(by) for y in by[i + 1:]}
