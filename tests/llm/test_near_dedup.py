from collections import defaultdict

from ticketloom.llm import near_dedup as nd


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def brute(rows, k):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t, k)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_classes_equal_brute_force(docs):
    for k in (2, 5):
        want = brute([(r.doc_id, r.text) for r in docs.collect()], k)
        got = nd.classes(docs, k, 0.8).collect()
        assert len(got) == docs.count()
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_large_group(spark, monkeypatch):
    """A group far larger than a node: one class, however the trees cut it."""
    import random

    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(150)] = f"z{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(nd, "SMALL_NODE", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2)
    assert {r.doc_id: r.component_id for r in nd.classes(df, 2, 0.8).collect()} == {i: c for i, (_, c) in want.items()}


def test_star_family(spark):
    """Copies alike to their original only: each is found through it, far beyond a block."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 3000):
        w = list(base)
        for at in rng.sample(range(0, 300, 3), 15):
            w[at] = f"z{rng.randrange(10 ** 9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sets = [shingles(t, 2) for _, t in rows]
    assert all(100 * len(sets[0] & s) >= 80 * len(sets[0] | s) for s in sets)
    assert sum(100 * len(x & y) >= 80 * len(x | y) for x, y in zip(sets[1::2], sets[2::2])) < 20
    assert {r.component_id for r in nd.classes(df, 2, 0.8).collect()} == {0}


def test_template_family(spark):
    """Pages of one template, below the threshold, with near copies among them."""
    import random

    rng = random.Random(4)
    base = [f"w{i}" for i in range(240)]
    rows = []
    for i in range(1200):
        rows.append((i, base + [f"p{i}x{j}" for j in range(36)]))
    for i in range(0, 1200, 12):
        w = list(rows[i][1])
        for _ in range(8):
            w[rng.randrange(240)] = f"z{rng.randrange(10 ** 9)}"
        rows.append((2000 + i, w))
    rows = [(i, " ".join(w)) for i, w in rows]
    want = brute(rows, 2)
    assert len({c for _, c in want.values()}) == 1200
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 2, 0.8)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: c for i, (_, c) in want.items()}


def test_columns_and_empty(odd, empty):
    out = nd.deduplicated(odd)
    assert out.columns == odd.columns
    kept = defaultdict(int)
    for r in out.select("doc_id").collect():
        kept[r.doc_id] += 1
    assert kept[0] and not kept[37] and kept[30] and kept[None] == 2
    assert nd.deduplicated(empty).count() == 0
