import random
import re

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import rules as ru

RULES = [("A", 0, "cups", 0), ("A", 0, "CUPS", 1), ("A", 0, "", 2), ("A", 0, None, 3), ("B", 1, "alta", 0), ("B", 1, "zz", 1)]
SCHEMA = "category string, category_order int, keyword string, keyword_order int"


def test_both_forms_give_the_same_rows(spark):
    rules = spark.createDataFrame(RULES, SCHEMA)
    rows = [("T1", "cups alta zz"), ("T1", "cups alta zz"), ("T1", "cups"), (None, "alta"), ("T2", "nada"), ("T3", None)]
    df = spark.createDataFrame(rows, "ticket_id string, processed_text string")
    got = [sorted(map(str, ru.classify_with_rules(df, rules, limit=n).collect())) for n in (2000, 0)]
    assert got[0] == got[1] and len(got[0]) == 4
    assert sum("'B', score=2" in r for r in got[0]) == 2 or sum("predicted_type='B', score=2" in r for r in got[0]) == 2
    none = rules.limit(0)
    assert ru.classify_with_rules(df, none, limit=0).count() == 0 == ru.classify_with_rules(df, none).count()


@pytest.mark.parametrize("match", ["substring", "word"])
def test_three_ways_and_a_plain_loop(spark, match):
    """Literals, one tree and several parts of a table give what a loop over all phrases gives."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abñ_1-. ") for _ in range(rng.randint(1, 4))).strip() or "a"
    rules = [(f"c{k % 7}", k % 7, word(), rng.randrange(4)) for k in range(120)]
    texts = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(150)]
    df = spark.createDataFrame([(f"T{i}", t) for i, t in enumerate(texts)], "ticket_id string, processed_text string")
    table = spark.createDataFrame(rules, SCHEMA)
    first = {}
    for c, o, w, k in rules:
        first[c, o, w] = min(k, first.get((c, o, w), k))
    want = {}
    for i, t in enumerate(texts):
        inside = lambda w: w in t if match == "substring" else re.search(rf"(?<!\w){re.escape(w)}(?!\w)", t)
        hits = {}
        for (c, o, w), k in first.items():
            if inside(w):
                hits.setdefault((o, c), []).append((k, w))
        if hits:
            (o, c), ws = min(hits.items(), key=lambda x: (-len(x[1]), x[0]))
            want[f"T{i}"] = (c, len(ws), ", ".join(w for _, w in sorted(ws)[:2]))
    for options in ({}, {"limit": 0}, {"limit": 0, "rule_bytes": 1500}):
        got = {r.ticket_id: (r.predicted_type, r.score, r.rule_matched)
               for r in ru.classify_with_rules(df, table, match=match, **options).collect()}
        if options:
            assert got == want
        else:  # equal keyword places: the literals keep the table's order within a place
            assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}


def test_category_texts(spark):
    df = spark.createDataFrame([("T1", "cups"), ("T2", "alta"), ("T3", "nada")], "ticket_id string, processed_text string")
    info = spark.createDataFrame([("A", "Gestión", None, "Alta"), ("A", "Otra", "x", "Baja")],
                                 "category string, nombre string, descripcion string, nivel_criticidad string")
    for limit in (2000, 0):
        got = {r.ticket_id: (r.nombre, r.descripcion, r.nivel_criticidad)
               for r in ru.classify_with_rules(df, spark.createDataFrame(RULES, SCHEMA), limit=limit, info=info).collect()}
        assert got == {"T1": ("Gestión", "A", "Alta"), "T2": ("B", "B", None)}


def test_three_hundred_thousand_phrases(spark):
    """No row is exploded and no text joined, whatever the size of the table."""
    rules = spark.range(300_000).select(
        F.concat(F.lit("c"), (F.col("id") % 50).cast("string")).alias("category"), (F.col("id") % 50).cast("int").alias("category_order"),
        F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("x")).alias("keyword"), F.lit(0).alias("keyword_order"))
    df = spark.range(2000).select(
        F.col("id").cast("string").alias("ticket_id"),
        F.concat(F.lit("a p"), (F.col("id") * 149).cast("string"), F.lit("x b p"), (F.col("id") * 149 + 50).cast("string"), F.lit("x")).alias("processed_text"))
    done = ru.classify_with_rules(df, rules)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Exchange" not in plan
    got = {int(r.ticket_id): (r.predicted_type, r.score) for r in done.collect()}
    assert got == {i: (f"c{i * 149 % 50}", 2 if i * 149 + 50 < 300_000 else 1) for i in range(2000)}


def test_a_category_with_two_routes_keeps_one_row(spark):
    done = spark.createDataFrame([("T1", "A", "Alta", 0.8)], "ticket_id string, predicted_type string, nivel_criticidad string, confidence double")
    routes = spark.createDataFrame([("A", "g2"), ("A", "g1")], "category string, grupo string")
    assert [r.suggested_group for r in ru.triage(done, routes).collect()] == ["g1"]


def test_readings_do_not_grow_with_the_words(spark, monkeypatch):
    """Phrases of one word take one reading, whatever their bytes; only the others are searched part by part."""
    from ticketloom.operators import rule_search as rs

    searched = []
    body = rs._searched
    monkeypatch.setattr(rs, "_searched", lambda df, part, *rest: searched.append(len(part)) or body(df, part, *rest))
    rules = [(f"c{i % 3}", i % 3, f"palabra{i}", 0) for i in range(400)] + [("d", 9, "dos palabras", 0), ("d", 9, "x-1", 0)]
    df = spark.createDataFrame([("T1", "palabra1 palabra4 palabra2"), ("T2", "apalabra1, dos palabras x-1"), ("T3", None)],
                               "ticket_id string, processed_text string")
    done = ru.classify_with_rules(df, spark.createDataFrame(rules, SCHEMA), limit=0, match="word", rule_bytes=2000)
    assert sorted(tuple(r)[:3] for r in done.collect()) == [("T1", "c1", 2), ("T2", "d", 2)]
    assert searched == [2]
