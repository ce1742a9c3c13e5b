import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ticketloom.operators import clustering as cl, evaluation as ev, features as ft
from ticketloom.operators import merge as mg, monitor as mo, profiles as pr, ranking as rk
from ticketloom.operators import summary as sm
from ticketloom.sources import tickets as src


# -- ranking and splits --------------------------------------------------------------

def test_spread_rank_is_exact_for_a_hot_group(spark):
    df = spark.range(20000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("g"))
    ranked = rk.spread_rank(df, "g", "k").withColumn("h", rk.hash_order("k"))
    rows = ranked.select("g", "k", "h", "rank").toPandas()
    for _, part in rows.groupby("g"):
        part = part.sort_values(["h", "k"])
        assert part["rank"].tolist() == list(range(1, len(part) + 1))


def test_stratified_split_totals(spark, tickets):
    split = ev.stratified_split(tickets.select("ticket_id", "cluster"), "cluster")
    assert split.count() == tickets.count()
    assert split.where("is_test").count() == -(-tickets.count() // 5)


def test_holdout_is_exact_and_disjoint(spark, tickets):
    train, test = ev.holdout(tickets.select("ticket_id"), 30)
    assert test.count() == 30 and train.count() == tickets.count() - 30
    assert train.join(test, "ticket_id").count() == 0


# -- features ---------------------------------------------------------------------------

def brute_tfidf(docs, min_df, max_df, most):
    import math
    from collections import Counter

    terms = [[*d, *[f"{a} {b}" for a, b in zip(d, d[1:])]] for d in docs]
    n = len(docs)
    df, cf = Counter(), Counter()
    for t in terms:
        cf.update(t)
        df.update(set(t))
    keep = sorted((t for t in cf if min_df <= df[t] <= max_df * n), key=lambda t: (-cf[t], t))[:most]
    out = []
    for t in terms:
        w = {k: c * (math.log((1 + n) / (1 + df[k])) + 1) for k, c in Counter(t).items() if k in keep}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({k: x / norm for k, x in w.items()})
    return sorted(keep), out


def test_tf_idf_forms_agree_with_brute_force(spark):
    texts = ["aa bb aa cc", "bb cc dd", "aa bb", "dd dd ee bb", "ff aa bb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, t string")
    terms = ft.with_terms(df, "t")
    vocabulary = ft.fit_vocabulary(terms, "terms", 6, 2, 0.9)
    keep, want = brute_tfidf([t.split() for t in texts], 2, 0.9, 6)
    assert sorted(r["term"] for r in vocabulary.collect()) == keep
    got = [{} for _ in texts]
    for r in ft.tf_idf(terms, vocabulary, "doc").collect():
        got[r["doc"]][r["term"]] = r["weight"]
    model = ft.vectorizer(vocabulary)
    assert ft.vocabulary_of(model) == keep
    vectors = model.transform(terms).select("doc", vector_to_array("features").alias("v")).collect()
    for doc, w in enumerate(want):
        assert got[doc] == pytest.approx(w, abs=1e-9)
        v = next(r["v"] for r in vectors if r["doc"] == doc)
        assert dict((t, x) for t, x in zip(keep, v) if x) == pytest.approx(w, abs=1e-9)


def test_new_text_drops_unknown_terms(spark):
    base = ft.with_terms(spark.createDataFrame([(0, "aa bb"), (1, "aa cc")], "doc int, t string"), "t")
    vocabulary = ft.fit_vocabulary(base, "terms", 10, 1, 1.0)
    new = ft.with_terms(spark.createDataFrame([(9, "aa zz")], "doc int, t string"), "t")
    assert [r["term"] for r in ft.tf_idf(new, vocabulary, "doc").collect()] == ["aa"]


# -- clusters ---------------------------------------------------------------------------

@pytest.mark.parametrize("n,k", [(3843, 25), (1001, 15), (1000, 10), (39, 2)])
def test_choose_k(n, k):
    assert cl.choose_k(n) == k


def test_initial_k():
    assert (cl.initial_k(3843), cl.initial_k(100), cl.initial_k(5)) == (30, 5, 2)


def vectors(spark, rng, n=60, d=5, k=3):
    rows = [(i, [float(x) for x in rng.normal(i % k * 2, 1, d)], i % k) for i in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")


def test_silhouette_equals_all_pairs(spark):
    rows, df = vectors(spark, np.random.default_rng(1))
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    got = {r["vec_id"]: r["silhouette"] for r in cl.silhouette_rows(df).collect()}
    for i in range(len(rows)):
        a = d[i][(y == y[i])].sum() / ((y == y[i]).sum() - 1)
        b = min(d[i][y == c].mean() for c in set(y) - {y[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_nearest_centroid(spark):
    rows, df = vectors(spark, np.random.default_rng(2))
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    means = np.array([x[y == c].mean(0) for c in range(3)])
    want = ((x[:, None] - means[None]) ** 2).sum(-1).argmin(1)
    out = cl.assign_nearest(df, cl.centroids(df)).collect()
    assert all(r["nearest"] == want[r["vec_id"]] for r in out)


def test_kmeans_finds_planted_phrases(spark):
    """Repeats of one planted phrase end in one cluster, and a restart repeats the result."""
    texts = [(i * 100 + j, p.split("{")[0]) for i, p in enumerate(src.PHRASES) for j in range(8)]
    df = spark.createDataFrame(texts, "ticket_id int, t string")
    terms = ft.with_terms(df, "t")
    feats = ft.vectorizer(ft.fit_vocabulary(terms, "terms", 500, 3, 0.7)).transform(terms)
    feats = feats.select("ticket_id", "features").cache()
    model = cl.fit_kmeans(feats, 24, restarts=3, max_iter=50)
    pred = model.transform(feats).select((F.col("ticket_id") / 100).cast("int").alias("p"), "prediction", "ticket_id")
    assert pred.groupBy("p").agg(F.countDistinct("prediction").alias("c")).agg(F.max("c")).first()[0] == 1
    assert pred.select("prediction").distinct().count() >= 16
    again = cl.fit_kmeans(feats, 24, restarts=3, max_iter=50).transform(feats)
    same = pred.join(again.select("ticket_id", F.col("prediction").alias("q")), "ticket_id")
    assert same.where("prediction <> q").count() == 0


# -- profiles -----------------------------------------------------------------------------

def cluster_of(spark, texts):
    df = spark.createDataFrame([(f"T{i}", t) for i, t in enumerate(texts)], "ticket_id string, resumen string")
    return df.select(F.lit(0).alias("cluster"), "*", *[
        F.lit(None).cast("string").alias(c) for c in ("notas", "causa_raiz", "tipo_ticket", "resolucion", "prioridad")])


@pytest.mark.parametrize("texts,level", [
    (["urgente"], "Alta"), (["error"], "Media"), (["consulta"], "Baja"), (["nada"], "Baja")])
def test_criticality(spark, texts, level):
    row = pr.criticality(pr.cluster_signals(cluster_of(spark, texts))).first()
    assert row["nivel_criticidad"] == level


@pytest.mark.parametrize("n,text", [(101, "Frecuentes"), (100, None), (10, None), (9, "Específicas")])
def test_size_modifier(spark, n, text):
    assert spark.range(1).select(pr.size_modifier(F.lit(n)).alias("x")).first()["x"] == text


@pytest.mark.parametrize("n,text", [(101, "Alta Frecuencia"), (51, "Frecuencia Media"), (50, None), (9, "Casos Específicos")])
def test_size_spec(spark, n, text):
    assert spark.range(1).select(pr.size_spec(F.lit(n)).alias("x")).first()["x"] == text


@pytest.mark.parametrize("n,level", [(6, "Alta"), (5, "Media"), (3, "Media"), (2, "Baja")])
def test_urgency_level(spark, n, level):
    assert spark.range(1).select(pr.urgency_level(F.lit(n)).alias("x")).first()["x"] == level


def test_profile_without_any_pattern(spark):
    row = pr.profile_clusters(cluster_of(spark, ["zorro verde", "zorro azul"])).first()
    assert row["nombre"] == "Zorro Azul Específicas"
    assert row["descripcion"].endswith("con características técnicas y funcionales específicas.")
    assert row["tipos_principales"] == [] and len(row["ejemplos"]) == 2


def test_profile_keeps_clusters_of_equal_name(spark, tickets):
    cats = pr.profile_clusters(tickets)
    assert cats.agg(F.sum("num_incidencias")).first()[0] == tickets.count()
    assert cats.count() == tickets.select("cluster").distinct().count()


# -- merge ----------------------------------------------------------------------------------

CATEGORY = ("cluster int, top_words array<string>, top_causes array<string>, num_incidencias long, "
            "avg_text_length double, has_technical_terms boolean, urgency_indicators long")


def test_similarity_same_words_no_causes(spark):
    df = spark.createDataFrame([(0, ["a", "b"], [], 1, 1.0, True, 0), (1, ["b", "a"], [], 1, 1.0, True, 1)], CATEGORY)
    assert mg.category_similarity(df).first()["similarity"] == pytest.approx(0.6)


def test_merge_stops_at_threshold_and_keeps_order(spark):
    rows = [(0, ["a"], ["x"], 5, 10.0, True, 0), (1, ["b"], [], 4, 20.0, False, 9),
            (2, ["c", "a"], ["x"], 3, 30.0, True, 1), (3, ["q"], [], 2, 40.0, True, 50)]
    mapping, merged = mg.merge_categories(spark.createDataFrame(rows, CATEGORY), 1)
    assert {r["old"]: r["new"] for r in mapping.collect()} == {0: 0, 1: 1, 2: 0, 3: 3}
    first = merged.where("cluster = 0").first()
    assert (first["top_words"], first["top_causes"]) == (["a", "c"], ["x"])
    assert (first["num_incidencias"], first["avg_text_length"], first["urgency_indicators"]) == (8, 20.0, 1)


def test_merge_profile_averages_centres(spark):
    df = spark.createDataFrame(
        [(0, ["a"], ["x"], 5, 10.0, True, 0, [1.0, 3.0]), (1, ["b"], [], 4, 20.0, False, 9, [3.0, 5.0])],
        CATEGORY + ", center array<double>")
    mapping = spark.createDataFrame([(0, 0), (1, 0)], "old int, new int")
    row = mg.merge_profile(df, mapping, dims=True).first()
    assert row["center"] == [2.0, 4.0] and row["top_words"] == ["a", "b"]


# -- summaries and monitoring -----------------------------------------------------------------

@pytest.mark.parametrize("c,band", [(0.81, "alta_confianza"), (0.8, "media_confianza"),
                                    (0.5, "media_confianza"), (0.49, "baja_confianza")])
def test_bands(spark, c, band):
    assert spark.range(1).select(sm.confidence_band(F.lit(c)).alias("x")).first()["x"] == band


def test_size_bands_show_zero(spark):
    cats = spark.createDataFrame([(60,), (70,)], "num_incidencias long")
    assert [tuple(r) for r in sm.by_size_band(cats).collect()] == [
        ("Pequeñas (<20)", 0), ("Medianas (20-50)", 0), ("Grandes (>50)", 2)]


def test_retrain_needs_consecutive_weeks(spark):
    rows = [("2024-01-01", 0.80), ("2024-01-08", 0.90), ("2024-01-15", 0.86), ("2024-01-22", 0.85), ("2024-02-05", 0.80)]
    weekly = spark.createDataFrame(rows, "week string, accuracy double").withColumn("week", F.col("week").cast("date"))
    due = [str(r["week"]) for r in mo.retrain_trigger(weekly).where("retrain").collect()]
    assert due == ["2024-01-22"]


# -- sources ------------------------------------------------------------------------------------

def test_csv_headings_and_encoding(spark, tmp_path):
    text = 'Ticket ID;Resumen;Notas;Tipo de ticket;Causa Raíz;Resolución;Prioridad\nT1;"Año; ""x""";;PETICION;Facturación;;Alta\n'
    (tmp_path / "t.csv").write_bytes(text.encode("iso-8859-1"))
    r = src.read_tickets_csv(spark, str(tmp_path / "t.csv")).first()
    assert (r["ticket_id"], r["resumen"], r["notas"], r["causa_raiz"]) == ("T1", 'Año; "x"', None, "Facturación")


def test_required_columns_and_rows(spark, tickets):
    with pytest.raises(ValueError):
        src.require_columns(tickets.select("ticket_id"))
    with pytest.raises(ValueError):
        src.require_rows(tickets, 100, 500)
