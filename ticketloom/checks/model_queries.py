"""Checked queries: features, clusters, evaluation, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.checks import sql as s
from ticketloom.checks.registry import query
from ticketloom.checks.text_queries import PROCESSED_CTE, sql_word_tokens
from ticketloom.functions import text as tx
from ticketloom.operators import clustering as cl, evaluation as ev, features as ft
from ticketloom.operators import kmeans as km, model as md
from ticketloom.sources.tickets import load_tickets

K = "ticket_id"


# -- features --------------------------------------------------------------------

def _vocab_ctes(min_df: int, max_df: float, most: int) -> tuple[str, ...]:
    return (
        PROCESSED_CTE,
        f"toks as (select ticket_id, doc_id, {sql_word_tokens('processed_text')} as t from processed)",
        "terms as (select ticket_id, doc_id, unnest(list_concat(t, list_transform("
        "range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) as term from toks)",
        "tf as (select ticket_id, doc_id, term, count(*) as tf from terms group by all)",
        "n as (select count(*) as n from tickets)",
        "vocab as (select term, count(*) as df, cast(sum(tf) as bigint) as cf, "
        "ln((1 + (select n from n)) / cast(1 + count(*) as double)) + 1 as idf from tf group by term "
        f"having count(*) >= {min_df} and count(*) <= cast({max_df} as double) * (select n from n) "
        f"order by cf desc, term limit {most})",
    )


VOCAB_C = _vocab_ctes(3, 0.7, 8000)
VOCAB_S = _vocab_ctes(2, 0.8, 3000)
WEIGHTS = ("w as (select ticket_id, term, tf, tf * idf as x from tf join vocab using (term))",
           "weights as (select ticket_id, term, tf, x / sqrt(sum(x * x) over "
           "(partition by ticket_id)) as weight from w)")


def terms_of(spark, sf):
    t = load_tickets(spark, sf).select(
        K, "doc_id", "cluster", tx.preprocess(tx.combined_text()).alias("processed_text"))
    return ft.with_terms(t, "processed_text").drop("processed_text")


@query("g1_vocabulary", s.with_tickets("select term, df, cf from vocab", *VOCAB_C))
def g1(spark, sf):
    return ft.fit_vocabulary(terms_of(spark, sf), "terms", 8000, 3, 0.7, pairs=True).select("term", "df", "cf")


@query("g1_vocabulary_analyzer", s.with_tickets("select term, df, cf from vocab", *VOCAB_S))
def g1s(spark, sf):
    return ft.fit_vocabulary(terms_of(spark, sf), "terms", 3000, 2, 0.8, pairs=True).select("term", "df", "cf")


@query("g2_term_counts", s.with_tickets(
    "select ticket_id, term, tf from tf join vocab using (term)", *VOCAB_C))
def g2(spark, sf):
    t = terms_of(spark, sf)
    return ft.term_counts(t, ft.fit_vocabulary(t, pairs=True), K).select(K, "term", "tf")


@query("g3_smooth_idf", s.with_tickets("select term, round(idf, 6) as idf from vocab", *VOCAB_C))
def g3(spark, sf):
    return ft.fit_vocabulary(terms_of(spark, sf), pairs=True).select("term", F.round("idf", 6).alias("idf"))


@query("g4_tf_idf", s.with_tickets(
    "select ticket_id, term, tf, round(weight, 6) as weight from weights", *VOCAB_C, *WEIGHTS))
def g4(spark, sf):
    t = terms_of(spark, sf)
    return ft.tf_idf(t, ft.fit_vocabulary(t, pairs=True), K).withColumn("weight", F.round("weight", 6))


_TRAIN_CTES = tuple(
    c.replace("vocab as (select term, count(*)", "train as (select * from tf where doc_id % 5 <> 0),\n"
              "vocab as (select term, count(*)").replace("idf from tf group", "idf from train group")
    .replace("n as (select count(*) as n from tickets)",
             "n as (select count(*) as n from tickets where doc_id % 5 <> 0)")
    for c in VOCAB_C)


@query("g5_transform_new", s.with_tickets(
    "select ticket_id, term, tf, round(weight, 6) as weight from weights",
    *_TRAIN_CTES, *WEIGHTS))
def g5(spark, sf):
    """Vocabulary from four fifths of the tickets, applied to all of them."""
    t = terms_of(spark, sf)
    vocabulary = ft.fit_vocabulary(t.where("doc_id % 5 <> 0"), pairs=True)
    return ft.tf_idf(t, vocabulary, K).withColumn("weight", F.round("weight", 6))


@query("g4_feature_norms", s.with_tickets(
    "select ticket_id, count(*) as terms, 1.0::double as norm from weights group by ticket_id",
    *VOCAB_C, *WEIGHTS))
def g4_vectors(spark, sf):
    """Vector form: as many terms as the long table, length one."""
    t = terms_of(spark, sf)
    vec = ft.vectorizer(ft.fit_vocabulary(t, pairs=True)).transform(t)
    # the vectors are sparse: their entries, not all places of the vocabulary
    w = vec.select(K, F.unwrap_udt("features")["values"].alias("v"))
    return w.select(
        K,
        F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("terms"),
        F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"),
    ).where("terms > 0")


# -- clusters ---------------------------------------------------------------------

def embeddings(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")


def features(spark, sf, vocabulary_size=8000):
    """Feature table of the tickets, cached for the iterative part."""
    t = terms_of(spark, sf)
    model = ft.vectorizer(ft.fit_vocabulary(t, max_features=vocabulary_size, pairs=True), vocabulary_size)
    return model.transform(t).select(K, "cluster", "features").cache()


_KSQL = ("select count(*) as n, case when least(50, count(*) // 20) < 2 then 2 else "
         "least(case when count(*) > 3000 then 25 when count(*) > 1000 then 15 else 10 end, "
         "least(50, count(*) // 20)) end as k, greatest(2, least(30, count(*) // 20)) as k0 "
         "from documents")


@query("h1_kmeans", s.with_tickets(
    f"select ticket_id, k, n as total, true as in_range, true as nearest from tickets, ({_KSQL})"))
def h1(spark, sf):
    """The production setting: every ticket has a cluster, sizes sum to all, no centre is nearer."""
    f = features(spark, sf)
    k = cl.choose_k(f.count())
    model = cl.fit_kmeans(f, k)
    pred = model.transform(f)
    total = cl.cluster_sizes(pred).agg(F.sum("size").alias("n")).scalar()
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "c int, v array<double>")
    flat = centres.select("c", F.posexplode("v").alias("i", "y")).where("y <> 0")
    x = F.unwrap_udt("features")
    entries = pred.select(K, F.inline(F.arrays_zip(x["indices"].alias("i"), x["values"].alias("x"))))
    # a column for each centre: an entry meets them all in one row
    each = range(len(model.clusterCenters()))
    wide = flat.groupBy("i").agg(*(F.sum(F.when(F.col("c") == c, F.col("y"))).alias(f"y{c}") for c in each))
    dots = entries.join(F.broadcast(wide), "i").groupBy(K).agg(*(F.sum(F.col("x") * F.col(f"y{c}")).alias(f"xy{c}") for c in each))
    norms = [float((c * c).sum()) for c in model.clusterCenters()]
    far = dots.select(K, F.array(*(norms[c] - 2 * F.col(f"xy{c}") for c in each)).alias("d"))
    least = pred.select(K, "prediction").join(far, K).groupBy(K).agg(
        F.min(F.array_min("d")).alias("least"), F.min(F.get("d", F.col("prediction"))).alias("own"))
    return pred.select(K, "prediction").join(least, K, "left").select(
        K, F.lit(k).cast("long").alias("k"), total.alias("total"), F.col("prediction").between(0, k - 1).alias("in_range"),
        F.coalesce(F.col("own") <= F.col("least") + 1e-9, F.lit(True)).alias("nearest"))


@query("h2_kmeans_restarts", (
    f"select seed, k, n, true as rests, true as at_means, true as in_readings, true as best_is_least from ({_KSQL}), "
    "(select unnest(range(42, 52)) as seed)"))
def h2(spark, sf):
    """Ten starts in shared readings: each comes to rest with its centres at the means of its tickets."""
    f = features(spark, sf)
    k = cl.choose_k(f.count())
    rows, starts, readings = km.fit(f, [k], range(42, 52))
    best = cl.fit_kmeans(f, k)

    def at_means(start):
        filled = start.sizes > 0
        means = start.totals[filled] / start.sizes[filled, None]
        return bool(abs(means - start.centres[filled]).max() < 1e-3)

    return spark.createDataFrame([
        (s_.seed, s_.k, int(s_.sizes.sum()), bool(s_.settled), at_means(s_), readings <= 301, bool(best.cost <= s_.cost + 1e-6))
        for s_ in starts], "seed long, k long, n long, rests boolean, at_means boolean, in_readings boolean, best_is_least boolean")


@query("h3_sweep_k", (
    f"select unnest(range(2, least(least(50, n // 20) + 1, 30))) as k, true as costs_less_than_one_cluster, "
    f"true as silhouette_in_range from ({_KSQL})"))
def h3(spark, sf):
    """Every k of the range, ten starts each, in shared readings."""
    f = features(spark, sf)
    one = km.fit(f, [1], [42])[1][0].cost
    table = cl.sweep_k(f, cl.sweep_range(f.count()))
    return table.select(
        F.col("k").cast("long").alias("k"), ((F.col("inertia") > 0) & (F.col("inertia") <= one)).alias("costs_less_than_one_cluster"),
        F.col("silhouette").between(-1, 1).alias("silhouette_in_range"))


@query("h4_choose_k", _KSQL)
def h4(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    return spark.createDataFrame([(n, cl.choose_k(n), cl.initial_k(n))], "n long, k long, k0 long")


@query("h5_initial_k", _KSQL.replace(" case when least", " 0 as z, case when least", 1))
def h5(spark, sf):
    return h4(spark, sf).withColumn("z", F.lit(0))


_PAIRS = """
with e as (select vec_id, embedding, label from embeddings),
d as (select a.vec_id, a.label, b.label as other, avg(list_sum(list_transform(
    range(1, len(a.embedding) + 1), lambda i: (cast(a.embedding[i] as double)
    - cast(b.embedding[i] as double)) ^ 2))) as d
  from e a join e b on a.vec_id <> b.vec_id group by all),
s as (select vec_id, label, max(d) filter (label = other) as a, min(d) filter (label <> other) as b
  from d group by all)
select vec_id, round(case when a is null then 0 else (b - a) / greatest(a, b) end, 6) as silhouette
from s"""


@query("h6_silhouette", _PAIRS)
def h6(spark, sf):
    return cl.silhouette_rows(embeddings(spark, sf)).select(
        "vec_id", F.round("silhouette", 6).alias("silhouette"))


@query("h6_silhouette_euclidean", """
with d as (select a.vec_id, a.label, b.label as other, sum(sqrt(list_sum(list_transform(
    range(1, len(a.embedding) + 1), lambda i: (cast(a.embedding[i] as double)
    - cast(b.embedding[i] as double)) ^ 2)))) as s, count(*) as n
  from embeddings a join embeddings b on a.vec_id % 50 = 0 group by all),
s as (select vec_id, label, max(n) filter (label = other) as n,
  max(s / greatest(n - 1, 1)) filter (label = other) as a, min(s / n) filter (label <> other) as b
  from d group by all)
select vec_id, label, round(case when n = 1 then 0 else (b - a) / greatest(a, b) end, 6) as silhouette from s""")
def h6_euclidean(spark, sf):
    """Every row whose id is divisible by 50 against all rows."""
    return cl.silhouette_euclidean(embeddings(spark, sf), F.col("vec_id") % 50 == 0).withColumn(
        "silhouette", F.round("silhouette", 6))


@query("h7_cluster_sizes", s.with_tickets(
    "select cluster, count(*) as size, (select max(c) from (select count(*) as c from tickets "
    "group by cluster)) as largest from tickets group by cluster"))
def h7(spark, sf):
    t = load_tickets(spark, sf)
    largest = cl.size_summary(t, "cluster").select("largest_cluster_size").scalar()
    return cl.cluster_sizes(t, "cluster").withColumn("largest", largest)


CENTS = ("cents as (select label, pos, avg(cast(x as double)) as value from (select label, "
         "unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) "
         "group by all)")
DIST = ("dist as (select a.label as a, b.label as b, sqrt(sum((a.value - b.value) ^ 2)) as d "
        "from cents a join cents b on a.pos = b.pos and a.label < b.label group by all)")


@query("h8_centroids", f"with {CENTS} select label, pos, round(value, 6) as value from cents")
def h8(spark, sf):
    return cl.centroids(embeddings(spark, sf)).withColumn("value", F.round("value", 6))


@query("h9_centroid_top_terms", s.with_tickets(
    "select cluster as label, rank, term, round(v, 6) as value, round(v / max(v) over "
    "(partition by cluster), 6) as share from (select *, row_number() over (partition by cluster "
    "order by v desc, term) as rank from (select cluster, term, round(sum(weight) / "
    "(select count(*) from tickets t2 where t2.cluster = t.cluster), 12) as v from weights join "
    "tickets t using (ticket_id) group by cluster, term) qualify rank <= 15)",
    *VOCAB_C, *WEIGHTS))
def h9(spark, sf):
    t = terms_of(spark, sf)
    w = ft.tf_idf(t, ft.fit_vocabulary(t, pairs=True), K, keep=("cluster",))
    cents = cl.term_centroids(w, t.select(K, "cluster"), K)
    # Equal terms must rank alike in both engines: compare weights without rounding noise.
    cents = cents.withColumn("value", F.round("value", 12))
    return cl.centroid_top_terms(cents).withColumns(
        {"value": F.round("value", 6), "share": F.round("share", 6)})


@query("h10_centroid_distances", f"with {CENTS}, {DIST} select a, b, round(d, 6) as distance from dist")
def h10(spark, sf):
    return cl.centroid_distances(cl.centroids(embeddings(spark, sf))).withColumn(
        "distance", F.round("distance", 6))


@query("h10_distance_summary", (
    f"with {CENTS}, {DIST} select (select a || '-' || b from dist order by d, a, b limit 1) as "
    "nearest, round(min(d), 6) as min_distance, (select a || '-' || b from dist order by d desc, a, "
    "b limit 1) as farthest, round(max(d), 6) as max_distance, round(avg(d), 6) as mean_distance "
    "from dist"))
def h10s(spark, sf):
    d = cl.distance_summary(cl.centroid_distances(cl.centroids(embeddings(spark, sf))))
    return d.withColumns({c: F.round(c, 6) for c in ("min_distance", "max_distance", "mean_distance")})


@query("h11_assign_nearest", (
    f"with {CENTS}, d as (select vec_id, c.label as l, sum((cast(x as double) - value) ^ 2) as d "
    "from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos "
    "from embeddings) e join cents c on e.pos = c.pos group by all) select vec_id, l as nearest, "
    "round(sqrt(d), 6) as distance from d qualify row_number() over (partition by vec_id "
    "order by d, l) = 1"))
def h11(spark, sf):
    e = embeddings(spark, sf)
    return cl.assign_nearest(e, cl.centroids(e)).select(
        "vec_id", "nearest", F.round("distance", 6).alias("distance"))


@query("h12_centroid_stats", (
    f"with {CENTS} select label, round(sqrt(sum(value * value)), 6) as norm, "
    "round(avg(cast(value <> 0 as int)), 6) as density from cents group by label"))
def h12(spark, sf):
    st = cl.centroid_stats(cl.centroids(embeddings(spark, sf)))
    return st.withColumns({c: F.round(c, 6) for c in ("norm", "density")})


# -- evaluation --------------------------------------------------------------------

LABELS = ("lab as (select doc_id, quality as label, toxic as prediction from labels)")


def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").select(
        "doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


@query("l1_encode_labels", s.with_tickets(
    "select ticket_id, cluster, cast((select count(distinct cluster) from tickets b "
    "where b.cluster < a.cluster) as double) as label, cluster as decoded from tickets a"))
def l1(spark, sf):
    t = load_tickets(spark, sf).select(K, "cluster")
    model, out = md.encode_labels(t)
    return md.decode_labels(out, model.labels, "label").withColumnRenamed(
        "predicted_cluster", "decoded")


@query("l2_stratified_split", s.with_tickets(
    "select ticket_id, cluster, rk <= n_test as is_test from ranked join sizes using (cluster)",
    "goal as (select count(*) as total, cast(ceil(count(*) * 0.2) as bigint) as g from tickets)",
    "per as (select cluster, count(*) as n, count(*) * max(g) / cast(max(total) as double) as x "
    "from tickets, goal group by cluster)",
    "sizes as (select cluster, cast(floor(x) as bigint) + cast(row_number() over (order by "
    "round(x - floor(x), 9) desc, cluster) <= (select max(g) from goal) - sum(cast(floor(x) as "
    "bigint)) over () as bigint) as n_test from per)",
    "ranked as (select ticket_id, cluster, row_number() over (partition by cluster order by "
    "md5(ticket_id || ':42')) as rk from tickets)"))
def l2(spark, sf):
    t = load_tickets(spark, sf).select(K, "cluster")
    return ev.stratified_split(t, "cluster").select(K, "cluster", "is_test")


@query("l3_holdout", s.with_tickets(
    "select ticket_id, row_number() over (order by md5(ticket_id || ':42')) <= 100 as is_test "
    "from tickets"))
def l3(spark, sf):
    train, test = ev.holdout(load_tickets(spark, sf).select(K))
    return train.withColumn("is_test", F.lit(False)).unionByName(
        test.withColumn("is_test", F.lit(True)))


def _split_terms(spark, sf):
    """Labelled terms with the stratified split, and the vectorizer of the training part."""
    names, rows = md.encode_labels(terms_of(spark, sf))
    split = ev.stratified_split(rows, "cluster").select(K, "cluster", "label", "terms", "is_test").cache()
    return names.labels, split, ft.vectorizer(ft.fit_vocabulary(split.where("not is_test"), pairs=True))


@query("l4_train_forest", s.with_tickets(
    "select is_test, n, true as in_range, true as beats_majority from (select false as is_test, total - g as n from goal "
    "union all select true, g from goal)",
    "goal as (select count(*) as total, cast(ceil(count(*) * 0.2) as bigint) as g from tickets)"))
def l4(spark, sf):
    """The production forest; its vocabulary has not seen the test part."""
    _, split, vec = _split_terms(spark, sf)
    rows = vec.transform(split).select("cluster", "label", "is_test", "features").cache()
    scored = md.train_forest(rows.where("not is_test")).transform(rows)
    hit = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    largest = rows.groupBy("is_test", "cluster").count().groupBy("is_test").agg(
        (F.max("count") / F.sum("count")).alias("majority"))
    return scored.groupBy("is_test").agg(F.count("*").alias("n"), hit.alias("a")).join(largest, "is_test").select(
        "is_test", "n", F.col("a").between(0, 1).alias("in_range"), (F.col("a") > F.col("majority")).alias("beats_majority"))


@query("l5_accuracy", (
    f"with {LABELS} select count(*) as n, round(avg(cast(label = prediction as int)), 6) as accuracy "
    "from lab"))
def l5(spark, sf):
    return ev.accuracy(labels(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@query("l6_predict", s.with_tickets(
    "select ticket_id, true as known_type, true as in_range from tickets"))
def l6(spark, sf):
    """Every ticket gets the type of a cluster, and a confidence that no class is below by chance."""
    labels_, split, vec = _split_terms(spark, sf)
    rows = vec.transform(split).select(K, "label", "is_test", "features").cache()
    forest = md.train_forest(rows.where("not is_test"))
    types = split.select(tx.type_id("cluster").alias("predicted_type")).distinct().withColumn("known", F.lit(True))
    done = md.predict(rows, forest, labels_).join(F.broadcast(types), "predicted_type", "left")
    return done.select(K, F.coalesce("known", F.lit(False)).alias("known_type"),
                       (F.col("confidence") >= F.lit(1.0 / len(labels_) - 1e-9)).__and__(F.col("confidence") <= 1).alias("in_range"))


@query("l7_type_id", s.with_tickets(
    "select ticket_id, 'tipo_' || lpad(cast(cluster as varchar), 2, '0') as tipo from tickets"))
def l7(spark, sf):
    return load_tickets(spark, sf).select(K, tx.type_id("cluster").alias("tipo"))


@query("l9_folds", s.with_tickets(
    "select ticket_id, cast(('0x' || substr(md5(ticket_id || ':42'), 1, 8))::bigint % 5 as integer) "
    "as fold from tickets"))
def l9(spark, sf):
    return load_tickets(spark, sf).select(K, ev.fold_of(K).alias("fold"))


_FOLD = "cast(('0x' || substr(md5(ticket_id || ':42'), 1, 8))::bigint % 5 as integer)"
_FOLD_CTES = (
    *VOCAB_C[:5],
    f"folds as (select {_FOLD} as fold, count(*) as own from tickets group by 1)",
    f"foldtf as (select {_FOLD} as fold, term, tf from tf)",
    "foldvocab as (select folds.fold, term, count(*) as df, cast(sum(tf) as bigint) as cf from folds join foldtf "
    "on folds.fold <> foldtf.fold group by folds.fold, term, own having count(*) >= 3 and "
    "count(*) <= cast(0.7 as double) * ((select n from n) - own) "
    "qualify row_number() over (partition by folds.fold order by cf desc, term) <= 8000)",
)


@query("l9_fold_vocabularies", s.with_tickets("select fold, term, df, cf from foldvocab", *_FOLD_CTES))
def l9_vocabularies(spark, sf):
    """The vocabulary of each fold, by subtraction from counts taken once."""
    t = terms_of(spark, sf).select("terms", ev.fold_of(K).alias("fold"))
    sizes = {r["fold"]: r["count"] for r in t.groupBy("fold").count().collect()}
    return ft.fold_vocabularies(ft.fold_stats(t, "fold", sizes=sizes), sizes).select("fold", "term", "df", "cf")


@query("l9_cross_validate", s.with_tickets(
    "select fold, own as n, (select count(*) from foldvocab v where v.fold = folds.fold) as terms, "
    "true as in_range from folds", *_FOLD_CTES))
def l9_cv(spark, sf):
    """Five folds with 8,000 terms and the production forest."""
    _, rows = md.encode_labels(terms_of(spark, sf))
    return md.cross_validate(rows).select("fold", "n", "terms", F.col("accuracy").between(0, 1).alias("in_range"))


@query("l10_confusion", f"with {LABELS} select label, prediction, count(*) as n from lab group by all")
def l10(spark, sf):
    return ev.confusion(labels(spark, sf))


@query("l10_class_accuracy", (
    f"with {LABELS} select label as class, count(*) as n, count(*) filter (label = prediction) as hits, "
    "(select count(*) from lab b where b.prediction = a.label) as predicted, "
    "round(avg(cast(label = prediction as int)), 6) as accuracy from lab a group by label"))
def l10c(spark, sf):
    return ev.class_accuracy(labels(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@query("l11_baselines", (
    f"with {LABELS}, p as (select label, count(*) as n, count(*) filter (label = prediction) as h "
    "from lab group by label), o as (select count(*) as classes, sum(h) / sum(n) as accuracy, "
    "1.0 / count(*) as random, max(n) / sum(n) as majority from p) select classes, "
    "round(accuracy, 6) as accuracy, round(cast(random as double), 6) as random, "
    "round(majority, 6) as majority, round((accuracy - random) * 100, 6) as uplift_random, "
    "round((accuracy - majority) * 100, 6) as uplift_majority from o"))
def l11(spark, sf):
    b = ev.baselines(labels(spark, sf))
    return b.withColumns({c: F.round(c, 6) for c in b.columns if c != "classes"})


@query("l12_accuracy_ci", (
    f"with {LABELS}, a as (select count(*) as n, avg(cast(label = prediction as int)) as p from lab) "
    "select n, round(p, 6) as accuracy, round(p - 1.96 * sqrt(p * (1 - p) / n), 6) as low, "
    "round(p + 1.96 * sqrt(p * (1 - p) / n), 6) as high from a"))
def l12(spark, sf):
    c = ev.accuracy_ci(labels(spark, sf))
    return c.withColumns({x: F.round(x, 6) for x in ("accuracy", "low", "high")})


@query("l13_ablation", s.with_tickets(
    "select least(terms, (select count(*) from vocab)) as terms, k, (select count(*) from tickets) - own as n_train, "
    "own as n_test, true as in_range from folds, (select unnest([8000, 4000]) as terms), (select unnest([25, 15]) as k) "
    "where fold = 0",
    *(c.replace("n as (select count(*) as n from tickets)", f"n as (select count(*) as n from tickets where {_FOLD} <> 0)")
      .replace("idf from tf group", f"idf from (select * from tf where {_FOLD} <> 0) group") for c in VOCAB_C),
    _FOLD_CTES[5]))
def l13(spark, sf):
    """Vocabularies of 8,000 and 4,000 terms by 25 and 15 clusters, from one feature table."""
    return md.ablate(terms_of(spark, sf)).select(
        F.col("terms").cast("long").alias("terms"), F.col("k").cast("long").alias("k"), "n_train", "n_test",
        F.col("accuracy").between(0, 1).alias("in_range"))


@query("l8_system_metrics", (
    f"select true as silhouette_in_range, true as accuracy_in_range, true as score_in_range, k as num_clusters, "
    f"cast(1 as double) as coverage from ({_KSQL})"))
def l8(spark, sf):
    """Metrics of a run of the production setting, cross-validation included."""
    f = features(spark, sf)
    model = cl.fit_kmeans(f, cl.choose_k(f.count()))
    clusters = model.transform(f).withColumn("cluster", F.col("prediction"))
    _, rows = md.encode_labels(terms_of(spark, sf).drop("cluster").join(clusters.select(K, "cluster"), K))
    score = md.cross_validate(rows).agg(F.avg("accuracy")).first()[0]
    m = md.system_metrics(spark, cl.silhouette(clusters), score, clusters.select("cluster").distinct().count(), score)
    return m.select(
        F.col("silhouette_score").between(-1, 1).alias("silhouette_in_range"),
        F.col("model_accuracy").between(0, 1).alias("accuracy_in_range"),
        F.col("model_cv_score").between(0, 1).alias("score_in_range"),
        F.col("num_clusters").cast("long").alias("num_clusters"), "coverage")
