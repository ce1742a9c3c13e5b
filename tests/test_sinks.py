import pytest
from pyspark.sql import functions as F

from ticketloom.operators.merge import category_similarity, merge_categories, merge_profile
from ticketloom.operators.ranking import bounded_list
from ticketloom.sources import sinks


def inputs(spark, n):
    return spark.range(n).select(
        F.col("id").cast("int").alias("cluster"),
        F.array(F.concat(F.lit("w"), (F.col("id") % 7).cast("string")), F.lit("x")).alias("top_words"),
        F.array(F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))).alias("top_causes"),
        (F.col("id") + 1).alias("num_incidencias"), F.lit(10.0).alias("avg_text_length"),
        (F.col("id") % 2 == 0).alias("has_technical_terms"), (F.col("id") % 3).alias("urgency_indicators"))


def test_more_than_fifty_categories(spark):
    cats = inputs(spark, 60)
    assert category_similarity(cats).count() == 60 * 59 // 2
    mapping, merged = merge_categories(cats, 20)
    assert mapping.count() == 60 and merged.count() >= 20
    assert merged.agg(F.sum("num_incidencias")).first()[0] == 60 * 61 // 2


def test_guard_is_part_of_the_plan(spark):
    df = spark.range(51).agg(bounded_list(F.col("id"), 50).alias("x"))
    with pytest.raises(Exception, match="51 rows"):
        df.collect()
    with pytest.raises(ValueError):
        merge_categories(inputs(spark, 60), most=50)


def test_clusters_outside_the_map_stay(spark):
    mapping = spark.createDataFrame([(0, 0), (1, 0)], "old int, new int")
    out = {r.cluster: r.num_incidencias for r in merge_profile(inputs(spark, 3), mapping).collect()}
    assert out == {0: 3, 2: 3}


def test_keys_are_unique(spark):
    rows = [(7, "a"), (8, "a"), (9, "a_7"), (1, "b"), (2, "b_2_2"), (3, "b_2")]
    df = spark.createDataFrame(rows, "cluster int, clave string").withColumn("k", sinks._unique_key())
    keys = {r.cluster: r.k for r in df.collect()}
    assert len(set(keys.values())) == 6 and keys[1] == "b" and keys[7] == "a_7"


def test_categories_are_computed_once_for_all_statistics(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    rows = [(i, f"n{i}", 10 * i + 5, "Alta" if i == 2 else "Baja") for i in range(3)]
    df = spark.createDataFrame(rows, "cluster int, nombre string, num_incidencias long, nivel_criticidad string")
    cats = df.withColumn("num_incidencias", counted("num_incidencias"))
    (out,) = sinks.statistics_document(cats).collect()
    assert seen.value == 3
    assert out.estadisticas_clustering.categoria_mas_grande == 25 and out.resumen_ejecutivo.categorias_alta_criticidad == 1
    assert out.distribuciones.por_criticidad == {"Alta": 1, "Baja": 2}
