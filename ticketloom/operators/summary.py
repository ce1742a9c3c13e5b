"""Summaries of a category table and of classified tickets.

A category table has one row per cluster (50 at most by configuration), so sorting it
or putting it in one row is bounded; tickets are only ever counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketloom import lexicons as lx
from ticketloom.functions.text import format_percent, join_first

# Size bands of categories and their order.
SIZE_BANDS = ("Pequeñas (<20)", "Medianas (20-50)", "Grandes (>50)")
# General recommendations.
GENERAL_RECOMMENDATIONS = (
    "Desarrollar procedimientos específicos por categoría identificada",
    "Establecer KPIs de seguimiento por tipo de incidencia",
    "Revisar y actualizar el análisis periódicamente",
)


def executive_summary(
    cats: DataFrame, accuracy: Column | float | None = None, max_categories: int = 20
) -> DataFrame:
    """One row: tickets, categories, high criticality, coverage, largest category."""
    acc = F.lit(accuracy).cast("double") if not isinstance(accuracy, Column) else accuracy
    return cats.agg(
        F.sum("num_incidencias").alias("total_incidencias"),
        F.count("*").alias("categorias_identificadas"),
        F.count_if(F.col("nivel_criticidad") == "Alta").alias("categorias_alta_criticidad"),
        coverage(F.count("*"), max_categories).alias("cobertura_analisis"),
        F.min_by("nombre", F.struct(-F.col("num_incidencias"), "cluster")).alias(
            "categoria_mas_frecuente"
        ),
    ).withColumn("precision_modelo", acc)


def coverage(categories: Column, max_categories: int = 20) -> Column:
    """Categories found as a share of those allowed, as text."""
    return format_percent(categories / F.lit(float(max_categories)))


def category_report(cats: DataFrame) -> DataFrame:
    """Report rows: categories by volume with their fields as text."""
    by_volume = Window.orderBy(F.desc("num_incidencias"), "cluster")
    return cats.select(
        F.row_number().over(by_volume).alias("orden"),
        "cluster",
        F.upper("nombre").alias("titulo"),
        "num_incidencias",
        F.coalesce("nivel_criticidad", F.lit("No evaluada")).alias("criticidad"),
        "descripcion",
        join_first("palabras_clave", 5).alias("palabras_clave"),
        F.array_join("patrones_identificados", ", ").alias("patrones"),
        join_first("tipos_principales", 3).alias("tipos_principales"),
        F.array_join(
            F.transform(
                F.slice("ejemplos", 1, 3),
                lambda e: F.concat(F.lit("["), e["id"], F.lit("] "), e["resumen"]),
            ),
            "\n",
        ).alias("ejemplos"),
    )


def semantic_report(cats: DataFrame) -> DataFrame:
    """Report rows of the analyzer's categories by volume, their fields as text."""
    by_volume = Window.orderBy(F.desc("num_incidencias"), "cluster")
    return cats.select(
        F.row_number().over(by_volume).alias("orden"), "cluster", F.upper("nombre").alias("titulo"),
        "num_incidencias", F.round("porcentaje_total", 2).alias("porcentaje_total"),
        F.coalesce("nivel_criticidad", F.lit("No evaluada")).alias("criticidad"), "descripcion",
        join_first("palabras_clave", 5).alias("palabras_clave"),
        join_first("causas_principales", 3).alias("causas_principales"),
    )


def top_categories(cats: DataFrame, n: int = 5) -> DataFrame:
    """Largest categories."""
    return cats.select("cluster", "nombre", "num_incidencias").orderBy(
        F.desc("num_incidencias"), "cluster"
    ).limit(n)


def size_stats(cats: DataFrame) -> DataFrame:
    """Mean, median, largest, smallest and population deviation of the sizes."""
    n = F.col("num_incidencias")
    return cats.agg(
        F.avg(n).alias("tamano_promedio_categoria"),
        F.median(n).alias("tamano_mediano_categoria"),
        F.max(n).alias("categoria_mas_grande"),
        F.min(n).alias("categoria_mas_pequena"),
        F.stddev_pop(n).alias("desviacion_estandar"),
    )


def by_criticality(cats: DataFrame) -> DataFrame:
    """Categories per criticality."""
    level = F.coalesce("nivel_criticidad", F.lit("No evaluada"))
    return cats.groupBy(level.alias("criticidad")).agg(F.count("*").alias("categorias"))


def by_size_band(cats: DataFrame) -> DataFrame:
    """Categories per size band; a band without categories shows zero."""
    n = F.col("num_incidencias")
    small, middle, large = SIZE_BANDS
    counts = cats.agg(
        F.count_if(n < 20).alias("a"), F.count_if(n.between(20, 50)).alias("b"),
        F.count_if(n > 50).alias("c"),
    )
    return counts.selectExpr(f"stack(3, '{small}', a, '{middle}', b, '{large}', c) as (banda, categorias)")


def recommendations(cats: DataFrame) -> DataFrame:
    """Recommendation texts in order; the first two only when they apply."""
    one = cats.agg(
        F.count_if(F.col("nivel_criticidad") == "Alta").alias("alta"),
        F.count_if(F.col("num_incidencias") > 50).alias("grandes"),
    )
    priority = F.when(
        F.col("alta") > 0,
        F.concat(F.lit(lx.RECOMMEND_PRIORITY[0]), F.col("alta"), F.lit(lx.RECOMMEND_PRIORITY[1])),
    )
    automation = F.when(
        F.col("grandes") > 0,
        F.concat(F.lit(lx.RECOMMEND_AUTOMATION[0]), F.col("grandes"), F.lit(lx.RECOMMEND_AUTOMATION[1])),
    )
    every = F.array_compact(
        F.array(priority, automation, *[F.lit(t) for t in GENERAL_RECOMMENDATIONS])
    )
    return one.select(F.posexplode(every).alias("orden", "recomendacion"))


# -- classified tickets --------------------------------------------------------

def holdout_totals(df: DataFrame) -> DataFrame:
    """Total, classified and failed test cases."""
    bad = F.col("categoria_predicha") == "ERROR"
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(~F.coalesce(bad, F.lit(False))).alias("exitosos"),
        F.count_if(bad).alias("con_error"),
    )


def confidence_stats(df: DataFrame) -> DataFrame:
    """Mean, least, greatest and number above 0.8, without zeros."""
    c = F.col("confianza")
    return df.where(c > 0).agg(
        F.avg(c).alias("promedio"), F.min(c).alias("minima"), F.max(c).alias("maxima"),
        F.count_if(c > 0.8).alias("alta_confianza"),
    )


def confidence_band(c: Column | str) -> Column:
    """High above 0.8, middle from 0.5 to 0.8, low below."""
    c = F.col(c) if isinstance(c, str) else c
    return (
        F.when(c > 0.8, "alta_confianza").when(c >= 0.5, "media_confianza")
        .when(c.isNotNull(), "baja_confianza")
    )


def confidence_bands(df: DataFrame) -> DataFrame:
    """Cases per confidence band, without zeros."""
    return (
        df.where(F.col("confianza") > 0)
        .groupBy(confidence_band("confianza").alias("banda"))
        .agg(F.count("*").alias("casos"))
    )


def category_distribution(df: DataFrame, name: str = "nombre_categoria") -> DataFrame:
    """Cases and percentage per predicted category, largest first."""
    counts = df.groupBy(name).agg(F.count("*").alias("casos"))
    total = F.sum("casos").over(Window.partitionBy())
    return counts.withColumn("porcentaje", F.col("casos") * 100.0 / total).orderBy(
        F.desc("casos"), name
    )


def rule_summary(classified: DataFrame) -> DataFrame:
    """Tickets and mean confidence per predicted category."""
    return classified.groupBy("predicted_type").agg(
        F.count("*").alias("tickets"), F.avg("confidence").alias("mean_confidence"),
        F.avg("score").alias("mean_score"),
    )
