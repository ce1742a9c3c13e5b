"""Ticket sources: explicit schema, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ticketloom.functions.text import literals, squash

# Column headings of a ticket file and our names.
HEADINGS = (
    ("Ticket ID", "ticket_id"),
    ("Resumen", "resumen"),
    ("Notas", "notas"),
    ("Tipo de ticket", "tipo_ticket"),
    ("Causa Raíz", "causa_raiz"),
    ("Resolución", "resolucion"),
    ("Prioridad", "prioridad"),
)

TICKET_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for _, name in HEADINGS]
    + [T.StructField("created_at", T.TimestampNTZType())]
)
# Other spellings of two headings.
VARIANTS = (("Causa Raiz", "causa_raiz"), ("Tipo de Ticket", "tipo_ticket"))
KEY_COLUMNS = ("ticket_id", "resumen", "notas")


def _spellings(name: str) -> list[str]:
    """Headings under which a column of ours may stand, in the order they are taken."""
    return [h for h, n in (*HEADINGS, *VARIANTS) if n == name] + [name]


def named_columns(df: DataFrame) -> DataFrame:
    """The ticket columns by heading, whatever their order in the file.

    Headings match without regard to case and outer blanks. Of several spellings of one
    column the first with a value counts. Other columns are left out, missing ones are
    null, but two of the key columns must be there.
    """
    there: dict[str, list[str]] = {}
    for c in df.columns:
        there.setdefault(c.strip().lower(), []).append(c)
    found, out = [], []
    for field in TICKET_SCHEMA:
        spelt = dict.fromkeys(c for h in _spellings(field.name) for c in there.get(h.lower(), ()))
        cols = [F.col(f"`{c.replace('`', '``')}`") for c in spelt]
        if cols:
            found.append(field.name)
        value = F.coalesce(*cols) if cols else F.lit(None)
        out.append((value.try_cast(field.dataType) if cols else value.cast(field.dataType)).alias(field.name))
    missing = [c for c in KEY_COLUMNS if c not in found]
    if len(missing) > 1:
        raise ValueError(f"no column for {missing} among {df.columns}")
    return df.select(*out)


def read_tickets_csv(
    spark: SparkSession, path: str, sep: str = ";", encoding: str = "ISO-8859-1",
    multiline: bool = False,
) -> DataFrame:
    """Delimited ticket file, or folder of files with one heading line each.

    Columns are found by heading. The heading line is all that is read beforehand; a file
    whose headings differ from the first one's is an error, never read by position.
    ``multiline`` lets a quoted field hold line breaks; such a file cannot be split,
    so leave it off for large files and write one file per part instead.
    """
    def reader():
        return (
            spark.read.option("sep", sep).option("encoding", encoding).option("header", True)
            .option("escape", '"').option("multiLine", multiline)
        )

    headings = reader().csv(path).schema
    return named_columns(reader().schema(headings).option("enforceSchema", False).csv(path))


def read_tickets(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Ticket table in parquet, orc, json or csv, its columns found by name.

    JSON lines may each spell a heading in their own way, as file headings or ours, in any case.
    """
    if fmt == "csv":
        return read_tickets_csv(spark, path)
    if fmt not in ("parquet", "orc", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    if fmt == "json" and schema is None:
        fields = F.map_entries(F.from_json("value", T.MapType(T.StringType(), T.StringType())))
        named = F.transform(fields, lambda e: F.struct(F.lower(F.btrim(e["key"])).alias("name"), e["value"].alias("value")))
        lines = spark.read.text(path).select(named.alias("m"))

        def first(heading: str) -> Column:
            return F.get(F.filter("m", lambda e: (e["name"] == heading) & e["value"].isNotNull()), 0)["value"]

        return lines.select(*(
            F.coalesce(*(first(h) for h in dict.fromkeys(h.lower() for h in _spellings(f.name))))
            .try_cast(f.dataType).alias(f.name) for f in TICKET_SCHEMA))
    reader = spark.read.format(fmt)
    return named_columns((reader.schema(schema) if schema is not None else reader).load(path))


def require_columns(
    df: DataFrame, cols: Sequence[str] = ("ticket_id", "resumen", "notas"), at_least: int = 2
) -> list[str]:
    """Names present of those asked for; error when too few.  Reads no data."""
    present = [c for c in cols if c in df.columns]
    if len(present) < at_least:
        raise ValueError(f"needs at least {at_least} of {list(cols)}, found {present}")
    return present


def require_rows(df: DataFrame, n_test: int = 100, n_train: int = 500) -> None:
    """Error when there are fewer rows than the hold-out needs.

    Stops reading once enough rows are seen.
    """
    need = n_test + n_train
    seen = df.select(F.lit(1)).limit(need).count()
    if seen < need:
        raise ValueError(f"needs {need} valid tickets, found {seen}")


def valid_tickets(df: DataFrame) -> DataFrame:
    """Tickets with a summary."""
    return df.where(F.col("resumen").isNotNull() & (F.col("resumen") != ""))


def with_known_cause(df: DataFrame) -> DataFrame:
    """Tickets with a root cause."""
    return df.dropna(subset=["causa_raiz"])


# -- tickets derived from other tables ---------------------------------------

# Fixed values of the test recipe, see FIXTURES.md.
PHRASES = (
    "Alta CUPS y regularizar CUPS {cups}",
    "Montaje y desmontaje, cambio de aparato",
    "Error al calcular factura, TIPDET",
    "Estado incoherente, no calculable",
    "Solape: anular lectura PCS",
    "Modificar dirección, NIF y teléfono",
    "Cambio de titular con subrogación",
    "Aceptar oferta con adenda",
    "Tarifa comercial y producto activo",
    "Bono social vulnerable severo",
    "Gestionar rechazo REQ{n} y bloqueo",
    "Devolución e impago en ventanilla",
    "Fail job batch FTP envío {fecha}",
    "Solicito listado e informe",
    "Indicador telemedida, medición remota",
    "XML incorrecto en mensajería",
    "Salesforce y GNClick sin dato",
    "Campaña simulada ASNEF",
    "Subir plantilla de documentación",
    "Criterios y funcionamiento SQL",
    "Sin etiqueta clara",
    "Error bloqueado, urgente y masivo R25-{n}",
    "Buenos días, problema crítico OFL{n}, gracias",
    "Consulta",
)
TYPES = ("INCIDENCIA", "PETICION", "CONSULTA")
CAUSES = (
    "Actualización masiva de datos", "Infraestructura", "Proceso batch",
    "Consulta funcional", "Facturación", "Error técnico",
)
PRIORITIES = ("Alta", "Media", "Baja", "No especificada")
SUMMARY_CHARS = 60


def tickets_from_documents(docs: DataFrame) -> DataFrame:
    """One ticket per document, holding the whole text of the document.

    The summary is a planted phrase and the beginning of the text; the notes hold the
    rest.  A tenth of the tickets have no notes; there the summary holds all of it.
    """
    i = F.col("doc_id")

    def nth(values: Sequence[str], expr) -> F.Column:
        return F.element_at(literals(values), expr.cast("int") + 1)

    filled = F.replace(
        F.replace(
            F.replace(
                nth(PHRASES, i % 24),
                F.lit("{cups}"),
                F.concat(F.lit("ES"), F.lpad(i.cast("string"), 16, "0"), F.lit("ZZ1P")),
            ),
            F.lit("{n}"),
            (i + 1000).cast("string"),
        ),
        F.lit("{fecha}"),
        F.concat_ws(
            "/", (1 + i % 28).cast("string"), (1 + i % 12).cast("string"), F.lit("2024")
        ),
    )
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    sq = docs.select("doc_id", squash("text").alias("sq"))
    no_notes = i % 10 == 0
    return sq.select(
        F.concat(F.lit("T"), F.lpad(i.cast("string"), 8, "0")).alias("ticket_id"),
        F.concat(
            filled,
            F.lit(" "),
            F.when(no_notes, F.col("sq")).otherwise(F.substring("sq", 1, SUMMARY_CHARS)),
        ).alias("resumen"),
        F.when(~no_notes, F.expr(f"substring(sq, {SUMMARY_CHARS + 1})")).alias("notas"),
        nth(TYPES, (i % 5) % 3).alias("tipo_ticket"),
        F.when(i % 7 != 0, nth(CAUSES, (i % 11) % 6)).alias("causa_raiz"),
        F.when(i % 5 == 0, F.lit("Anulación y corregir, favor revisar")).alias("resolucion"),
        nth(PRIORITIES, (i % 13) % 4).alias("prioridad"),
        (start + F.make_dt_interval(F.lit(0), (i % 2000).cast("int"))).alias("created_at"),
        F.when(i < 8, 90)
        .when(i % 24 >= 17, 17)
        .when((i % 24).isin(15, 16), 15)
        .otherwise((i % 24).cast("int"))
        .alias("cluster"),
        "doc_id",
    )


def load_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of a test data folder, dealt over the cores: a folder is one small file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return tickets_from_documents(docs.repartition(cores, "doc_id"))

