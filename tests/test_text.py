"""Text functions on hand-written cases; expected values follow from the definitions."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ticketloom import lexicons as lx
from ticketloom.functions import entities as en, phrases as ph, text as tx


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,expected", [
    ("Muchas gracias, hay FALLOS", "muchas hay errors"),
    ("Por favor: cancelación", "por baja"),
    ("", ""),
    (None, ""),
    ("  Cambiar   TARIFA ya ", "modificar tarifa ya"),
])
def test_preprocess(spark, text, expected):
    assert one(spark, text, tx.preprocess("t")) == expected


def test_ascii_tokens_drop_accented_words_whole(spark):
    got = one(spark, "información de DELED255P_FTP y CUPS 01427", tx.ascii_tokens("t"))
    assert got == ["cups", "01427"]


def test_clean_es_keeps_hyphen_and_underscore(spark):
    assert one(spark, "Ñandú-X_1, (ê) fin", tx.clean_es("t")) == "ñandú-x_1 fin"


def test_ngrams(spark):
    assert one(spark, "a uno dos uno", tx.ngrams_1_2(tx.word_tokens("t"))) == [
        "uno", "dos", "uno", "uno dos", "dos uno"]
    assert one(spark, "uno", tx.ngrams_1_2(tx.word_tokens("t"))) == ["uno"]
    assert one(spark, None, tx.ngrams_1_2(tx.word_tokens("t"))) == []


def test_technical_keywords_class_then_text_order(spark):
    got = one(spark, "sql error batch error fail databases", tx.technical_keywords("t"))
    assert got == "error_types_error error_types_error error_types_fail systems_sql operations_batch"


def test_rule_text_skips_nan_and_empty(spark):
    df = spark.createDataFrame([("Hola", "NaN", ""), ("A", None, "B")], "a string, b string, c string")
    got = [r["x"] for r in df.select(tx.rule_text("a", "b", "c").alias("x")).collect()]
    assert got == ["hola", "a b"]


def test_ellipsize(spark):
    assert one(spark, "a" * 150, tx.ellipsize("t", 150)) == "a" * 150
    assert one(spark, "a" * 151, tx.ellipsize("t", 150)) == "a" * 150 + "..."


def test_slugs(spark):
    assert one(spark, "Errores Sistema Critico Frecuentes", tx.slug_key("t")) == (
        "errores_sistema_critico_frecuentes")
    assert one(spark, "Gestión de Datos - Alta (x)", tx.slug_merged("t")) == "gestión_de_datos_alta_x"


def test_title_case_as_after_every_non_letter(spark):
    assert one(spark, "r25 3abc hola-mundo", tx.title_case("t")) == "R25 3Abc Hola-Mundo"


def test_type_id(spark):
    assert one(spark, "7", tx.type_id(F.col("t").cast("int"))) == "tipo_07"


def test_entities(spark):
    got = one(spark, "ES0000000000000001ZZ1P el 3/5/24, xr12-3 REQ9 req9 inactivo bono social.",
              en.extract_entities("t"))
    assert got["cups"] == ["es0000000000000001zz1p"]
    assert got["fechas"] == ["3/5/24"]
    assert got["sr"] == ["r12-3"]
    assert got["req"] == ["req9"]
    assert got["estados"] == ["inactivo"]
    assert got["productos"] == ["bono social"]
    assert one(spark, None, en.extract_entities("t")) == {n: [] for n in en.ENTITY_TYPES}


ALPHABET = st.sampled_from(list("abcs. oló") + ["cups", "alta cups", "bono ", "social", "oc"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=40),
       phrases=st.lists(st.lists(st.sampled_from("abcs. ló"), min_size=1, max_size=4).map("".join),
                        min_size=1, max_size=12, unique=True))
def test_phrases_in_equals_contains(spark, texts, phrases):
    """The one-pass search finds exactly the phrases that a substring test finds."""
    phrases = [*phrases, "cups", "alta cups", "bono social", "bono", "oc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", ph.phrases_in("t", phrases).alias("x")).collect():
        assert sorted(row["x"]) == sorted({p for p in phrases if p in row["t"]})


def test_phrases_in_word_mode(spark):
    words = ["bono", "bono social", "plantilla", "plantillas", "oc"]

    def found(t):
        return sorted(one(spark, t, ph.phrases_in("t", words, "word")))

    assert found("el bono social.") == ["bono", "bono social"]
    assert found("bono socialx") == ["bono"]
    assert found("plantillas") == ["plantillas"]
    assert found("proceso óc oc") == ["oc"]


def test_rule_phrases_all_found(spark):
    every = sorted({k for _, kws in lx.RULES for k in kws})
    df = spark.createDataFrame([(k,) for k in every], "t string")
    for row in df.select("t", ph.phrases_in("t", every).alias("x")).collect():
        assert sorted(row["x"]) == sorted(k for k in every if k in row["t"])


def test_count_sub_matches_python(spark):
    t = "data datos base database error errorerror"
    for w in ("data", "error", "base", "zzz"):
        assert one(spark, t, tx.count_sub("t", w)) == len(re.findall(w, t))
