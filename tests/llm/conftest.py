import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts(seed: int = 5) -> list[tuple]:
    """Documents with copies, near copies, nulls, empty, very long, tied and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "ri", "on", "es", "ül", "ma"]) for _ in range(rng.randint(1, 5)))
    para = lambda n: " ".join(word() for _ in range(n)) + "."
    base = [para(120) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(12, 24):
        w = base[k % 12].split(" ")
        for _ in range(k % 6 * 3):
            w[rng.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "one"), (34, "One"), (35, "\n".join(base[:3] * 40)),
             (36, para(20_000)), (37, base[0]), (38, base[0]), (39, "a b"), (40, "x" * 300), (41, "ab " * 200),
             (42, "Line one of it\n" * 30), (43, "<|endoftext|> and é́ \U0001F600 don't, 3.5"), (None, base[1]), (None, None)]
    rows.append(rows[3])
    return [(i, t, None if i == 5 else "en", None if i == 6 else "s1" if (i or 0) % 3 else "s2", None) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """The same with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(texts(), SCHEMA)
    for name in ("doc", "shard", "bucket", "slot", "quality", "values", "id", "a", "b", "w", "n", "bad", "key", "label", "kept", "gone", "x.y"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
