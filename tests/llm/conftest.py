import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(f"{WORDS[(seed * 7 + i * i * 3 + i * seed) % 24]}{(seed * 31 + i * 17) % 97}" for i in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty, blank, short and very long texts, equal rows,
    equal ids, copies and near copies, and columns whose names the operators use inside."""
    long = sentence(1, 6000)
    base = sentence(2, 120)
    near = base.replace(base.split()[60], "changed")
    passage = sentence(3, 70)
    lines = "\n".join(sentence(40 + i, 8) for i in range(6))
    rows = [
        (1, base), (2, base), (3, near), (4, long), (5, ""), (6, None), (7, "  \n\t "), (8, "one two"), (9, "one two"),
        (10, sentence(4, 30) + " " + passage + " " + sentence(5, 30)), (11, passage.replace(" ", "\n", 5) + " " + sentence(6, 40)), (11, sentence(7, 60)), (None, base), (None, None),
        (12, lines), (13, sentence(8, 5) + "\n" + lines + "\n" + sentence(9, 5)), (14, "x\nx\nx\nx"), (15, "Ünïcode ßtraße Σίσυφος 日本語 \U0001f600 " * 12), (15, "Ünïcode ßtraße Σίσυφος 日本語 \U0001f600 " * 12),
        (16, "a\x0bb\x0cc\rd e"), (17, long + " tail"),
    ]
    df = spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("dk", "_doc", "_dk", "_rid", "_i", "cls", "block", "part", "kinds", "keep", "word", "h"):
        df = df.withColumn(name, F.lit(0))
    return df


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
