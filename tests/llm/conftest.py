import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, stems="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()):
    return [rng.choice(stems) + rng.choice(stems) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Odd and plain rows: nulls in every column, empty and white texts, ties, repeated rows, copies, a very long text."""
    rng = random.Random(3)
    plain = [(i, ". ".join(" ".join(words(rng, 9)) for _ in range(rng.randint(1, 6))), rng.choice(["en", "fr"]), f"s{i % 4}", 1) for i in range(40)]
    odd = [
        (100, None, "en", "s1", None),
        (101, "", "en", None, 0),
        (102, " \t\n ", None, "s2", 4),
        (103, "x", "fr", "s1", 1),
        (None, "no id here at all, really", "en", "s1", 9),
        (104, plain[3][1], "en", "s9", 5),
        (105, plain[3][1], "en", "s9", 5),
        (105, plain[3][1], "en", "s9", 5),
        (106, " ".join(words(rng, 30_000)), "en", "s0", 7),
        (107, 'Password: "abcdef123" token=abc AKIA' + "Z" * 16 + " " + "0a" * 12, "en", "s3", 7),
        (108, "naïve Ünïcode 😀 text.\n\nSection two.\nKey secret = s3cr3t/x+y", "fr", "s3", 7),
    ]
    return plain + odd


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOC).repartition(3)
    clash = ["score", "size", "fp", "blob", "key", "h", "place", "range", "spans", "block", "target"]
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])


@pytest.fixture(scope="session")
def labels(spark, rows):
    ids = [r[0] for r in rows]
    return spark.createDataFrame([(i, (i or 0) % 3 and 1, int((i or 0) % 5 == 0)) for i in ids] + [(7, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark, rows):
    a, b = rows[5][1], rows[6][1]
    half = a.split()
    return spark.createDataFrame([(1, " ".join(half[4:] + half[:4])), (2, b.upper()), (3, None), (4, ""), (5, "entirely other words that no document has")], "item_id long, text string")
