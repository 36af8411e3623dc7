import pytest

LINE = "a common line of some length"
TEXTS = [
    (1, "alpha beta gamma\n" + LINE + "\nshort"),
    (2, "  A COMMON line of some length\t\nthe second text has its own line"),
    (3, None),
    (4, ""),
    (5, "alpha beta gamma\n" + LINE + "\nshort"),
    (6, "été à la plage\nété à la plage\n\n"),
    (7, "12 34 !!! ---"),
    (8, " ".join(f"w{k % 977}" for k in range(30_000))),
    (9, "ÉTÉ à la plage"),
    (10, " ".join(f"w{k % 977}" for k in range(29_000))),
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with odd texts, extra columns whose names clash with those that operators use, and labels."""
    rows = [(k, x, "en" if k % 2 else "fr", f"s{k % 3}", len(x or ""), "n", 1.5, [k]) for k, x in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double, keys array<long>").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
