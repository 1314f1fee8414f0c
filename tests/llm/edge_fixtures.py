import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed: int, n: int) -> str:
    """n words that depend on the seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


LONG = " ".join(f"w{i % 997}x{i % 61}" for i in range(40_000))

EDGE_TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, LONG), (7, LONG + " tail"), (8, sentence(8, 60)), (8, sentence(8, 60)),
    (9, sentence(8, 60).upper()), (10, sentence(10, 80)), (11, sentence(10, 79) + " changed"), (12, "ÀÉÎ ñandú 日本語 \U0001f600   x"), (None, sentence(13, 30)), (14, sentence(8, 60)),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", None if k % 2 else "s", len(t) if t else None, k, 0.5, "x") for k, (i, t) in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int, score double, cluster string").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)
