import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (id, text) as a documents table, in a few partitions."""

    def make(rows, extra=False):
        data = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(data, DOCS)
        if extra:
            for name in ("node", "root", "row", "key", "score", "kept", "id", "h", "n", "task", "closed", "held_out"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df.repartition(3) if rows else df

    return make


def prose(n, seed=0, size=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(size)]
    return " ".join(rng.choice(words) for _ in range(n))


#: Ids and texts that every operator must bear: nulls, empty, blank, one word, ties, repeats, very long.
ODD = [
    (None, "a text without an id"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, prose(120, 1)), (5, prose(120, 1)), (6, prose(120, 1)),
    (7, prose(30_000, 2)), (8, "ñandú über \U0001f600 'quoted' don't\r\nend"), (None, None),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD, extra=True)
