"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, token long, n long, lab long, class int, kept boolean, id long, _h long"


def prose(rng, n, start=0):
    return " ".join(f"w{rng.randrange(start, start + 400)}" for _ in range(n))


def make():
    rng = random.Random(7)
    base = prose(rng, 120)
    words = base.split()
    near = words.copy()
    near[60] = "changed"
    far = words.copy()
    for i in range(0, 120, 6):
        far[i] = f"x{i}"
    passage = prose(rng, 70, 1000)
    rows = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, " ".join(near), "en", "b"), (4, " ".join(far), "en", "b"),
        (5, prose(rng, 30, 2000) + "\n" + passage + "\n" + prose(rng, 20, 3000), "de", "c"), (6, prose(rng, 50, 4000) + " " + passage, "de", "c"),
        (7, None, "en", "a"), (8, "", "en", "a"), (9, " \n\t ", None, None), (10, "two words", "fr", None), (11, "two  Words", "fr", "d"),
        (12, prose(rng, 9000, 5000), "es", "d"), (13, "É" * 5000 + " ß " + "naïve façade " * 30, "fr", "d"), (None, "a row without an id, ten words or more in all", "en", "a"),
        (20, "same row", "en", "e"), (20, "same row", "en", "e"), (21, "a b c d e f a b c d e f", "en", "e"), (22, "1 2 3 4 5", "en", "a"),
    ]
    rows += [(100 + i, prose(rng, 60 + i, 10_000 * (i + 1)), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(20)]
    return [(i, t, lang, s, len(t or ""), 1, 2, 3, 4, 5, True, 6, 7) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return make()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    docs.limit(0).write.parquet(path)
    return docs.sparkSession.read.parquet(path)
