import random

import pytest

#: documents with columns whose names the operators use inside, too
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, score string, fp string, component_id string, w string, h string, item string, first string, g long, root long"


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(n))


def row(i, text, lang="en"):
    return (i, text, lang, "src0", None if text is None else len(text), "x", "y", "z", "c", "w", "h", "i", "f", 1, 2)


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, shared passages."""
    base, passage, long = sentence(1, 120), sentence(2, 70), sentence(3, 6000)
    rows = [row(10, base), row(11, base), row(12, base.upper()), row(12, base), row(12, base)]  # copies, an id twice, a row twice
    rows += [row(None, base), row(None, None), row(20, None, None), row(21, ""), row(22, " \t\n "), row(23, "one"), row(24, "one two three")]
    rows += [row(30, sentence(4, 30) + " " + passage + " " + sentence(5, 30)), row(31, sentence(6, 10) + "\n" + passage), row(29, passage + "\t" + sentence(7, 40)), row(28, passage)]
    rows += [row(40, long), row(41, long + " tail"), row(42, sentence(8, 20) + " " + long)]
    rows += [row(50, "the " * 200), row(51, "the " * 220), row(52, "é ß   　 \u0085 😀 " * 40), row(53, "é ß   　 \u0085 😀 " * 40)]
    words = base.split()
    for k in range(60, 90):  # near copies
        r = random.Random(k)
        w = list(words)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = sentence(k * 7, 1)
        rows.append(row(k, " ".join(w)))
    rows += [row(-5, passage + " " + sentence(9, 5)), row(100, sentence(10, 49)), row(101, sentence(10, 49)), row(102, sentence(11, 50)), row(103, sentence(11, 50))]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pairs():
    """(doc_id, text) of the odd rows."""
    return [(r[0], r[1]) for r in odd_rows()]
