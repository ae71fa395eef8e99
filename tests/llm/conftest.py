import random

import pytest

SYLLABLES = ["an", "ber", "co", "da", "el", "fri", "go", "hu", "ist", "jo", "ka", "lo", "mü", "né"]


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with exact and near copies, blank, null and very long ones, repeated lines, and one hot text."""
    rng = random.Random(5)
    base = ["\n".join(sentence(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    out = list(base)
    out += [base[3].upper(), base[3], base[7]] + [base[9]] * 40
    for t in base[:20]:
        words = t.split(" ")
        words[len(words) // 2] = "zz"
        out.append(" ".join(words))
    out += [None, "", " ", "\n\n", "one", "one two", "\t\x0b\x0c\r ", sentence(rng, 6000), "é ü 漢字 text " * 30, "x" * 5000, "a\x00b \U0001f600"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Those texts, with extra columns whose names clash with the operators' own."""
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", None if t is None else len(t), "x", i % 5) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, shard int"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
