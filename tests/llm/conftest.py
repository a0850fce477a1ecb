import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(seed: int = 0, n: int = 120) -> list[tuple]:
    """Texts of few words, with exact and near copies, shared passages, nulls, empty, odd and long texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows, texts = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 160))]
        if i % 7 == 3:
            words[len(words) // 2 : len(words) // 2] = passage
        text = " ".join(w + (".\n" if rng.random() < 0.05 else "") for w in words)
        if i % 11 == 5:
            text = rng.choice(texts)
        if i % 13 == 6:
            words = rng.choice([t for t in texts if len(t.split()) > 100] or texts).split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        texts.append(text)
        rows.append((i, text, rng.choice(["en", "de"]), f"s{i % 3}", len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, " \n\t ", "en", "s", 4), (n + 3, "Ünï ©ode x \x0b y", "de", "s", 9), (n + 4, "word " * 3000, "en", "s", 15000)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
