import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, h long"


def prose(rng, n, syllables=("ta", "ri", "mo", "ve", "lu", "ne", "so", "ka")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, empties and columns of clashing names."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(25, 140)) for _ in range(30)]
    passage = prose(rng, 60)
    texts = list(base)
    for t in base[:8]:
        words = t.split()
        texts.append(t)  # exact copy
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))  # near copy
        texts.append("Before. " + passage + "\n" + t)
    texts += [None, "", "   \n\t ", "one", "one two three", "same same same " * 30, passage + " " + passage, "Word " * 5000]
    rows = [(i * 3, t, rng.choice(["en", "de", None]), "s", len(t or ""), "x", 1) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, base[0], "en", "s", 1, "x", 1))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
