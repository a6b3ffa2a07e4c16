import random

import pytest

#: Texts with every odd case: null, empty, blank, one word, repeats, ties, signs beyond ASCII, one very long word.
ODD = [None, "", "  \n\t", "word", "word", "Ünïcödé 字 😀 wörds ", "x" * 5000, "a b c d e f g h i j k l m n o p", "A B C D E F G H I J K L M N O P", "\n\n\n"]


def texts(n=120, seed=3):
    """Texts of a small vocabulary with shared passages, near copies and exact copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(80)]
    passage = " ".join(rng.choices(words, k=40))
    out = list(ODD)
    for i in range(n):
        own = rng.choices(words, k=rng.randint(1, 90))
        if i % 4 == 0:
            own[len(own) // 2 : len(own) // 2] = [passage]
        text = " ".join(own)
        if i % 5 == 0 and i:
            text = out[-1] or text
        elif i % 7 == 0 and i and out[-1]:
            near = out[-1].split(" ")
            near[rng.randrange(len(near))] = "changed"
            text = " ".join(near)
        out.append(text.replace(" ", "\n", 1) if i % 3 == 0 else text)
    return out


@pytest.fixture(scope="session")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The texts with columns whose names clash with the operators' own, a repeated row and a row without doc_id."""
    data = [(i, t, "k", 1, True) for i, t in rows] + [(rows[-1][0], rows[-1][1], "k", 1, True), (None, "no id here", None, None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, row_key string, runs int, kept boolean").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
