import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, size int, doc string, node long, _size int, drop string"


def rows(seed=0):
    """Small documents with copies, edits, shared lines and passages, gaps, and names that clash with inner ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7))) for _ in range(120)] + ["The", "of", "and", "DER", "le"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", ","]) for _ in range(n))
    line, passage = "  Shared LINE of more than twenty letters \t", text(30)
    base = text(120)
    texts = [None, "", " ", "\n\n", "one", "Two words", line, text(2500), "a b c " * 400, "#$% & | <>" * 20, base, base, base.upper(), "x\n" + base]
    for k in range(25):
        w = base.split(" ")
        for _ in range(k % 7):
            w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    for _ in range(20):
        texts.append("\n".join([text(r.randint(1, 60)), line, passage, text(r.randint(1, 60)), line.lower()][: r.randint(1, 5)]))
    out = []
    for i, t in enumerate(texts):
        out.append((i * 3 + 1, t, r.choice(["en", "de", None]), r.choice(["b", "a", "Z", "", None]), len(t or ""), "x", 7, "y", 9, 3, "z"))
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def pairs():
    return [(x[0], x[1]) for x in rows()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
