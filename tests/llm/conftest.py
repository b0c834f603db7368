import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"
CLASHING = "part int, key string, rep long, n long, score double, tile int, words string, rate double, anchor long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    """(rows, frame): copies, near copies, shared passages, nulls, empty and long texts; columns with clashing names."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    base = [" ".join(word() + rng.choice(["", "", ",", ".\n"]) for _ in range(rng.randint(8, 160))) for _ in range(40)]
    texts = base + [base[0]] * 5 + [b.upper() for b in base[:3]]
    for b in base[:20]:
        own = b.split(" ")
        for changes in (1, 4, 12):
            new = list(own)
            for _ in range(changes):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
    texts += [f"{b} {passage} {word()}" for b in base[20:35]] + ["ab" * 300, "x" * 450, "a b c", "a b c", "", None, " \n\t ", "é" * 130]
    texts += [" ".join(word() for _ in range(20_000)), "tab\tand  two spaces \x1c <|endoftext|> end", "▁ odd  <0x0A> 🙂🙂 日本語"]
    rng.shuffle(texts)
    rows = [(3 * n + 1, t) for n, t in enumerate(texts)]
    more = (1, "k", 2, 3, 0.5, 4, "w", 0.25, 7)
    return rows, spark.createDataFrame([(*r, *more) for r in rows], f"doc_id long, text string, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {CLASHING}")
