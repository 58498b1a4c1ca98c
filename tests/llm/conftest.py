import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SYLLABLES = "ta ri mo len ske vu pra ni do shu wel bor qi fen zat".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Ids and texts: prose, exact and near copies, shared passages, nulls, empties, repeats, one long text, odd characters."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(3, 120)) for _ in range(40)]
    passage = words(rng, 60)
    rows: list[tuple[int | None, str | None]] = [(10 + k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[k]) for k in range(6)]
    for k in range(6):
        w = base[20 + k].split()
        w[len(w) // 2 : len(w) // 2 + 1] = ["changed"]
        rows.append((120 + k, " ".join(w)))
    rows += [(200 + k, words(rng, 20) + " " + passage[k * 7 :] + " " + words(rng, 20)) for k in range(8)]
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "x"), (304, "1234 !!"), (None, base[0]), (None, "a null id"), (10, base[0]), (10, base[0])]
    rows += [(400, words(rng, 30_000)), (401, "é ü ñ 漢字 \U0001f600 " * 30), (402, "a" * 5000), (403, "ab" * 3000), (404, "a" * 4000)]
    return rows


@pytest.fixture
def docs(spark, texts):
    """The texts with the other columns of documents, and some that clash with the operators' own names."""
    rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}", None if t is None else len(t), k, "x", k, 1.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uid long, row string, start long, size double").repartition(3)


@pytest.fixture
def none(docs):
    return docs.limit(0)
