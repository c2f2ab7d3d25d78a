import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, h long, digest string, rep long"


def _texts() -> list[tuple[int | None, str | None]]:
    rnd = random.Random(7)
    words = [f"{a}{b}" for a in ("al", "be", "ga", "de", "ep", "ze") for b in ("pha", "ta", "mma", "lta", "silon", "é", "漢", "X")]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = prose(120), prose(60)
    edited = base.split()
    edited[60] = "changed"
    rows = [
        (1, base), (2, base), (3, base.replace(" ", "\n\t ")), (4, " ".join(edited)), (5, base.upper()),
        (6, None), (7, ""), (8, " \n\t"), (9, "one two"), (10, "One two"), (11, " \x1c x"),
        (12, prose(30) + " " + passage + " " + prose(30)), (13, prose(40) + " " + passage), (14, passage + " " + prose(49)),
        (15, prose(6000)), (16, "x" * 70000), (17, " " * 5000 + "a"), (18, "<|endoftext|> </s> <s>[INST] ok [/INST] <0x41> ▁ 😀\x00"),
        (None, base), (None, None), (19, prose(20)), (19, prose(20)),
    ]
    for k in range(20, 60):
        w = base.split() if k % 2 else prose(90).split()
        for _ in range(rnd.randint(0, 8)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((k, " ".join(w)))
    rows += rows[:2]  # rows that repeat whole
    return rows


@pytest.fixture(scope="session")
def rows():
    return _texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Hard rows, with columns named as the operators name theirs."""
    return spark.createDataFrame([(i, t, "en", None, None, "w", 0, "d", 0) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path
