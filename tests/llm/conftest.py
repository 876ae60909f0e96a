"""Tables with nulls, empty and very long texts, ties, repeated rows, hot groups and clashing column names."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _slot int, _gone string, _copies int, kept string, size string, _Copy int"


def words(rng: random.Random, n: int, pool: int = 400) -> str:
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def tricky_rows() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source), all awkward cases at once."""
    rng = random.Random(5)
    hot, shared = words(rng, 60), words(rng, 80)
    rows: list[tuple[int | None, str | None, str | None]] = [
        (1, "alpha beta gamma delta epsilon zeta", "a"),
        (2, "alpha  beta\tgamma delta\nepsilon zeta", "a"),
        (3, None, None),
        (4, "", "b"),
        (5, " \t\r\n\x0b\x0c ", "b"),
        (6, "one", ""),
        (7, "ONE", None),
        (8, "Grüße, ſtraße K ÀÉ 漢字 😀 naïve space  wide", "c"),
        (None, "a null id has a text of its own", "c"),
        (None, None, None),
        (9, words(rng, 60_000, 20_000), "long"),
        (10, "x" * 200_000, "long"),
        (11, hot, "hot"),
        (11, hot, "hot"),
    ]
    rows += [(100 + i, hot, "hot") for i in range(150)]
    rows += [(300 + i, f"{words(rng, 40)} {shared} {words(rng, 40)}", "mid") for i in range(30)]
    base = words(rng, 120).split()
    for i in range(40):  # near copies in a chain
        base = [*base]
        base[rng.randrange(120)] = f"new{i}"
        rows.append((400 + i, " ".join(base), "near"))
    rows += [(500 + i, words(rng, rng.randrange(0, 40)), rng.choice(["a", "b", None])) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def tricky():
    return tricky_rows()


@pytest.fixture(scope="session")
def tricky_docs(spark, tricky):
    rows = [(i, t, "en", s, len(t or ""), 1, "g", 2, "k", "s", 3) for i, t, s in tricky]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    return list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))


SF = "/root/testdata/sf0.01"
