"""Small tables with everything that operators must stand."""

import random

EXTRA = "id string, version string, row string, spans string, score string, label string, ranges string, block string, n string, cls string, pos string, kept string, vector string"
SCHEMA = f"doc_id int, text string, n_chars bigint, {EXTRA}"
NAMES = [part.split()[0] for part in EXTRA.split(", ")]

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(60)]


def prose(count: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(count))


SHARED = [prose(12) for _ in range(4)] + [prose(90)]


def texts() -> list[str | None]:
    """Nulls, empty and blank texts, repeats, near copies, shared lines and passages, and one long text."""
    out: list[str | None] = [None, "", "   ", "\n\n", "one two", "one  TWO", prose(3)]
    for _ in range(40):
        lines = [rng.choice([prose(rng.randint(1, 25)), rng.choice(SHARED), "  " + rng.choice(SHARED).upper()]) for _ in range(rng.randint(1, 6))]
        out.append("\n".join(lines))
    whole = prose(80)
    out += [whole, whole, whole.upper(), whole + " tail", "head " + whole, whole.replace(" ", "\t", 20)]
    out.append("\n".join(prose(30) for _ in range(400)))
    return out


def documents(spark, rows: list[str | None] | None = None, ids: list | None = None):
    """The rows as documents with extra columns whose names clash with those inside operators."""
    rows = texts() if rows is None else rows
    ids = list(range(len(rows))) if ids is None else ids
    data = [(i, t, None if t is None else len(t), *[f"own {name}" for name in NAMES]) for i, t in zip(ids, rows, strict=True)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def awkward(spark):
    """Null ids, a repeated row and an id with two texts."""
    shared = SHARED[4]
    return documents(spark, [None, shared, shared, prose(30), shared + " " + prose(2)], [None, None, 7, 7, 7]).unionAll(documents(spark, [shared], [7]))
