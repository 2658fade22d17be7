import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int, n: int) -> list[str | None]:
    """Random texts with copies, near copies, shared passages, repeated lines, odd white space, and nulls."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeéß", k=rnd.randint(1, 6))) for _ in range(300)]
    line = lambda: " ".join(rnd.choices(words, k=rnd.randint(1, 30)))
    passage = " ".join(rnd.choices(words, k=60))
    out: list[str | None] = [None, "", " \n\t ", "one", "A b\x0bC", "x\n\nx\n"]
    while len(out) < n:
        kind = rnd.randrange(7)
        full = [t for t in out if t and len(t) > 40]
        if kind == 0 and full:
            out.append(rnd.choice(full))
        elif kind == 1 and full:
            parts = rnd.choice(full).split(" ")
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
            out.append(" ".join(parts))
        elif kind == 2:
            out.append(f"{line()}\n{passage} {line()}")
        elif kind == 3:
            one = line()
            out.append("\n".join([one, line(), one, "  " + one.replace(" ", "\t", 1)]))
        elif kind == 4:
            out.append(" ".join([passage] * 2))
        else:
            out.append("\n".join(line() for _ in range(rnd.randint(1, 8))))
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="session")
def corpus():
    return [(i, t) for i, t in enumerate(texts(1, 250))]


def frame(spark, rows, clash: bool = False):
    """Documents, and with `clash` columns whose names operators use inside."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(7) for c in ("id", "key", "runs", "items", "score", "held_out", "n_words", "n_lines", "line", "fp", "first", "length", "own0", "contaminated")})
    return df


def found(df, key: str = "doc_id") -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
