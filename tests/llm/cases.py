"""Small document tables with the awkward cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pid int, row long, token string, cls string, k long"


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); the other columns clash with names used inside."""
    full = [(*r, *[None] * (4 - len(r)), 0, 7, 7, "x", "y", 9) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(rng.randint(0, 40)) for _ in range(words))


AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three four five six"), (6, "One  TWO three\nfour five six"), (7, "!?."), (8, "é ñ 日本語 🙂 'tis don't we'll"),
    (8, "é ñ 日本語 🙂 'tis don't we'll"), (None, "no id here"), (9, "a" * 5000), (10, "x<|endoftext|>y <|startoftext|>"), (11, "tab\tline\vfeed\fend\r\n"), (12, "\x1c\x1d    z"),
]
