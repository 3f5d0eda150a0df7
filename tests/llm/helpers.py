"""Rows that operators must cope with: nulls, empty and long texts, ties, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, h string, k string, node long, s string, t string"


def prose(seed: int, words: int, letters: str = "abcdefghij") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(words))


def odd_rows() -> list[tuple]:
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, prose(1, 200)), (7, prose(1, 200)), (8, prose(1, 199) + " changed")]
    texts += [(8, prose(1, 199) + " changed"), (None, prose(2, 50)), (None, None), (9, prose(3, 30_000)), (10, prose(4, 60)), (11, "ÀÉ 日本 🙂 Ünïcode tëxt hérè"), (12, "123 456")]
    return [(i, t, "en" if n % 2 else None, f"src{n % 3}" if n % 4 else None, 0, "x", "x", "x", n, "x", "x") for n, (i, t) in enumerate(texts)]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def key(row):
    return tuple((x is not None, x) if not isinstance(x, float) else (True, round(x, 9)) for x in row)


def rows_of(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=key)
