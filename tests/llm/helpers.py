"""Rows that every operator must bear: nulls, empty texts, ties, repeats, long texts, extra columns."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, item bigint, _n int"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(12)]
    out: list[str | None] = [None, "", " \n\t ", "one", "Two words", "ünï çödé 日本語 🙂\n\nx"]
    for b in base:
        words = b.split()
        out += [b, b, b.upper()]
        for k in (1, 3, 8):
            w = list(words)
            for _ in range(k):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            out.append(" ".join(w))
        out.append(" ".join(words[: len(words) // 2]) + "\n" + base[0])
    out += ["\n".join([base[1], base[2], "", base[3]]), "\n".join([base[3], base[1] + " x"]), "Und " * 300, "a b " * 200, sentence(rng, 4000)]
    return out


def documents(spark, seed: int = 1, repeat: bool = False, null_id: bool = False):
    rows = [(i, t, "en", "s", len(t or ""), "k", 1, 2) for i, t in enumerate(texts(seed))]
    if repeat:
        rows += rows[5:12]
    if null_id:
        rows += [(None, "a text without an id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns: str) -> dict:
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
