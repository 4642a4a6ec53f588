"""Documents with the hard cases: nulls, empty and long texts, copies, repeated rows, other columns."""

from __future__ import annotations

import random

import pytest

#: Names that the operators use themselves, or add.
CLASHES = "th fp id label key row score lang_pred held_out _th _id _lines _kept _null _text_hash _letters _bytes _key _n_lines n_lines keep lines letters own_id own_th bucket position may hits items near h y size predicted".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    base = words(1, 400)
    out = [None, "", "   ", "12 34 !!", "word", base, base, base.replace("a", "A"), base + " tail", words(2, 30_000)]
    out += [" ".join(base.split()[:k] + ["changed"] + base.split()[k + 1 :]) for k in range(0, 400, 25)]
    out += [words(s, 60) + "\nshared line\n  Shared LINE \n\n" + words(s + 100, 5) for s in range(10, 32)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    n = len(CLASHES)
    rows = [(i, t, "xy"[i % 2] if t else None, f"s{i % 3}", len(t or ""), *[f"{c} {i}" for c in CLASHES]) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "a null id", "x", None, None, *[None] * n), (None, None, None, None, None, *[None] * n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
