from __future__ import annotations

import pytest

#: Nulls, empty, long, tied and repeated rows; extra columns with names that the operators use inside.
LONG = "lorem ipsum " * 40_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog " * 8, "en", "src0"),
    (1, "the quick brown fox jumps over the lazy dog " * 8, "en", "src0"),
    (2, None, None, None),
    (None, "ein kleiner text über nichts", "de", None),
    (None, None, None, "src1"),
    (3, "", "en", "src12"),
    (4, "   \t\n", "fr", "src99"),
    (5, LONG, "es", "src0"),
    (6, "日本語のテキスト 🙂 é", None, "srcx"),
    (7, "x", "de", "src12"),
    (-8, "a" * 200_000, "en", "src3"),
]
EXTRA = ["key", "fp", "u", "v", "pid", "digest", "doc", "row", "first", "at", "size", "shard", "cut", "mix", "n", "item_id", "quality", "predicted", "tokens", "rest", "one", "node", "root"]


@pytest.fixture(scope="session")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, None, *EXTRA) for r in ROWS], schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
