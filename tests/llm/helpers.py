"""Plain reference versions and small tables for the tests of the operators."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def docs(spark, texts, **extra):
    """A documents table with more columns than needed, some with clashing names; ids from 0."""
    rows = [(i, t, None, f"s{i % 3}", len(t or ""), i, "x") for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score bigint, checks string"
    return spark.createDataFrame(rows, schema)


ODD_TEXTS = [None, "", " ", "!!!", "a", "A a A", "é", "x" * 5000, "word " * 3000, "x\u0000y", "Ünï çödé \U0001f600 z", "same text here", "same text here"]
