from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (doc_id, text) pairs, over several partitions."""

    def make(items, parts: int = 3, lang="en", source="s", schema=SCHEMA):
        rows = []
        for k, item in enumerate(items):
            doc_id, text = item if isinstance(item, tuple) else (k, item)
            rows.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make


#: Nulls, empty and blank texts, a very long one, ties, repeats and odd characters.
ODD_TEXTS = [
    None,
    "",
    "   \n\t\n",
    "\n\n\n",
    "one",
    "One TWO",
    "É é ÀB x  y",
    "a\x1cb \x1d c",
    "tie tie tie tie",
    "tie tie tie tie",
    "word " * 30_000,
    "x" * 100_000,
    "Same long line that is more than forty characters wide, yes.\n" * 3,
    "emoji 😀 and combining é ̸ signs",
    "<|endoftext|> inside<|endoftext|>text",
    "line one\r\nline two\x0bline three\x0cend.",
]
