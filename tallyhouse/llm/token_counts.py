"""Token counts per section from one encoding of the whole document.

A document is encoded once, so a token never changes because of how the text is cut. The byte
lengths of the tokens give their spans, these give character spans, and an interval join against
the sections' starts says which section a token belongs to. A token that crosses a boundary goes,
by the chosen rule, to the section of its first character (``start``), of its last (``end``), or to
the one with most of its characters (``majority``; of equals the earliest). The counts of a
document's sections therefore always add up to the tokens of the document.

Texts pass once, in Arrow batches and without a shuffle.

Defined cases. Null and empty texts have one empty section without tokens. A token that holds a
part of a character spans that whole character. Repeated rows are counted each on its own. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scanned

RULES = ("start", "majority", "end")
#: A section ends after the white space that follows a full stop, question or exclamation mark.
SENTENCE = re.compile(r"[.!?]+\s+")
_PARTS = "array<struct<section:long,first_char:long,n_chars:long,n_tokens:long,n_crossing:long>>"


def sentence_starts(text: str) -> np.ndarray:
    """First character of each sentence."""
    ends = [m.end() for m in SENTENCE.finditer(text)]
    return np.array([0, *[e for e in ends if e < len(text)]], np.int64)


class SpanEncoder:
    """Token ids and byte lengths under a byte-level vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token."""
        ends = np.cumsum(self.sizes[np.array(self.encoding.encode_ordinary(text), np.int64)])
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        if text.isascii() or not len(ends):
            return starts, ends
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        at = np.cumsum((raw & 0xC0) != 0x80) - 1  # character that each byte belongs to
        return at[starts], at[ends - 1] + 1


def attributed(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token and whether the token crosses a boundary; ``sections`` are sorted starts."""
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    crosses = first != last
    if rule == "start":
        return first, crosses
    if rule == "end":
        return last, crosses
    home = first.copy()
    two = crosses & (last == first + 1)
    cut = sections[last[two]]
    home[two] = np.where(ends[two] - cut > cut - starts[two], last[two], first[two])
    for k in np.flatnonzero(crosses & ~two):
        inner = sections[first[k] : last[k] + 1]
        edges = np.concatenate(([starts[k]], inner[1:], [ends[k]]))
        home[k] = first[k] + int(np.argmax(np.diff(edges)))
    return home, crosses


def section_counts(docs: DataFrame, vocabulary: str, pattern: str, rule: str = "majority", cut=sentence_starts) -> DataFrame:
    """doc_id, section, first_char, n_chars, n_tokens and n_crossing of every section.

    ``cut`` gives the sorted starts of a text's sections, the first at 0.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def make():
        encoder = _encoder(vocabulary, pattern)

        def count(texts):
            columns, offsets = [[] for _ in range(5)], [0]
            for text in texts:
                text = text or ""
                sections = cut(text)
                home, crosses = attributed(*encoder.spans(text), sections, rule)
                n = len(sections)
                values = (
                    np.arange(n),
                    sections,
                    np.diff(np.append(sections, len(text))),
                    np.bincount(home, minlength=n),
                    np.bincount(home[crosses], minlength=n),
                )
                for column, value in zip(columns, values):
                    column.append(value)
                offsets.append(offsets[-1] + n)
            flat = [pa.array(np.concatenate(c).astype(np.int64)) if c else pa.array([], pa.int64()) for c in columns]
            names = ["section", "first_char", "n_chars", "n_tokens", "n_crossing"]
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, names))]

        return count

    df = scanned(docs.select("doc_id", "text"), make, f"parts {_PARTS}")
    return df.select("row.doc_id", F.explode("parts").alias("p")).select("doc_id", "p.*")


_ENCODERS: dict[tuple[str, str], SpanEncoder] = {}


def _encoder(path: str, pattern: str) -> SpanEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = SpanEncoder(path, pattern)
    return _ENCODERS[path, pattern]
