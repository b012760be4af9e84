"""Benchmark passages in documents, found by one Aho-Corasick automaton over the test items.

A contaminating window is 13 consecutive words of an item. Of every item the automaton holds
the word blocks at positions 0, 7, 14 ... of seven words: any 13 words in a row contain one of
them whole. It therefore has about one node per character of the benchmark, not 13 times as
many. Each text is normalised and scanned once; where a block is found, the match is extended
word by word in both directions, and a run of 13 words or more makes all its words hits. Items
of fewer than 13 words are one window and are held whole.

The items are shipped to the tasks in automata of at most ``BLOCK_BYTES`` of normalised text;
a larger benchmark takes several passes over the documents, each carrying what was found. The
documents are never shuffled.

Defined cases. Null texts have no words and no hits. Null and empty items have no window. Equal
items are found under each of their ids; a null item_id is listed as an empty string. Repeated
documents are judged each on its own. Extra columns pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, scanned, written

WINDOW = 13
#: Normalised item text in one automaton: some 60 bytes of memory for each byte of it.
BLOCK_BYTES = 4_000_000
_SLICE = 200_000
# words are digits, letters and every non-ASCII character; A-Z become a-z
_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in b"0123456789" + LOWER.encode():
    _TABLE[_c] = _c
for _a, _b in zip(UPPER.encode(), LOWER.encode()):
    _TABLE[_a] = _b
_TABLE = bytes(_TABLE)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Matcher:
    """Automaton over items, given as (item_id, text)."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        import ahocorasick

        self.window = window
        self.step = (window + 1) // 2
        self.ids: list[str] = []
        self.items: list[list[bytes]] = []
        self.places: list[list[tuple[int, int, int]]] = []  # by key: (item, position, words)
        self.longest = 1
        known: dict[str, int] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            number = len(self.items)
            self.ids.append(item_id)
            self.items.append(words)
            if len(words) < window:
                blocks = [(0, len(words))]
            else:
                blocks = [(p, self.step) for p in range(0, len(words) - self.step + 1, self.step)]
            for p, size in blocks:
                key = self._text(words[p : p + size])
                at = known.setdefault(key, len(self.places))
                if at == len(self.places):
                    self.places.append([])
                self.places[at].append((number, p, size))
                self.longest = max(self.longest, size)
        self.automaton = ahocorasick.Automaton()
        for key, at in known.items():
            self.automaton.add_word(key, at)
        self.automaton.make_automaton()

    @staticmethod
    def _text(words: list[bytes]) -> str:
        # one character per byte; the blanks around it keep matches on whole words
        return " " + b" ".join(words).decode("latin-1") + " "

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans [first, end) that are hit, and the ids of the items."""
        if not self.places:
            return [], set()
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        reached: dict[tuple[int, int], int] = {}  # (item, diagonal): end of the last run
        for base in range(0, max(len(words), 1), _SLICE):
            part = words[base : base + _SLICE + self.longest - 1]
            text = self._text(part)
            seen, blanks = 0, 0
            for end, at in self.automaton.iter(text):
                blanks += text.count(" ", seen, end)
                seen = end
                for number, p, size in self.places[at]:
                    d = base + blanks - size  # first word of the match
                    item = self.items[number]
                    diagonal = (number, d - p)
                    if reached.get(diagonal, -1) >= d + size:
                        continue
                    if len(item) < self.window:
                        first, last = d, d + size
                    else:
                        first, q = d, p
                        while q and first and item[q - 1] == words[first - 1]:
                            first, q = first - 1, q - 1
                        last, q = d + size, p + size
                        while q < len(item) and last < len(words) and item[q] == words[last]:
                            last, q = last + 1, q + 1
                    reached[diagonal] = last
                    if last - first >= self.window or len(item) < self.window:
                        spans.append((first, last))
                        found.add(self.ids[number])
        return merge(spans), found


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def original(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans in the original text of word spans of the normalised one."""
    import re

    wanted = {w for first, last in spans for w in (first, last - 1)}
    place: dict[int, tuple[int, int]] = {}
    for n, m in enumerate(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)):
        if n in wanted:
            place[n] = m.span()
    return [(place[first][0], place[last - 1][1]) for first, last in spans]


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, items, window: int) -> Matcher:
    """One automaton per Python worker, kept for its next tasks; an older one is let go."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items.value, window)
    return _MATCHERS[key]


FIELDS = "n_words long, word_spans array<struct<first:long,last:long>>, char_spans array<struct<first:long,last:long>>, items array<string>"


def _pass(docs: DataFrame, items: list[tuple[str, str]], window: int, with_text: bool) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(items)
    key = f"{hashlib.sha256(repr(items).encode()).hexdigest()}-{window}"

    def make():
        matcher = _matcher(key, shipped, window)

        def scan(texts):
            out = ([], [], [], [])
            for text in texts:
                words = words_of(text)
                spans, ids = matcher.find(words)
                values = (len(words), spans, original(text, spans) if spans else [], sorted(ids))
                for column, value in zip(out, values):
                    column.append(value)
            n, spans, chars, ids = out
            pairs = lambda rows: [[{"first": a, "last": b} for a, b in row] for row in rows]
            return [n, pairs(spans), pairs(chars), ids]

        return scan

    return scanned(docs, make, FIELDS, with_text)


def block_count(benchmark: DataFrame, block_bytes: int) -> int:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // block_bytes))


def block_items(benchmark: DataFrame, k: int, blocks: int) -> list[tuple[str, str]]:
    """The items of block ``k``: those of one automaton, so their size is bound."""
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")
    if blocks > 1:
        items = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
    return sorted((r[0], r[1]) for r in items.collect())


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """``row`` (the input row without its text) with n_words, the spans hit, the item ids found and n_hit."""
    blocks = block_count(benchmark, block_bytes)
    spans = ("word_spans", "char_spans", "items")
    df = docs
    for k in range(blocks):
        last = k == blocks - 1
        df = _pass(df, block_items(benchmark, k, blocks), window, with_text or not last)
        if k:  # the row of this pass holds the row and the finds of those before it
            df = df.select(
                F.col("row.row").alias("row"),
                *(["text"] if "text" in df.columns else []),
                "n_words",
                *[F.concat(f"row.{c}", c).alias(c) for c in spans],
            )
        if not last:
            df = written(df.drop("n_words"), "benchmark-pass")

    def cover(done, span):
        first = F.greatest(span["first"], done["end"])
        more = F.greatest(span["last"] - first, F.lit(0))
        return F.struct(F.greatest(span["last"], done["end"]).alias("end"), (done["n"] + more).alias("n"))

    nothing = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    n_hit = F.aggregate(F.sort_array("word_spans"), nothing, cover, lambda done: done["n"])
    return df.withColumns({"n_hit": n_hit, "items": F.array_sort(F.array_distinct("items"))})


def contaminated(percent: int = 5):
    """Verdict on a row of :func:`hits`: at least this share of its words is hit."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
