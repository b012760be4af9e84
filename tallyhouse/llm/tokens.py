"""Token ids of whole texts by a word-level vocabulary, with a bounded memory of known chunks.

The vocabulary drops white space and never joins characters across it, so the ids of a text
are the ids of its chunks between white space, one after the other. Chunks repeat; each is
encoded once per worker while it is remembered. A text with one of the few characters that the
two libraries do not agree on as white space is encoded whole.
"""

from __future__ import annotations

import re
from itertools import islice
from unicodedata import normalize

import numpy as np

#: The separators U+001C to U+001F are white space to ``str.split`` but not to the vocabulary.
_ODD = re.compile("[\x1c-\x1f]")
_GAP = re.compile(r"\s")
#: Letters and the ASCII punctuation after them are encoded apart by the vocabulary's own rule.
_TAIL = re.compile(r"([^\W\d_]+)([!-&(-/:;=-@\[-`{-~]+)")
_SLICE = 1_000_000
_MEMORY = 700_000


class ChunkEncoder:
    """Encodes lists of texts and remembers about ``memory`` chunks."""

    def __init__(self, path: str, memory: int = _MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.closing[number] = token.endswith("</w>")
        self.memory = memory
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, "<u4").tobytes()
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that the vocabulary does not part further, from one encoding of all.

        Each such word ends with the only token that marks the end of a word.
        """
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.closing[ids]) + 1)).tolist()
        if len(ends) != len(words):  # a letter that becomes two characters in lower case
            return self._encode(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, chunks: set[str]) -> None:
        known, words, rest, parted = self.known, set(), [], []
        for chunk in chunks:
            if chunk.isalpha():
                words.add(chunk)
            elif (m := _TAIL.fullmatch(chunk)) and _stays_letters(m[1]):
                parted.append((chunk, m[1], m[2]))
            else:
                rest.append(chunk)
        words.update(x for pair in parted for x in pair[1:] if x not in known)
        words = list(words)
        known.update(zip(words, self._encode_words(words)))
        known.update(zip(rest, self._encode(rest)))
        known.update((chunk, known[word] + known[tail]) for chunk, word, tail in parted)

    def _slices(self, text: str):
        at = 0
        while len(text) - at > _SLICE:
            gap = _GAP.search(text, at + _SLICE)
            end = gap.start() if gap else len(text)
            yield text[at:end]
            at = end
        yield text[at:]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of a few texts; what none of them has shown before is encoded in one go."""
        if len(self.known) > self.memory:
            # the older half goes; it is learnt again when it is met
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
        # the vocabulary lower-cases; doing it before makes fewer different chunks
        parts = [(text.lower() if _is_latin(text) else text).split() for text in texts]
        self._learn(set().union(*parts).difference(self.known))
        get = self.known.get
        return [b"".join(map(get, chunks)) for chunks in parts]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for text in texts:
            if len(text) > _SLICE or _ODD.search(text):
                out += self._joined(group)
                group, size = [], 0
                if _ODD.search(text):
                    out += self._encode([text])
                else:
                    out.append(b"".join(self._joined([part])[0] for part in self._slices(text)))
                continue
            group.append(text)
            size += len(text)
            if size > _SLICE:
                out += self._joined(group)
                group, size = [], 0
        return out + self._joined(group)


def _stays_letters(word: str) -> bool:
    """Whether letters are still letters in the vocabulary's normal form.

    A letter such as İ ends in a mark there, and marks and punctuation are encoded together.
    """
    return word.isascii() or (word.isalpha() and normalize("NFC", word.lower()).isalpha())


def _is_latin(text: str) -> bool:
    """Whether lower case is a matter of single characters, the same in every library."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
