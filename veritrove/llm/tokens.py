"""Word-level caching around the public tokenizers library, and the end id.

A text is split as the tokenizer's own pre-tokenizer splits it: code points are classed with numpy, a blank is put at each
boundary, and one split gives the words. Each distinct word is encoded by the library once, and the first CACHE words that
a worker meets, among them the frequent ones, are kept for good. That holds for texts whose code points are all in a range
where Python and the library agree on lower-casing, white space and classes; any other text goes to the library whole.
Either way the ids are the library's.
"""

from __future__ import annotations

import gc
import os
import unicodedata
from functools import lru_cache

import numpy as np
import regex

WORD_BPE = "word_bpe_49k.json"
END_ID = 2
CACHE = 600_000
#: Texts are split together up to so many code points, so that memory does not follow the batch.
TOGETHER = 1 << 20
#: Code points below LATIN, without control characters of which the libraries differ.
LATIN = 0x250
SPACE, LETTER, DIGIT, OTHER = range(4)
# Fixed value: the contractions in the pre-tokenizer's pattern; its other words are runs of letters, digits, runs of the rest.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For code points up to LATIN: whether they are split here, their lower case, its class."""
    plain, lower, kind = np.zeros(LATIN + 1, dtype=bool), np.full(LATIN + 1, 0x20, dtype=np.uint32), np.zeros(LATIN + 1, dtype=np.uint8)
    for c in range(LATIN):
        small = chr(c).lower()
        if 0x09 <= c <= 0x0D or 0x20 <= c < 0x7F or 0xA0 <= c and len(small) == 1 and ord(small) < LATIN:
            plain[c], lower[c] = True, ord(small)
            kind[c] = SPACE if regex.match(r"\s", small) else LETTER if regex.match(r"\p{L}", small) else DIGIT if regex.match(r"\p{N}", small) else OTHER
    return plain, lower, kind


PLAIN, LOWER, KIND = _tables()


def vocabulary_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_words(cp: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The words of code points (those that are not plain count as blanks), and how many words begin before each code point, with the end."""
    kind, small = KIND[cp], LOWER[cp]
    begins = np.ones(len(cp) + 1, dtype=bool)
    begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    marks = np.flatnonzero(small == 0x27)
    for i in marks[(marks == 0) | (kind[marks - 1] != OTHER)].tolist():
        near = "".join(map(chr, small[i : i + 3].tolist()))
        if found := next((c for c in CONTRACTIONS if near.startswith(c)), None):
            begins[i + 1 : i + len(found)] = False
            begins[i + len(found)] = True
    shift = np.cumsum(begins[:-1], dtype=np.int32)
    spread = np.full(len(cp) + (int(shift[-1]) if len(cp) else 0), 0x20, dtype=np.uint32)
    small[kind == SPACE] = 0x20
    spread[np.arange(len(cp), dtype=np.int32) + shift] = small
    before = np.zeros(len(cp) + 1, dtype=np.int32)
    np.cumsum(begins[:-1] & (kind != SPACE), out=before[1:])
    return spread.tobytes().decode("utf-32-le", "surrogatepass").split(), before


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class WordEncoder:
    """Ids of whole texts by the tokenizer in `path`, as arrays of unsigned 16 bits."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        size = self.library.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids of over 16 bits")
        self.model = self.library.model
        #: The letter that stands for a byte: itself if it can be seen, else the next from 256 on.
        seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in seen]
        self.letters = {b: 256 + k for k, b in enumerate(hidden)}
        self.known = _Numbers()
        #: Of each numbered word: where its ids begin, with the end; and the ids.
        self.starts, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint16)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint16)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Starts (with the end) and ids of words. Words need neither normalising nor splitting, so the library's model gets their bytes."""
        found, starts = [], [0]
        for w in words:
            found += [t.id for t in self.model.tokenize(w if w.isascii() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters))]
            starts.append(len(found))
        return np.array(starts, dtype=np.int64), np.array(found, dtype=np.uint16)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and where those of each word begin, with the end."""
        had = len(self.known)
        number = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        starts, ids = self.starts, self.ids
        if len(self.known) > had:
            fresh = []
            for _ in range(len(self.known) - had):
                fresh.append(self.known.popitem()[0])
            fresh.reverse()
            more, new = self._learn(fresh)
            kept = min(len(fresh), max(0, CACHE - had))
            self.known.update(zip(fresh[:kept], range(had, had + kept)))  # noqa: B905
            starts, ids = np.concatenate([starts, more[1:] + starts[-1]]), np.concatenate([ids, new])
            if kept:
                self.starts, self.ids = starts[: had + kept + 1].copy(), ids[: starts[had + kept]].copy()
        first = starts[number]
        sizes = starts[number + 1] - first
        at = np.zeros(len(number) + 1, dtype=np.int64)
        np.cumsum(sizes, out=at[1:])
        return ids[np.repeat(first - at[:-1], sizes) + np.arange(at[-1])], at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Without the cycle collector, which would visit the words again and again and find nothing."""
        on = gc.isenabled()
        gc.disable()
        try:
            out: list[np.ndarray] = []
            own, held = [], 0
            for text in texts:
                if not text.isascii():
                    text = unicodedata.normalize("NFC", text)
                if own and held + len(text) > TOGETHER:
                    out += self._encode(own)
                    own, held = [], 0
                own.append(text)
                held += len(text) + 1
            return out + (self._encode(own) if own else [])
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        cp = np.minimum(cp, LATIN)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        words, before = split_words(cp)
        ids, at = self._words(words)
        at = at[before[ends]].tolist()
        out = [ids[a:b] for a, b in zip([0, *at], at)]  # noqa: B905
        for i in set(np.searchsorted(ends, np.flatnonzero(~PLAIN[cp])).tolist()):
            out[i] = self._whole(texts[i])
        return out


@lru_cache(4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_with_end(texts: list[str], path: str, end_id: int = END_ID) -> list[np.ndarray]:
    """Ids of each text with the end id, unsigned 16 bits."""
    end = np.array([end_id], dtype=np.uint16)
    return [np.concatenate([x, end]) for x in encoder(path).encode(texts)]
