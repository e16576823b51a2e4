"""Token ids of whole texts by a word-level BPE file of the `tokenizers` library, with each distinct unit encoded once.

The file's normalizer (NFC, white space to one space, lower case per character) and its
pre-tokenizer never look across white space, so a text's ids are those of its units between
white space, joined. A worker keeps the units it has met; new ones are encoded together,
separated by a mark that is a pre-token and a single id of its own.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from .storage import kept_in_worker

#: White space as the file's `\s` has it; Python's own also has four control characters, which are no white space there.
UNIT = re.compile("[^\t-\r \x85\xa0  -     　]+")
ODD = re.compile("[\x1c-\x1f]")
MARK = "\x01"
_LETTERS = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGITS = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
#: The pre-tokens of a lower-cased Latin-1 text, as the file's pattern has them.
PIECE = re.compile(rb"[%b]+|'(?:s|t|re|ve|m|ll|d)|[%b]|[^%b%b\t-\r \x85\xa0]+" % (_LETTERS, _DIGITS, _LETTERS, _DIGITS))
LOWER = bytes(ord(c.lower()) if len((c := chr(b)).lower()) == 1 and ord(c.lower()) < 256 else b for b in range(256))


class WordBpe:
    """ids(texts) with a memory of at most `keep` pieces; beyond that it starts anew.

    A Latin-1 text, which is its own normal form and is lowered letter by letter, is cut into pre-tokens here and each distinct one encoded once;
    another text is cut at white space, and each distinct unit encoded once.
    """

    def __init__(self, path: str, keep: int = 550_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep = keep
        self.memory: dict[str | bytes, bytes] = {}
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = None
        if suffix:  # each pre-token then ends with an id that has it, and no other id has it
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, units: list[str], single: bool) -> list[bytes]:
        """Each unit's ids, many units at a time: single pre-tokens end where an id ends a word, others are parted by the mark."""
        out, gap = [], " " if single else f" {MARK} "
        for at in range(0, len(units), 2000):
            some = units[at : at + 2000]
            ids = np.array(self.tokenizer.encode(gap.join(some), add_special_tokens=False).ids, "<u4")
            if single:
                hi = np.flatnonzero(self.last[ids]) + 1
                lo = np.concatenate(([0], hi[:-1]))
            else:
                ends = np.flatnonzero(ids == self.mark)
                lo, hi = np.concatenate(([0], ends + 1)), np.concatenate((ends, [len(ids)]))
            if len(hi) != len(some):
                raise RuntimeError("units and pre-tokens do not match")
            raw = ids.tobytes()
            out += [raw[x:y] for x, y in zip((4 * lo).tolist(), (4 * hi).tolist())]
        return out

    def _learn(self, units: list) -> None:
        pieces = [u for u in units if isinstance(u, bytes)]
        self.memory.update(zip(pieces, self._encode([p.decode("latin-1") for p in pieces], True)))
        plain = [u for u in units if isinstance(u, str)]
        odd = [u for u in plain if self.mark is None or MARK in u]
        self.memory.update((u, self._one(u)) for u in odd)
        plain = [u for u in plain if self.mark is not None and MARK not in u]
        self.memory.update(zip(plain, self._encode(plain, False)))

    def cut(self, text: str) -> list:
        if self.last is not None:
            try:
                return PIECE.findall(text.encode("latin-1").translate(LOWER))
            except UnicodeEncodeError:
                pass
        return UNIT.findall(text) if ODD.search(text) else text.split()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit integers. A text that spells an added token of the file goes to the library whole."""
        whole = {i: self._one(t) for i, t in enumerate(texts) if any(a in t for a in self.added)}
        if whole:
            rest = iter(self.ids([t for i, t in enumerate(texts) if i not in whole]))
            return [whole[i] if i in whole else next(rest) for i in range(len(texts))]
        units = [self.cut(t) for t in texts]
        new = set(chain.from_iterable(units)).difference(self.memory)
        if len(self.memory) + len(new) > self.keep:
            self.memory.clear()
            new = set(chain.from_iterable(units))
        if new:
            self._learn(list(new))
        get = self.memory.__getitem__
        return [b"".join(map(get, u)) for u in units]


def word_bpe(path: str) -> WordBpe:
    """One for a worker process."""
    return kept_in_worker(("word-bpe", path), lambda: WordBpe(path))
