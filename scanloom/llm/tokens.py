"""Token ids by the tokenizers library, remembered for pieces of text.

Both byte-pair tokenizers used here split a text before the merges so that no part
reaches over the place before a blank or line feed that follows something other
than white space, nor over the place between a letter or digit and ASCII
punctuation behind it. A text may therefore be cut at each such place, and the ids
of its pieces joined are the ids of the text. Natural text repeats its pieces, so
most are looked up and only new ones are encoded.
"""

from __future__ import annotations

import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import tokenizers
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Pieces that a worker remembers at most, and characters that are cut into pieces at a time.
MEMORY = 200_000
WINDOW = 1 << 20
#: Punctuation that may be cut from the word before it; no apostrophe, as that begins endings, nor brackets of special strings.
PUNCTUATION = ".,;:!?*#%$&"

#: How byte-level tokenizers write bytes: printable ones as themselves, the others in turn from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
BLANK_SIGN = chr(BYTE_SIGNS[32])


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation or padding."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut before a blank that follows something other than white space."""
    start = 0
    while len(text) - start > size:
        end = text.find(" ", start + size)
        while end > 0 and text[end - 1].isspace():
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def _stays_alnum(c: str) -> bool:
    """Whether a character still ends in a letter or digit after what tokenizers normalise: composition and case."""
    return c.isalnum() and (c.isascii() or unicodedata.normalize("NFC", c).lower()[-1].isalnum())


class PieceIds:
    """Ids of texts as bytes of ``dtype``, by piece.

    Pieces are known by keys: a piece after a blank by itself, one after a line feed
    by that and itself, the first of a text by a blank and itself. A key that is empty
    or ends in white space has no ids of its own, as no cut is safe behind it.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        self.tokenizer, self.memory = load(path), memory
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[str, bytes | bool] = {}
        self.tails: dict[str, bytes] = {}
        # A word of letters alone is one part for a byte-level tokenizer that normalises nothing: it goes to the merges at once.
        before = self.tokenizer.pre_tokenizer
        self.direct = self.tokenizer.normalizer is None and isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space

    @classmethod
    def shared(cls, path: str, memory: int = MEMORY) -> PieceIds:
        """The one of this process, so that tasks which follow each other in a worker share what they remember.

        It hangs on the library's module, as this package's own travels by value with each task.
        """
        held = tokenizers.__dict__.setdefault("_scanloom_pieces", {})
        if (path, memory) not in held:
            held[path, memory] = cls(path, memory)
        return held[path, memory]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes() if sys.byteorder == "big" else array(self.code, ids).tobytes()

    def _encode_keys(self, keys: list[str]) -> Iterator[tuple[str, bytes]]:
        """Keys of pieces with ids of their own, each with them."""
        rest = keys
        if self.direct:
            rest, merge = [], self.tokenizer.model.tokenize
            for k in keys:
                if k.isalpha():
                    shown = k if k.isascii() else k.encode("utf-8").decode("latin-1").translate(BYTE_SIGNS)
                    yield k, self._packed([t.id for t in merge(BLANK_SIGN + shown)])
                else:
                    rest.append(k)
        yield from zip(rest, self._encode(list(map(self._text, rest))), strict=True)

    @staticmethod
    def _text(key: str) -> str:
        return key[1:] if key[0] == " " else key if key[0] == "\n" else " " + key

    def _learn(self, keys: list[str]) -> dict[str, bytes | bool]:
        """The ids of keys that aren't known, also of those for which there is no room to remember; False if they have none of their own."""
        known = self.known
        fresh: dict[str, bytes | bool] = {}
        cut: list[tuple[str, str, str]] = []
        bases: dict[str, None] = {}
        for k in dict.fromkeys(keys):
            if not k or k[-1].isspace():
                fresh[k] = False
                continue
            base = k.rstrip(PUNCTUATION)
            if len(base) < len(k) and base and _stays_alnum(base[-1]):
                cut.append((k, base, k[len(base) :]))
            else:
                base = k
            if base not in known:
                bases[base] = None
        fresh.update(self._encode_keys(list(bases)))
        tails = [t for t in {t for _, _, t in cut} if t not in self.tails]
        if len(self.tails) + len(tails) > self.memory:
            self.tails.clear()
            tails = list({t for _, _, t in cut})
        self.tails.update(zip(tails, self._encode(tails), strict=True))
        room = self.memory - len(known)
        if room > 0:
            known.update(list(fresh.items())[:room])
        for k, base, tail in cut:
            fresh[k] = (fresh.get(base) or known[base]) + self.tails[tail]
        room = self.memory - len(known)
        if room > 0:
            known.update((k, fresh[k]) for k, _, _ in cut[:room])
        return fresh

    def ids(self, text: str) -> bytes:
        """The ids of a text, without begin, end or added special tokens; ids of special strings inside it as the library does."""
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts, whose new pieces are encoded together."""
        parts = [list(map(self._keys, windows(t))) if t else [] for t in texts]
        found = [[list(map(self.known.get, keys)) for keys in p] for p in parts]
        gaps = [(keys, ids, [n for n, i in enumerate(ids) if i is None]) for p, q in zip(parts, found, strict=True) for keys, ids in zip(p, q, strict=True) if None in ids]
        fresh = self._learn([keys[n] for keys, _, at in gaps for n in at]) if gaps else {}
        for keys, ids, at in gaps:
            for n in at:
                ids[n] = fresh[keys[n]]
        out = []
        for p, q in zip(parts, found, strict=True):
            done = []
            for keys, ids in zip(p, q, strict=True):
                try:
                    done.append(b"".join(ids))
                except TypeError:  # a piece without ids of its own
                    done.append(self._merged(keys, ids))
            out.append(done[0] if len(done) == 1 else b"".join(done))
        return out

    @staticmethod
    def _keys(text: str) -> list[str]:
        lines = text[1:].split("\n") if text[0] == " " else text.split("\n")
        keys = lines[0].split(" ")
        if text[0] != " ":
            keys[0] = " " + keys[0]
        for line in lines[1:]:
            pieces = line.split(" ")
            pieces[0] = "\n" + pieces[0]
            keys += pieces
        return keys

    def _merged(self, keys: list[str], found: list[bytes | bool]) -> bytes:
        """A piece behind which no cut is safe is encoded together with those that follow, up to a safe one."""
        out, run = [], ""
        for key, ids in zip(keys, found, strict=True):
            if not run and ids is not False:
                out.append(ids)
                continue
            run += self._text(key) if key else " "
            if ids is not False:
                out += self._encode([run])
                run = ""
        if run:
            out += self._encode([run])
        return b"".join(out)
