"""Token ids by the tokenizers library, with a per-worker cache of words.

Byte-pair merges never cross a pre-token, so the ids of a text are the ids of its pre-tokens put
one after another. A worker keeps the ids of the words it has met and asks the library's model
only for new ones. Texts whose split is not plainly the same either way (rare white space, the string
of a special token, scripts beyond Latin) go to the library whole.
"""

from __future__ import annotations

import json
import os
from array import array

import public_tokenizers
import regex

WORD_FILE = "word_bpe_49k.json"
BYTE_FILE = "byte_bpe_50k.json"
#: Bound of a worker's cache, at about 200 bytes a word with its ids.
CACHE_BYTES, WORD_BYTES = 130_000_000, 200
#: What Unicode or Python takes for white space, but for the space and the line feed.
_ODD_SPACE = tuple(map(chr, (0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_PYTHON_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_BEYOND_LATIN = regex.compile(r"[^\x00-įı-ɏ]")


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 signs for themselves, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class CachedEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    By the library's default the string of a special token in a text is that token; with
    ``special_as_text`` it is ordinary text.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        self.model, self.limit, self.vocab_size = self.whole.model, max(1, cache_bytes // WORD_BYTES), self.whole.get_vocab_size()
        self.special = () if special_as_text else tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        with open(path, encoding="utf-8") as f:
            pre = json.load(f)["pre_tokenizer"]
        self.words: dict[str, bytes] = {}
        self.lower, self.letters = False, byte_letters()
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.find, self.units = regex.compile(public_tokenizers.PATTERN).findall, self._spaced
        elif pre["type"] == "Sequence" and pre["pretokenizers"][0].get("invert"):
            self.find, self.units, self.lower = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"]).findall, self._unspaced, True
        else:
            self.units = lambda text: None

    def encode(self, text: str) -> bytes:
        units = None if any(s in text for s in self.special) else self.units(text)
        if units is None:
            return self._library(text)
        known = self.words
        try:
            return b"".join([known[u] for u in units])
        except KeyError:
            ids = b"".join([known[u] if u in known else self._new(u) for u in units])
        if len(known) > self.limit:
            known.clear()
        return ids

    def _library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """One pre-token."""
        letters = piece.encode().decode("latin-1").translate(self.letters)
        got = self.words[piece] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return got

    def _new(self, word: str) -> bytes:
        if _BEYOND_LATIN.search(word):
            got = self.words[word] = self._library(word)
            return got
        own = word.lower() if self.lower else word
        started = own[:1] == " " or own[:1].isalpha()
        if started and own[1:].isalpha():
            pieces = (own,)
        elif started and own[-1] in ".,;:!?" and own[1:-1].isalpha():
            pieces = (own[:-1], own[-1])
        else:
            pieces = self.find(own)
        known = self.words
        got = known[word] = b"".join([known[p] if p in known else self._piece(p) for p in pieces])
        return got

    def _unspaced(self, text: str) -> list[str] | None:
        """White space only separates words."""
        return None if any(c in text for c in _PYTHON_SPACE) else text.split()

    def _spaced(self, text: str) -> list[str] | None:
        """A word keeps the one space before it; a line end stands alone."""
        if any(c in text for c in _ODD_SPACE) or "\0" in text:
            return None
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
            return None if _BEYOND_LATIN.search(text) else self.find(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


_ENCODERS: dict[tuple, CachedEncoder] = {}


def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> CachedEncoder:
    """One encoder for each worker process and file."""
    key = (path, cache_bytes)
    if key not in _ENCODERS:
        _ENCODERS[key] = CachedEncoder(path, cache_bytes)
    return _ENCODERS[key]
