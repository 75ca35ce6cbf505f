"""Whole-text token ids of the tokenizers library, with bounded memos over chunks that its pre-tokenizers never join."""

from __future__ import annotations

import os
import re
import struct

#: Entries kept in each memo of a Python worker, about 200 bytes each.
MEMO_ENTRIES = 800_000

#: White space as Unicode lists it, in the form of a character class.
_SPACE = "\t-\r \x85\xa0  -     　"
#: A word with the one space before it, or a run of white space without its last character, or a single one.
_SPACED_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
#: ASCII and those Latin letters that NFC keeps and whose lower case is one letter of this range.
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ſ"
_ONLY_LATIN = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-įı-ſ]*").fullmatch
_SHORT = "'(?:[stmd]|re|ve|ll)"
_LATIN_SPACED = re.compile(f" ?[{_LETTER}]+|{_SHORT}| ?[0-9]+| ?[^\t-\r {_LETTER}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
_LATIN_WORDS = re.compile(f"[{_LETTER}]+|{_SHORT}|[0-9]|[^\t-\r {_LETTER}0-9]+").findall


def _byte_letters() -> dict[int, int]:
    """Code points that byte-level vocabularies use for bytes: the visible Latin-1 characters themselves, for the others 256 and up in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in seen)}


class _Words(dict):
    """Ids of one pre-token, as little-endian unsigned 32-bit integers, by the library's merge model."""

    def __init__(self, model, entries: int):
        super().__init__()
        self._tokenize, self._entries, self._letters = model.tokenize, entries, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self._entries:
            self.clear()
        ids = [t.id for t in self._tokenize(word.encode().decode("latin-1").translate(self._letters))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            self[word] = out
        return out


class Encoder(dict):
    """ids(text) has the ids of a whole text, 4 bytes each, as the library itself gives them.

    A text that spells one of the vocabulary's added tokens, in whatever case, goes to the library whole. Spaced vocabularies keep white space in their tokens; others drop it. Texts of Latin letters are cut into
    pre-tokens here, and distinct pre-tokens go to the library's merge model. Other texts are cut into chunks whose
    bounds no pre-token spans, and distinct chunks go through the library's whole pipeline; this dict keeps them.
    """

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self._tok = Tokenizer.from_file(path)
        self._tok.no_truncation()
        self._tok.no_padding()
        added = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added)), re.I).search if added else lambda text: None
        self._words, self._entries = _Words(self._tok.model, entries), entries
        self.spaced = self._tok.normalizer is None

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self._entries:
            self.clear()
        if _ONLY_LATIN(chunk):
            words = _LATIN_SPACED(chunk) if self.spaced else _LATIN_WORDS(chunk.lower())
            out = b"".join(map(self._words.__getitem__, words))
        else:
            ids = self._tok.encode(chunk, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 64:
            self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, 4 bytes each."""
        if self._added(text):
            ids = self._tok.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if _ONLY_LATIN(text):
            words = _LATIN_SPACED(text) if self.spaced else _LATIN_WORDS(text.lower())
            return b"".join(map(self._words.__getitem__, words))
        return b"".join(map(self.__getitem__, _SPACED_CHUNK(text) if self.spaced else text.replace("\n", " ").split(" ")))


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; kept while the worker lives."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
