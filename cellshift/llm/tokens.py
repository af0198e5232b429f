"""Token ids of whole texts with the tokenizers library, piece by piece through a bounded cache."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import wordarrays

CACHE = 300_000  # pieces whose ids a worker remembers, and as many again from before

# Letters a-z and Latin-1, single digits, and runs of ASCII punctuation are pre-tokenised alike in any surroundings,
# so their ids can be looked up; words with anything else (an apostrophe, other scripts, control characters) are
# encoded whole by the library.
_LETTERS = "a-zß-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[{_LETTERS}0-9{_MARKS} \t-\r]*")
_PIECE = re.compile(rf"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
_SINGLE = rf"[0-9]|[{_MARKS}]+"  # pieces that end where letters begin, set off by spaces in whole columns
_SPACES = re.compile(r"[^ \t-\r]+")
_NOT_PLAIN = rf"[^{_LETTERS}A-ZÀ-ÖØ-Þ0-9{_MARKS} \t-\r]"  # in texts not yet lower-cased, whose lower case is then plain


def _byte_chars() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of a lower-casing, white-space-dropping byte-level BPE file, as little-endian 32-bit bytes.

    Control strings of the vocabulary inside a text are read as the library reads them by default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.chars = _byte_chars()
        outer = self

        def pack(ids: list[int]) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)

        class Pieces(dict):
            """New pieces; a full table becomes the old one, whose pieces come back when they are met again."""

            def __missing__(self, piece: str) -> bytes:
                ids = outer.old.get(piece)
                if ids is None:
                    word = piece if piece.isascii() else "".join([outer.chars[b] for b in piece.encode()])
                    ids = pack([t.id for t in outer.model.tokenize(word)])
                if len(self) >= CACHE:
                    outer.old = dict(self)
                    self.clear()
                self[piece] = ids
                return ids

        self.model = self.lib.model
        if hasattr(self.model, "_resize_cache"):  # the library's own cache only costs time below this one
            self.model._resize_cache(0)
        self.old: dict[str, bytes] = {}
        self.pieces = Pieces()

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        low = text.lower() if text.isascii() or "İ" not in text else text
        if _PLAIN.fullmatch(low):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(low)))
        return b"".join(map(self._word, _SPACES.findall(text)))

    def ids_of(self, texts: pa.Array) -> list[bytes]:
        """``ids`` of each text (NULL: empty). Plain texts are cut by Arrow, and each of their distinct pieces looked up once."""
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, _NOT_PLAIN)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = pc.fill_null(odd, False)
        plain = pc.utf8_lower(pc.if_else(odd, "", pc.fill_null(texts, "")))
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, _SINGLE, r" \0 "))
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = pa.array(list(map(self.pieces.__getitem__, pieces)), pa.large_binary()).take(coded.indices)
        at = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, 8 * own.offset)[split.offsets.to_numpy()]
        raw = own.buffers()[2].to_pybytes() if at[-1] else b""
        out = [raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.ids(texts[i].as_py())
        return out

    def _word(self, word: str) -> bytes:
        low = word.lower()
        if _PLAIN.fullmatch(low) and len(low) == len(word):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(low)))
        return self._whole(word)


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = WordTokenizer(path)
        wordarrays.idle.append(_loaded.clear)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

