"""BPE encoding and decoding with a public vocabulary, by tree concatenation of long unsplit text.

Texts fall apart at white space, which the pre-tokenizer drops, so words are encoded once and looked up after that. A word of
more than `leaf` symbols after pre-tokenization is encoded by tree concatenation: it is halved until the pieces are short, the
pieces are encoded by themselves, and neighbours are joined pair by pair. At a join the last k tokens of the left and the first
k of the right side are encoded anew as one window, and k doubles until the window starts with the token that the left side had
there and ends with the one that the right side had. Then every adjacent pair of tokens in the result is one that the merges
leave alone, which is what makes a BPE encoding the right one, so the result equals an encoding of the whole. Pieces that don't
end the word are encoded without the end-of-word suffix.

Null counts as empty text, which has no tokens. Strings of special tokens in a text become those tokens, as in the library.
Texts of any length are encoded whole. An empty table gives no rows; repeated rows get equal results.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karyoflux.llm.common import small_batches

#: Symbols of a word that are encoded at once.
LEAF = 24
#: Words that a task remembers; then it starts afresh. Workers outlive their tasks, so a task forgets them at its end.
REMEMBERED = 50_000
#: Words of these characters are normalized and pre-tokenized here, by the file's own rules, which for them are simple: they have
#: no marks to compose, and lower case goes letter by letter. All other words go through the library's own normalizer.
_PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: White space on which Python and the vocabulary's normalizer might differ: such texts go to the library whole.
_ODD_SPACE = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))) + "]")


class Encoder:
    """Encodes and decodes with one tokenizer file."""

    def __init__(self, path: str, leaf: int = LEAF, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.leaf, self.remembered = leaf, remembered
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["truncation"] = spec["padding"] = None
        self.whole = Tokenizer.from_str(json.dumps(spec))
        spec["model"]["end_of_word_suffix"] = None
        self.open = Tokenizer.from_str(json.dumps(spec)).model
        self.closed = self.whole.model
        self.pieces = [self.whole.id_to_token(i) for i in range(self.whole.get_vocab_size())]
        specials = sorted((t.content for t in self.whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.known: dict[str, tuple[bytes, str]] = {}
        self.parts: dict[str, list[int]] = {}
        self.symbol = _byte_symbols()

    # -- tree concatenation -------------------------------------------------------------------------------------------
    def unsplit(self, symbols: str) -> list[int]:
        """Token ids of one pre-token, however long."""
        if len(symbols) <= self.leaf:
            return [t.id for t in self.closed.tokenize(symbols)]
        return [i for i, _ in self._tree(symbols, 0, len(symbols))]

    def _model(self, symbols: str, start: int, end: int) -> list[tuple[int, int]]:
        """(id, end of the token in symbols) for symbols[start:end] encoded by itself."""
        model = self.closed if end == len(symbols) else self.open
        out, at = [], start
        for t in model.tokenize(symbols[start:end]):
            at += len(t.value)  # offsets count bytes; a value has one character for each symbol, but for the suffix
            out.append((t.id, min(at, end)))
        return out

    def _tree(self, symbols: str, start: int, end: int) -> list[tuple[int, int]]:
        size, leaf = end - start, self.leaf
        if size <= leaf:
            return self._model(symbols, start, end)
        depth = (-(-size // leaf) - 1).bit_length()
        cuts = [start + size * i // (1 << depth) for i in range((1 << depth) + 1)]
        parts = [self._model(symbols, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        while len(parts) > 1:
            cuts = cuts[::2]
            parts = [self._join(symbols, cuts[i], parts[2 * i], parts[2 * i + 1]) for i in range(len(parts) // 2)]
        return parts[0]

    def _join(self, symbols: str, start: int, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple[int, int]]:
        k = 2
        while True:
            whole_left, whole_right = k >= len(left), k >= len(right)
            a = start if whole_left else left[-k - 1][1]
            b = right[-1][1] if whole_right else right[k - 1][1]
            window = self._model(symbols, a, b)
            same_left = whole_left or window[0] == left[-k]
            same_right = whole_right or (window[-1] == right[k - 1] and (window[-2][1] if len(window) > 1 else a) == right[k - 2][1])
            if same_left and same_right:
                return ([] if whole_left else left[:-k]) + window + ([] if whole_right else right[k:])
            k *= 2

    # -- words and texts ----------------------------------------------------------------------------------------------
    def _long(self, word: str) -> list[int]:
        out: list[int] = []
        for part in self.special.split(word) if self.special else [word]:
            if not part:
                continue
            if self.special and self.special.fullmatch(part):
                out.append(self.whole.token_to_id(part))
                continue
            flat = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
            for symbols, _ in self.whole.pre_tokenizer.pre_tokenize_str(flat):
                out += self.unsplit(symbols)
        return out

    def _learn(self, words: list[str]) -> None:
        """Remembers the words that are new. The store is cleared when full; it may exceed its bound by one call's words."""
        if len(self.known) > self.remembered:
            self.known.clear()
        new = [w for w in set(words) if w not in self.known]
        for w in new:
            ids = self._plain(w) if _PLAIN.fullmatch(w) and "<|" not in w else self._long(w)
            self.known[w] = _packed(ids), self.decode(ids)

    def _plain(self, word: str) -> list[int]:
        out: list[int] = []
        for part in _SPLIT.findall(word.lower()):
            if (ids := self.parts.get(part)) is None:
                if len(self.parts) > self.remembered:
                    self.parts.clear()
                symbols = part if part.isascii() else "".join(self.symbol[b] for b in part.encode())
                ids = self.parts[part] = self.unsplit(symbols)
            out += ids
        return out

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and the text they decode to."""
        if not text:
            return b"", ""
        if _ODD_SPACE.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return _packed(ids), self.decode(ids)
        words = text.split()
        out, back = [], []
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            try:
                found = list(map(self.known.__getitem__, part))
            except KeyError:
                self._learn(part)
                found = list(map(self.known.__getitem__, part))
            out.append(b"".join([f[0] for f in found]))
            back += [f[1] for f in found if f[1]]
        return b"".join(out), " ".join(back)

    def forget(self) -> None:
        self.known, self.parts = {}, {}

    def decode(self, ids) -> str:
        return " ".join(map(self.pieces.__getitem__, ids))


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_symbols() -> list[str]:
    """The character for each byte in a byte-level vocabulary: itself if printable Latin-1, else from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


@lru_cache(maxsize=4)
def encoder(path: str, leaf: int = LEAF) -> Encoder:
    return Encoder(path, leaf)


def encode(df: DataFrame, path: str, text: str = "text", leaf: int = LEAF, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` of df with ids_le (binary, 4 bytes a token) and decoded (string)."""

    @F.pandas_udf("struct<ids_le: binary, decoded: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(path, leaf)
        try:
            for s in batches:
                yield pd.DataFrame([e.encode(t) for t in s], columns=["ids_le", "decoded"])
        finally:
            e.forget()

    small_batches(df.sparkSession)
    coded = df.select(*keep, run(F.col(text)).alias("_coded"))
    return coded.select(*keep, "_coded.ids_le", "_coded.decoded")


def decode(df: DataFrame, path: str, ids: str = "ids_le", out: str = "decoded") -> DataFrame:
    """df with `out`: the text of ids given as little-endian unsigned 32-bit integers. Null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for s in batches:
            yield pd.Series([None if b is None else e.decode(np.frombuffer(b, "<u4").tolist()) for b in s], dtype=object)

    return df.withColumn(out, run(F.col(ids)))
