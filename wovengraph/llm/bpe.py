"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

What the encoder relies on: every prefix of a tokenisation is the tokenisation
of its own text, and a token sequence is the tokenisation exactly if each
neighbouring pair is the tokenisation of the two joined. So the last token of
each prefix follows from the last tokens of shorter prefixes: it is the one
vocabulary entry that ends there and may follow what stands before it.

The merge list's sufficient lookahead is the length of its longest entry: any
tokenisation of a longer text has a token border within every window of so
many symbols. Once the chains of last tokens from all positions of that window
meet in one position, whatever follows, the tokens before it are stable; they
are emitted and forgotten. A word of any length is encoded with the memory of
the undecided part only.

Texts are normalised and cut into words as the vocabulary file says (NFC,
white space to blanks, lower case; letters, single digits, runs of marks), in
pieces that end at white space. Each task keeps the token strings of the words
it met lately, in two generations of bounded size.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wovengraph.llm.common import mapped

PIECE = 1 << 20
WORDS = 250_000
PAIRS = 600_000
LONG_WORD = 200

_SPACE = r"\t\n\x0b\x0c\r \x85\p{Z}"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_GAP = regex.compile(rf"[{_SPACE}]")
# Below U+0250, and without the figures that aren't decimal, the standard library's classes say the same.
_RARE = re.compile("[\xb2\xb3\xb9\xbc-\xbe\x1c-\x1fɐ-\U0010ffff]")
_COMMON = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Vocabulary and merge list of a file; ``end`` marks the last symbol of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"]["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {tuple(p): k for k, p in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.lookahead = max(len(self.symbols(t)) for t in self.vocab)
        self.spell = str.maketrans({b: c for b, c in enumerate(byte_symbols())})
        self.id_bytes = {t: i.to_bytes(4, "little") for t, i in self.vocab.items()}
        self.whole = frozenset(t for t in self.vocab if self.merged(self.symbols(t)) == [t])
        self._follows: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            stem = token[: -len(self.end)]
            return [*stem[:-1], stem[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges by definition: the first pair of least rank, again and again. For short strings only."""
        while len(symbols) > 1:
            rank, at = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.rank):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def follows(self, left: str, right: str) -> bool:
        """True if the two are the tokenisation of their joined text."""
        if len(self._follows) >= PAIRS:
            self._follows.clear()
        fits = self._follows[left, right] = self.merged([*self.symbols(left), *self.symbols(right)]) == [left, right]
        return fits


class Encoder:
    """Takes a word in parts, gives tokens once they are stable."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._start("")

    def _start(self, before: str) -> None:
        self.before = before  # the last token emitted
        self.text = ""  # undecided symbols
        self.last: list[str] = [before]  # last token up to each position
        self.back: list[int] = [0]  # its start

    def feed(self, symbols: str, final: bool = False) -> Iterator[str]:
        """``final``: the last of these symbols ends the word."""
        look = self.merges.lookahead
        for at in range(0, len(symbols), look):
            part = symbols[at : at + look]
            self._extend(part, final and at + look >= len(symbols))
            if len(self.text) >= 4 * look:
                yield from self._stable()
        if final:
            yield from self._chain(len(self.text))
            self._start("")

    def _extend(self, part: str, final: bool) -> None:
        merges, last, back = self.merges, self.last, self.back
        whole, look, known = merges.whole, merges.lookahead, merges._follows.get
        done, text = len(self.text), self.text + part
        end = len(text)
        for n in range(done + 1, end + 1):
            mark = merges.end if final and n == end else ""
            for start in range(n - look if n > look else 0, n):
                token = text[start:n] + mark
                if token in whole:
                    left = last[start]
                    fits = not left or known((left, token))
                    if fits is None:
                        fits = merges.follows(left, token)
                    if fits:
                        last.append(token)
                        back.append(start)
                        break
            else:
                raise ValueError(f"no token ends with {text[n - 1]!r}")
        self.text = text

    def _stable(self) -> list[str]:
        """Emit up to the position where the chains of all positions that may still be borders meet."""
        n = len(self.text)
        live = set(range(n - self.merges.lookahead + 1, n + 1))
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(self.back[far])
        meet = live.pop()
        if not meet:
            return []
        tokens, rest = self._chain(meet), self.text[meet:]
        last, back = self.last[meet + 1 :], [b - meet for b in self.back[meet + 1 :]]
        self._start(tokens[-1])
        self.text, self.last, self.back = rest, [self.before, *last], [0, *(max(0, b) for b in back)]
        return tokens

    def _chain(self, at: int) -> list[str]:
        tokens = []
        while at:
            tokens.append(self.last[at])
            at = self.back[at]
        return tokens[::-1]


class Words(dict):
    """Word to the bytes of its ids (little-endian, 32 bits); two generations of bounded size."""

    def __init__(self, merges: Merges):
        self.merges, self.encoder, self.older = merges, Encoder(merges), {}

    def encode(self, word: str) -> bytes:
        spelt = word.encode("utf-8").decode("latin-1").translate(self.merges.spell)
        return b"".join(map(self.merges.id_bytes.__getitem__, self.encoder.feed(spelt, True)))

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
            if len(word) > LONG_WORD:
                return ids
        if len(self) >= WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PIECE:
        gap = _GAP.search(text, start + PIECE)
        if not gap:
            break
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:]


def normal(text: str) -> str:
    """NFC and lower case, each character by itself (so no final sigma)."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def encoded(text: str, words: Words) -> Iterator[bytes]:
    """Bytes of the ids of a text, piece by piece; strings of added tokens are their ids."""
    added = words.merges.added
    parts = _added(tuple(added)).split(text) if added else [text]
    for k, part in enumerate(parts):
        if k % 2:
            yield np.array([added[part]], dtype="<u4").tobytes()
            continue
        for piece in _pieces(part):
            piece = normal(piece)
            found = (_WORD if _RARE.search(piece) else _COMMON).findall(piece)
            yield b"".join([words[w] for w in found])


@lru_cache
def _added(strings: tuple[str, ...]) -> re.Pattern:
    return re.compile("(" + "|".join(re.escape(s) for s in sorted(strings, key=len, reverse=True)) + ")")


class Decoder:
    """Ids to text with nothing kept but the state.

    ``tokens``: the entries with blanks between them, as the library decodes a
    vocabulary without a decoder; the state is whether an entry came before.
    Otherwise readable text: entries to bytes, word ends to blanks, bytes to
    characters; the state is an unfinished character.
    """

    def __init__(self, merges: Merges, tokens: bool):
        self.tokens, self.begun = tokens, False
        self.strings = merges.by_id
        if not tokens:
            byte = {c: b for b, c in enumerate(byte_symbols())}
            added = set(merges.added.values())
            self.bytes = {}
            for i, t in merges.by_id.items():
                stem = t.removesuffix(merges.end) if merges.end and i not in added else t
                raw = t.encode() if i in added else bytes(byte[c] for c in stem)
                self.bytes[i] = raw + b" " * (stem != t)
            self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if not self.tokens:
            return self.utf8.decode(b"".join(map(self.bytes.__getitem__, ids)))
        out = " ".join(map(self.strings.__getitem__, ids))
        if out and self.begun:
            out = " " + out
        self.begun = self.begun or bool(out)
        return out

    def finish(self) -> str:
        return "" if self.tokens else self.utf8.decode(b"", True)


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(Merges(path))


def _mapped(docs: DataFrame, id_col: str, other: str, schema: str, one: Callable) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def make():
        return lambda pdf: pd.DataFrame([one(v) for v in pdf["_value"]], columns=names)

    named = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{other}`").alias("_value"))
    return mapped(named, ["_id"], make, schema).withColumnRenamed("_id", id_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids of every row; null counts as empty and gives an empty list."""

    def one(text):
        return (np.frombuffer(b"".join(encoded(text or "", _words(path))), dtype="<u4").astype("int32"),)

    return _mapped(docs, id_col, text_col, "ids array<int>", one)


def decode(ids: DataFrame, path: str, tokens: bool = False, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text of every row; see Decoder. A null list gives an empty text."""

    def one(row):
        machine = Decoder(_words(path).merges, tokens)
        return (machine.feed(() if row is None else np.asarray(row).tolist()) + machine.finish(),)

    return _mapped(ids, id_col, ids_col, "text string", one)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding back to back, neither held whole."""

    def one(text):
        words = _words(path)
        machine, n = Decoder(words.merges, True), 0
        ids, decoded = hashlib.sha256(), hashlib.sha256()
        for part in encoded(text or "", words):
            ids.update(part)
            n += len(part) // 4
            decoded.update(machine.feed(np.frombuffer(part, dtype="<u4").tolist()).encode())
        return n, ids.hexdigest(), decoded.hexdigest()

    return _mapped(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", one)
