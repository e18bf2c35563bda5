"""Token files coded with a static range asymmetric numeral system.

One frequency table, counted over all documents, codes every block. A block
holds whole documents in ascending order, about ``BLOCK`` tokens of them, and
is independent of all others, so any task can read any block. Its tokens are
dealt to interleaved lanes, which numpy codes side by side. Every
``CHECKPOINT`` steps a block keeps the lane states and its place in the word
stream: decoding can begin there too. Words, states and tokens have CRC-32
checksums.

A file is a Parquet table of blocks beside one of frequencies. Block layout,
little-endian: 5 unsigned 32-bit numbers (magic, lanes, tokens, checkpoints,
words), then per checkpoint its word offset (32 bits) and lane states (64 bits),
the words (32 bits each), and the CRC-32 of all that.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wovengraph.llm.bpe import byte_symbols
from wovengraph.llm.common import mapped, settle, shared_folder

BLOCK = 1 << 18
LANES = 1024
CHECKPOINT = 128
BITS = 18
LOW = np.uint64(1 << 31)
MAGIC = 0x31534E52
WORDS = 350_000
SLICE = 1 << 20

# Below U+0250, and without the figures that aren't decimal, the standard library's classes say the same.
_RARE = re.compile("[\xb2\xb3\xb9\xbc-\xbe\x1c-\x1f\u0250-\U0010ffff]")
_COMMON = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_BEYOND = re.compile("[\u0250-\U0010ffff]")
_BETWEEN = re.compile("[A-Za-z](?= [A-Za-z])")
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


SPACE, LETTER, FIGURE, OTHER = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of each code point below U+0250."""
    figures = [regex.match(r"(\s)|(\p{L})|(\p{N})|(.)", chr(i)).lastindex - 1 for i in range(0x250)]
    return np.array(figures, dtype=np.uint8)


def word_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where ``_WORD`` begins its matches: a flag for each code point (all below U+0250).

    ``firsts`` are the places at which the pieces begin that are cut apart.
    A run of one kind is a word. The last white space before a word stands
    alone, or with the word if it is a space.
    """
    n, kind = len(points), _kinds()[points]
    new = np.zeros(n + 3, dtype=bool)
    new[firsts] = True
    new[n:] = True
    start = new.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:n] & ~new[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    # A contraction ends after its letters, whatever follows.
    mark = np.flatnonzero((points == 39) & start[:n])
    ahead = np.concatenate([points, np.zeros(3, dtype=points.dtype)])
    one, two = ahead[mark + 1], ahead[mark + 2]
    short = np.isin(one, [ord(c) for c in "stmd"]) & ~new[mark + 1]
    long = ((one == ord("l")) & (two == ord("l"))) | (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")))
    long &= ~new[mark + 1] & ~new[mark + 2]
    start[mark[short | long] + 1] = False
    start[mark[short] + 2] = True
    start[mark[long] + 3] = True
    return start[:n]


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces of about ``SLICE``, cut where a letter, a space and a letter follow each other."""
    at = 0
    while len(text) - at > SLICE:
        found = _BETWEEN.search(text, at + SLICE)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


class Frequencies:
    """Counts scaled to a sum of 2 ** BITS, at least 1 for each symbol seen."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        self.symbols = symbols
        whole = 1 << BITS
        share = np.maximum(1, np.floor(counts * (whole / max(1, counts.sum())))).astype(np.int64)
        order = np.argsort(-share, kind="stable")
        over = int(share.sum()) - whole
        while over and len(share):  # even out what rounding left, from the most frequent on
            take = np.minimum(over, share[order] - 1) if over > 0 else np.full(len(order), over)
            first = int(np.argmax(take != 0))
            share[order[first]] -= take[first]
            over = int(share.sum()) - whole
        self.share = share.astype(np.uint64)
        self.start = (np.cumsum(share) - share).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(share)), share)
        self.index = np.zeros(int(symbols.max()) + 1 if len(symbols) else 0, dtype=np.int64)
        self.index[symbols] = np.arange(len(symbols))


def encode_block(ids: np.ndarray, table: Frequencies) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    own = np.zeros(steps * lanes, dtype=np.int64)
    own[:n] = table.index[ids]
    own = own.reshape(steps, lanes)
    share, start = table.share, table.start
    state = np.full(lanes, LOW, dtype=np.uint64)
    out: list[np.ndarray] = [None] * steps
    saved = {}
    for t in range(steps - 1, -1, -1):
        row = own[t] if t < steps - 1 else own[t, : n - t * lanes]
        f, x = share[row], state[: len(row)]
        full = x >= (f << np.uint64(63 - BITS))
        out[t] = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
        x = np.where(full, x >> np.uint64(32), x)
        q, r = np.divmod(x, f)
        state[: len(row)] = (q << np.uint64(BITS)) + r + start[row]
        if t % CHECKPOINT == 0:
            saved[t] = state.copy()
    ends = np.cumsum([0, *(len(w) for w in out)])
    marks = sorted(saved)
    body = struct.pack("<5I", MAGIC, lanes, n, len(marks), int(ends[-1]))
    body += b"".join(struct.pack("<I", int(ends[t])) + saved[t].astype("<u8").tobytes() for t in marks)
    body += b"".join(w.tobytes() for w in out)
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(block: bytes, table: Frequencies, first: int = 0) -> np.ndarray:
    """Tokens from checkpoint ``first`` on; raises if the checksum does not hold."""
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block")
    magic, lanes, n, marks, words = struct.unpack("<5I", block[:20])
    if magic != MAGIC:
        raise ValueError("not a token block")
    size = 4 + 8 * lanes
    at = 20 + first * size
    steps = -(-n // lanes)
    if not steps:
        return np.zeros(0, dtype=np.int64)
    stream = np.frombuffer(block, dtype="<u4", count=words, offset=20 + marks * size)
    place = struct.unpack("<I", block[at : at + 4])[0]
    state = np.frombuffer(block, dtype="<u8", count=lanes, offset=at + 4).astype(np.uint64)
    begin = first * CHECKPOINT
    out = np.empty((steps - begin, lanes), dtype=np.int64)
    mask = np.uint64((1 << BITS) - 1)
    for t in range(begin, steps):
        x = state if t < steps - 1 else state[: n - t * lanes]
        low = x & mask
        row = table.slot[low]
        x = table.share[row] * (x >> np.uint64(BITS)) + low - table.start[row]
        need = np.flatnonzero(x < LOW)
        x[need] = (x[need] << np.uint64(32)) | stream[place : place + len(need)]
        place += len(need)
        state[: len(x)] = x
        out[t - begin, : len(x)] = row
    return table.symbols[out.reshape(-1)[: n - begin * lanes]]


class Tokens(dict):
    """Word to the bytes of its ids (16 bits), as the library's model gives them; two generations of bounded size."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.model = self.library.model
        self.id_bytes = [i.to_bytes(2, "little") for i in range(self.library.get_vocab_size())]
        self.spell = str.maketrans(dict(enumerate(byte_symbols())))
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.older: dict[str, bytes] = {}
        self.direct = self._by_rank()

    def _by_rank(self):
        """Ids of a word by merging the pair of lowest id, or None where that may differ from the file's merges.

        Merges listed in ascending order of their ids have the same priorities, and
        if each token, cut alone, comes out whole, two neighbours that spell a token
        can only be the pair it is merged from. So both ways make the same merges.
        """
        from tiktoken import Encoding

        stored = json.loads(self.library.to_str())["model"]
        vocab = {s: i for s, i in stored["vocab"].items() if s not in self.added}
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in stored["merges"]]
        plain = not any(stored.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        symbols = {s: bytes([i]) for i, s in enumerate(byte_symbols())}
        if not plain or None in made or made != sorted(set(made)) or len(vocab) != len(made) + len(symbols):
            return None
        if any(s not in vocab for s in symbols) or any(len(self.model.tokenize(s)) != 1 for s in vocab):
            return None
        ranks = {b"".join([symbols[c] for c in s]): i for s, i in vocab.items()}
        return Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if self.direct:
                found = self.direct(word)
            else:
                found = [t.id for t in self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.spell))]
            ids = b"".join([self.id_bytes[i] for i in found])
        if len(self) >= WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        parts = self.cut.split(text) if self.cut and "<" in text else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.id_bytes[self.added[part]])
            else:
                words = (_WORD if _RARE.search(part) else _COMMON).findall(part)
                out.append(b"".join(map(self.__getitem__, words)))
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Bytes of the ids of each text; distinct words of a slice of texts are looked up once."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            if not text.isascii() and _BEYOND.search(text) or self.cut and "<" in text and self.cut.search(text):
                out[i].append(self.encode(text))
                continue
            for piece in _pieces(text):
                held.append((i, piece))
                size += len(piece)
                if size >= SLICE:
                    self._slice(held, out)
                    held, size = [], 0
        self._slice(held, out)
        return [b"".join(o) for o in out]

    def _slice(self, held: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        text = "".join([piece for _, piece in held])
        if not text:
            return
        lengths = np.array([len(piece) for _, piece in held])
        ends = np.cumsum(lengths)
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        at = np.flatnonzero(word_starts(points, (ends - lengths)[lengths > 0]))
        raw = text.encode("utf-8")
        place = at if len(raw) == len(text) else (np.cumsum(1 + (points > 0x7F)) - 1 - (points > 0x7F))[at]
        offsets = np.append(place, len(raw)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        found = [self[word] for word in coded.dictionary.to_pylist()]
        ids, sizes = np.frombuffer(b"".join(found), dtype="<u2"), np.array([len(f) // 2 for f in found])
        word = coded.indices.to_numpy()
        n = sizes[word]
        after = np.cumsum(n)
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[word] - (after - n), n) + np.arange(after[-1])]
        borders = np.concatenate([[0], after])[np.searchsorted(at, ends)]
        first = 0
        for (i, _), border in zip(held, borders.tolist(), strict=True):
            out[i].append(ids[first:border].tobytes())
            first = border


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """id, part, start (tokens before it in its part), n, ids (16-bit, with the end id); parts in ascending id order."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    ordered = ordered.withColumn("part", F.spark_partition_id())
    mark = np.array([end], dtype="<u2").tobytes()

    def make():
        tokens, before = _tokens(path), 0

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal before
            ids = [i + mark for i in tokens.encode_all([t or "" for t in pdf["text"]])]
            n = np.array([len(i) // 2 for i in ids], dtype=np.int64)
            out = pd.DataFrame({"start": before + np.cumsum(n) - n, "n": n, "ids": ids})
            before += int(n.sum())
            return out

        return one

    return mapped(ordered.select("id", "part", "text"), ["id", "part"], make, "start long, n long, ids binary")


def frequencies(tokens: DataFrame) -> DataFrame:
    """symbol, n over all documents; one row per vocabulary entry in use."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for pdf in batches:
            total += np.bincount(np.frombuffer(b"".join(pdf["ids"]), dtype="<u2"), minlength=1 << 16)
        used = total.nonzero()[0]
        yield pd.DataFrame({"symbol": used, "n": total[used]})

    return tokens.select("ids").mapInPandas(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def _table(rows: DataFrame) -> Frequencies:
    got = rows.orderBy("symbol").toArrow()
    return Frequencies(got["symbol"].to_numpy().astype(np.int64), got["n"].to_numpy())


class TokenFile:
    """A written file: ``blocks`` and ``table`` below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, id_kind: str = "bigint") -> DataFrame:
        """id, start, n_tokens, ids (32-bit array) of every document, from the blocks."""
        return self._decoded(f"id {id_kind}, start long, n_tokens long, ids array<long>", lambda ids: ids)

    def checksums(self, id_kind: str = "bigint") -> DataFrame:
        """id, start, n_tokens, ids_crc32 of every document, from the blocks."""
        return self._decoded(f"id {id_kind}, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))

    def _decoded(self, schema: str, value) -> DataFrame:
        table = self.spark.sparkContext.broadcast(_table(self.spark.read.parquet(f"{self.path}/table")))
        last = schema.split(", ")[-1].split()[0]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    ids = decode_block(row.block, table.value)
                    if zlib.crc32(ids.astype("<u4").tobytes()) != row.crc:
                        raise ValueError("damaged tokens")
                    sizes = np.asarray(row.sizes)
                    ends = np.cumsum(sizes)
                    found = [value(ids[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
                    out = pd.DataFrame({"id": pd.Series(list(row.ids), dtype=object), "start": row.start + ends - sizes, "n_tokens": sizes})
                    yield out.assign(**{last: found})

        # Ids pass through Python as text, since pandas has no whole numbers beside nulls.
        (_, kind), *others = [c.split() for c in schema.split(", ")]
        blocks = self.spark.read.parquet(f"{self.path}/blocks").withColumn("ids", F.col("ids").cast("array<string>"))
        found = blocks.mapInPandas(run, schema.replace(f"id {kind}", "id string", 1))
        return found.select(F.col("id").cast(kind).alias("id"), *(name for name, _ in others))


def write(docs: DataFrame, path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> TokenFile:
    """Tokenise, append ``end`` to each document and write the file; null text counts as empty.

    Documents are in ascending order of ids, nulls first; those with equal ids are neighbours in any order.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    tokens = settle(tokenized(rows, path, end))
    frequencies(tokens).write.parquet(f"{folder}/table")
    table = spark.sparkContext.broadcast(_table(spark.read.parquet(f"{folder}/table")))
    sums = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    bases, before = {}, 0
    for part in sorted(sums):
        bases[part], before = before, before + sums[part]
    kind = tokens.schema["id"].dataType.simpleString()

    def block(rows: list) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(r.ids for r in rows), dtype="<u2").astype(np.int64)
        return pd.DataFrame(
            {
                "start": [bases[rows[0].part] + rows[0].start],
                "ids": [[r.id for r in rows]],
                "sizes": [[r.n for r in rows]],
                "crc": [zlib.crc32(ids.astype("<u4").tobytes())],
                "block": [encode_block(ids, table.value)],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for row in pdf.itertuples():
                if held and (size + row.n > BLOCK or held[-1].part != row.part or held[-1].start + held[-1].n != row.start):
                    yield block(held)
                    held, size = [], 0
                held.append(row)
                size += row.n
        if held:
            yield block(held)

    named = tokens.withColumn("id", F.col("id").cast("string"))
    blocks = named.mapInPandas(run, "start long, ids array<string>, sizes array<long>, crc long, block binary")
    blocks = blocks.withColumn("ids", F.col("ids").cast(f"array<{kind}>"))
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    return TokenFile(spark, folder)
