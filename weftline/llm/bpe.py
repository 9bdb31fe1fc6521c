"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one last token in its valid encoding. It is the only
token t ending there such that t and the last token before it stay apart when their bytes
are merged together. Storing that token for each prefix gives an encoding in one pass,
exact appends without going back, and re-encoding after an edit that stops as soon as the
stored tokens agree with the old ones again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import by_batch, quoted, texts

#: Entries of the cache of words in one Python worker; two generations of it are kept.
WORD_ENTRIES = 300_000
#: Entries of the cache of pieces, likewise.
PIECE_ENTRIES = 100_000
#: Prefixes of pieces whose last token is kept from piece to piece.
PREFIX_ENTRIES = 600_000
#: Longer pieces keep their prefixes to themselves.
SHARED_BYTES = 48
#: Remembered verdicts about pairs of tokens.
PAIR_ENTRIES = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Generations(dict):
    """A bounded cache: when the young generation is full it becomes the old one."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class PrefixBPE:
    """Encodes pieces by a table of ranks, as a merge loop over it would."""

    def __init__(self, ranks: dict[bytes, int], cache: float = 1.0):
        self.ranks = ranks
        self.prefix_entries, self.pair_entries = int(cache * PREFIX_ENTRIES), max(int(cache * PAIR_ENTRIES), 1 << 18)
        self.tokens = {v: k for k, v in ranks.items()}
        #: all endings of tokens, with the token or -1: what is none of them ends a search
        self.ends = {t[i:]: -1 for t in ranks for i in range(len(t))} | ranks
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.known: dict[bytes, int] = {}

    def merged(self, data: bytes) -> list[int]:
        """The plain merge loop; used on the bytes of one token or a pair only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ranks), default=None)
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def stands(self, t: int) -> bool:
        """Whether merging the bytes of a token gives that token."""
        got = self.whole.get(t)
        if got is None:
            got = self.whole[t] = self.merged(self.tokens[t]) == [t]
        return got

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens gives the two again."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= self.pair_entries:
                self.pairs.clear()
            got = self.pairs[key] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return got

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The last token of the prefix ``data[:end]``, given those of all shorter ones."""
        for start in range(end - 1, -1, -1):
            t = self.ends.get(data[start:end])
            if t is None:
                break
            if t >= 0 and (self.apart(last[start - 1], t) if start else self.stands(t)):
                return t
        raise ValueError("the table lacks a single byte of the text")

    def shared(self, data: bytes) -> list[int]:
        """Encode a short piece, going on from the longest prefix met in earlier pieces."""
        known, ends, pairs = self.known, self.ends, self.pairs
        if len(known) >= self.prefix_entries:
            known.clear()
        at = len(data)
        while at and data[:at] not in known:
            at -= 1
        for end in range(at + 1, len(data) + 1):
            start, found = end - 1, -1
            while start > 0:
                t = ends.get(data[start:end])
                if t is None:
                    break
                if t >= 0:
                    before = known[data[:start]]
                    ok = pairs.get(before << 32 | t)
                    if ok is None:
                        ok = self.apart(before, t)
                    if ok:
                        found = t
                        break
                start -= 1
            if found < 0:
                found = self.ranks.get(data[:end], -1)
                if found < 0 or not self.stands(found):
                    raise ValueError("the table lacks a single byte of the text")
            known[data[:end]] = found
        out, end = [], len(data)
        while end:
            t = known[data[:end]]
            out.append(t)
            end -= len(self.tokens[t])
        return out[::-1]

    def unwind(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """A piece that is a token itself is that token, whether or not merges reach it."""
        if data in self.ranks:
            return [self.ranks[data]]
        return self.shared(data) if len(data) <= SHARED_BYTES else PrefixState(self, data).ids()


class PrefixState:
    """The last token of every prefix of one piece."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; nothing before them is looked at again."""
        self.data += data
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self.bpe.last_token(self.data, end, self.last))

    def edit(self, start: int, removed: int, inserted: bytes) -> int:
        """Replace bytes; returns how many prefixes were computed anew.

        Once the tokens of as many prefixes in a row as the longest token has bytes are the
        old ones, all later ones are, because none looks back further.
        """
        old, tail = self.last, start + removed
        self.data = self.data[:start] + inserted + self.data[tail:]
        self.last = old[:start]
        shift, same, first = len(inserted) - removed, 0, start + len(inserted)
        for end in range(start + 1, len(self.data) + 1):
            if same >= self.bpe.longest:
                self.last += old[end - 1 - shift :]
                return end - 1 - start
            t = self.bpe.last_token(self.data, end, self.last)
            self.last.append(t)
            same = same + 1 if end > first and old[end - 1 - shift] == t else 0
        return len(self.data) - start

    def ids(self) -> list[int]:
        return self.bpe.unwind(self.last)


class TextCodec:
    """Whole texts to ids (packed little-endian unsigned 32-bit integers) and back.

    A space between two characters that are no white space always starts a new piece, so
    texts are cut there first and the ids of each cut are remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: float = 1.0):
        self.bpe, self.pattern = PrefixBPE(ranks, cache), regex.compile(pattern)
        self.piece = Generations(lambda p: array("I", self.bpe.encode_piece(p.encode())).tobytes(), int(cache * PIECE_ENTRIES))
        self.spaced = Generations(lambda w: self._cut(" " + w), int(cache * WORD_ENTRIES))
        self.safe = re.compile(r"(?<=\S) (?=\S)")
        self.unsafe = re.compile(r"\A | \Z| \s|[^\S ] ")

    def _cut(self, s: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pattern.findall(s)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        words = self.safe.split(text) if self.unsafe.search(text) else text.split(" ")
        return self._cut(words[0]) + b"".join(map(self.spaced.__getitem__, words[1:]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bpe.tokens.__getitem__, array("I", ids)))


@cache
def codec(path: str, pattern: str, cache: float = 1.0) -> TextCodec:
    """One for each vocabulary in a Python worker; its caches serve all the worker's tasks.

    ``cache`` is their size as a share of the usual one, which trades time for memory.
    """
    return TextCodec(load_ranks(path), pattern, cache)


def _with_text(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def encode(df: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids`` (packed as in TextCodec) and ``n_tokens`` for each row.

    A null or empty text has no ids. Repeated rows are each encoded; an empty table gives an
    empty result; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocab, pattern)
        ids = [c.encode(t) for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["id", "ids", "n_tokens"])

    rows, kind = _with_text(df, id_col, text_col)
    return rows.mapInArrow(by_batch(run, "bpe", codec.cache_clear), f"id {kind}, ids binary, n_tokens bigint").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``bytes`` for each row of packed ids; null ids decode to no bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocab, pattern)
        out = [c.decode(x or b"") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    rows, kind = _with_text(df, id_col, ids_col)
    return rows.mapInArrow(by_batch(run, "bpe", codec.cache_clear), f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache: float = 1.0) -> DataFrame:
    """Encode and decode in one pass: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    ``with_ids`` adds ``ids``, packed as in TextCodec; ``cache`` as in codec(). Nulls, repeats and empty tables as in
    encode().
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocab, pattern, cache)
        n, a, b, every = [], [], [], []
        for t in texts(batch.column(1)):
            ids = c.encode(t)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(c.decode(ids)).hexdigest())
            if with_ids:
                every.append(ids)
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays(cols + [pa.array(every, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    rows, kind = _with_text(df, id_col, text_col)
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return rows.mapInArrow(by_batch(run, "bpe", codec.cache_clear), schema).withColumnRenamed("id", id_col)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of what they decode to, of documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
