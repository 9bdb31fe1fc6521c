"""Token ids as Arrow files of equal-length sequences and masks.

A shard is an Arrow IPC file whose batches hold two columns: ``tokens``, a fixed-size list
of unsigned ids, and ``mask``, a fixed-size list of booleans that is false where the last
sequence is padded. Memory-mapped, any sequence is a view of the file. Beside each shard
stands an index file with one row per document: doc_id, start (in the shard), n_tokens.

Documents are dealt to shards by ranges of their id and stand in ascending order. A task
writes files with names of its own and reports them only when it ends, so a task that is
run again leaves at most a file that no manifest names.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.bpe import Generations
from weftline.llm.common import begin, cut, own_folder, quoted, texts

SEQUENCE = 2048
#: Sequences in a batch.
BATCH = 128
#: Fixed value: the id that ends a document.
END_ID = 1

#: Entries of the caches of words and of pieces in one Python worker.
WORD_ENTRIES = 300_000
PIECE_ENTRIES = 150_000

# Fixed value: how the vocabulary's own splitter cuts lower-case text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: White space to Python, but ordinary characters to the tokenizer.
ODD_BLANKS = re.compile("[\x1c-\x1f]")
#: Up to here no character is changed by normal form C or joins with another.
LATIN = re.compile("[\x00-˿]*")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Words:
    """Ids of whole texts, from those of each distinct word between white space.

    The tokenizer drops white space and never joins what it separates, so a text's ids are
    those of its words. Words of Latin letters go straight to the library's merge model;
    any other word goes through its whole pipeline.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.code = "H" if self.full.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.letters = dict(enumerate(_byte_letters()))
        self.piece = Generations(self._piece, PIECE_ENTRIES)
        self.word = Generations(self._word, WORD_ENTRIES)

    def _piece(self, p: str) -> bytes:
        mapped = p.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _word(self, w: str) -> bytes:
        if "<|" not in w and LATIN.fullmatch(w):
            return b"".join(map(self.piece.__getitem__, PIECES.findall(w.lower())))
        return array(self.code, self.full.encode(w, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        words = re.split("[ \t\r\n]+", text) if ODD_BLANKS.search(text) else text.split()
        return b"".join(map(self.word.__getitem__, words))


@cache
def words(path: str) -> Words:
    return Words(path)


def _fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


class _Shard:
    """Packs documents into sequences and writes them batch by batch."""

    def __init__(self, uri: str, code: str, length: int):
        fs, path = _fs(uri)
        self.sink = fs.open_output_stream(path)
        self.kind = pa.uint16() if code == "H" else pa.uint32()
        self.length, self.step = length, length * BATCH * array(code).itemsize
        self.schema = pa.schema([("tokens", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.buffer = bytearray()

    def add(self, ids: bytes) -> None:
        self.buffer += ids
        while len(self.buffer) >= self.step:
            self._batch(bytes(self.buffer[: self.step]))
            del self.buffer[: self.step]

    def _batch(self, data: bytes) -> None:
        ids = np.frombuffer(data, self.kind.to_pandas_dtype())
        n = -(-len(ids) // self.length) * self.length
        mask = np.arange(n) < len(ids)
        ids = np.concatenate([ids, np.zeros(n - len(ids), ids.dtype)]) if n > len(ids) else ids
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        if self.buffer:
            self._batch(bytes(self.buffer))
        self.writer.close()
        self.sink.close()


class TokenFile:
    """Random access to a shard; on a local or mounted folder nothing is copied."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        self.file = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.file)
        self.length = self.reader.schema.field("tokens").type.list_size
        self._last = (-1, None)

    def _values(self, batch: int) -> np.ndarray:
        if self._last[0] != batch:
            self._last = (batch, self.reader.get_batch(batch).column(0).flatten().to_numpy())
        return self._last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``."""
        b = self.reader.get_batch(i // BATCH)
        return self._values(i // BATCH)[(i % BATCH) * self.length :][: self.length], b.column(1)[i % BATCH].values

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids from any place on, across sequences."""
        per, out = self.length * BATCH, []
        while n:
            got = self._values(start // per)[start % per :][:n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return np.concatenate(out) if len(out) != 1 else out[0]


def write(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Write token files; returns their manifest: shard, path, base, n_docs, n_tokens.

    ``base`` is the number of ids in all shards before. A null or empty text gives the end id
    alone; rows that repeat are each written; null ids come first; an empty table writes no
    file; other columns are ignored.
    """
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    kind = rows.schema["id"].dataType
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        begin("words", words.cache_clear)
        shard, path, out, n = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}.arrow", None, 0
        ids, starts, sizes = [], [], []
        w = words(tokenizer)
        end = array(w.code, [end_id]).tobytes()
        for b in batches:
            ids.append(b.column(0))
            for t in texts(b.column(1)):
                out = out or _Shard(path, w.code, length)
                got = w.ids(t) + end
                out.add(got)
                starts.append(n)
                sizes.append(len(got) // len(end))
                n += sizes[-1]
        if out is None:
            return
        out.close()
        index = pa.table({"doc_id": pa.chunked_array(ids).combine_chunks(), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
        fs, plain = _fs(path + ".index")
        with fs.open_output_stream(plain) as sink, pa.ipc.new_file(sink, index.schema) as writer:
            writer.write_table(index)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": pa.array([len(sizes)], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

    fs, plain = _fs(folder)
    fs.create_dir(plain, recursive=True)
    made = cut(rows.mapInArrow(run, "shard int, path string, n_docs bigint, n_tokens bigint"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    made = made.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "n_docs", "n_tokens")
    made.id_kind = kind.simpleString()
    return made


def read_back(manifest: DataFrame, id_kind: str = "bigint") -> DataFrame:
    """Per document, from the files: doc_id, start over all shards, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = TokenFile(path)
                fs, plain = _fs(path + ".index")
                with fs.open_input_file(plain) as f:
                    index = pa.ipc.open_file(f).read_all().combine_chunks()
                for part in index.to_batches(max_chunksize=10_000):
                    start, n = (part.column(k).to_numpy() for k in (1, 2))
                    crc = [zlib.crc32(tokens.tokens(int(s), int(k)).astype("<u4").tobytes()) for s, k in zip(start, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = manifest.count()
    todo = manifest.select("path", "base")
    return (todo.repartition(n, "path") if n > 1 else todo).mapInArrow(run, f"doc_id {id_kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 as read back from the token files of documents."""
    import public_tokenizers

    folder = own_folder(spark, "token-files")
    made = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_back(made, made.id_kind)
