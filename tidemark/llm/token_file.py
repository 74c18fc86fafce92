"""Operator 2: token ids as Arrow stream files of fixed-size-list batches.

A file set has shards; each shard is two Arrow IPC streams: `ids-N.arrows` with columns `ids` (fixed-size lists of
`length` unsigned integers) and `mask` (fixed-size lists of booleans, false on the padding of a shard's last
sequence), and `docs-N.arrows` with each document's id and token count in order. All batches but the last of a shard
have `rows` sequences, so that a memory-mapped file gives any sequence by its position without copying. Ids are
16-bit where the vocabulary fits, else 32-bit. Shards hold ascending ranges of doc_id.

Nulls: a null text is an empty document (only the end id); a null doc_id sorts first. Repeated rows are written
once each. Empty tables give no shards.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

LENGTH, ROWS, END_ID = 2048, 64, 2
#: Words of which a task keeps the ids; the memory is then bounded and the words that come again and again are few.
CACHE_WORDS, CACHE_PIECES = 300_000, 900_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the rest from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b) if b in plain else chr(256 + sum(x not in plain for x in range(b))) for b in range(256)]


class PieceIds(dict):
    """Ids of lower-cased pieces that the pre-tokenizer would not split, as packed bytes; forgets all when full. The
    vocabulary's merge model is called directly: normaliser and pre-tokenizer would leave such a piece as it is."""

    def __init__(self, tokenizer, dtype: str):
        super().__init__()
        self.model, self.dtype, self.letters = tokenizer.model, dtype, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        letters = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
        out = self[piece] = array(self.dtype, [x.id for x in self.model.tokenize(letters)]).tobytes()
        return out


class WordIds(dict):
    """Ids of words between blanks as packed bytes. No token of the vocabulary crosses white space, so a text's ids
    are those of its words in order. Words of plain letters, digits and signs are further split where the
    vocabulary's own pre-tokenizer splits them (letters, single digits, other signs) and looked up in lower case."""

    def __init__(self, tokenizer, dtype: str):
        super().__init__()
        self.tokenizer, self.pieces = tokenizer, PieceIds(tokenizer, dtype)
        self.splits = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        # Above U+02FF normalisation may compose; U+0130 grows when lower-cased; ' and < start contractions and special tokens.
        self.whole = regex.compile(r"['<\u0130]|[^\x00-\u02ff]")
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
            self[""] = b""
        if self.whole.search(word):
            out = array(self.pieces.dtype, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            out = b"".join([self.pieces[x.lower()] for x in self.splits.findall(word)])
        self[word] = out
        return out

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_WORDS: dict[tuple[str, int], WordIds] = {}


def word_ids(tokenizer_path: str, end_id: int) -> tuple[WordIds, int]:
    """The cache of this Python worker, kept over its tasks, and the bytes of an id."""
    found = _WORDS.get((tokenizer_path, end_id))
    if found is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        width = 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        found = _WORDS[tokenizer_path, end_id] = WordIds(tokenizer, "H" if width == 2 else "I")
    return found, array(found.pieces.dtype).itemsize


def _fs(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _types(width: int, length: int) -> pa.Schema:
    item = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Appends documents to one shard, holding at most one batch of sequences."""

    def __init__(self, folder: str, shard: int, attempt: int, width: int, length: int, rows: int):
        self.fs, root = _fs(folder)
        self.final = [f"{root}/ids-{shard:05d}.arrows", f"{root}/docs-{shard:05d}.arrows"]
        self.draft = [f"{x}.{attempt}" for x in self.final]
        self.dtype, self.length, self.rows = np.dtype(f"<u{width}"), length, rows
        self.schema = _types(width, length)
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        self.fs.create_dir(root, recursive=True)
        self.out = [self.fs.open_output_stream(x) for x in self.draft]
        self.ids = pa.ipc.new_stream(self.out[0], self.schema)
        self.docs = pa.ipc.new_stream(self.out[1], self.docs_schema)
        self.left, self.size, self.n_docs, self.n_tokens = [], 0, 0, 0

    def add(self, doc_ids: list, texts: list[bytes]) -> None:
        counts = [len(x) // self.dtype.itemsize for x in texts]
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64())], schema=self.docs_schema))
        self.n_docs, self.n_tokens = self.n_docs + len(counts), self.n_tokens + sum(counts)
        self.left += texts
        self.size += sum(map(len, texts))
        full = self.length * self.rows * self.dtype.itemsize
        if self.size >= full:
            data = b"".join(self.left)
            end = len(data) // full * full
            for at in range(0, end, full):
                self._batch(np.frombuffer(data, self.dtype, full // self.dtype.itemsize, at), None)
            self.left, self.size = [data[end:]], len(data) - end

    def _batch(self, values: np.ndarray, real: int | None) -> None:
        mask = np.ones(len(values), dtype=bool)
        if real is not None:
            mask[real:] = False
        item = self.schema.field("ids").type.value_type
        self.ids.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(values, item), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.left), self.dtype)
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
        for x in (self.ids, self.docs, *self.out):
            x.close()
        for a, b in zip(self.draft, self.final, strict=True):
            self.fs.move(a, b)


def read_shard(folder: str, shard: int):
    """Yields (doc_id, its ids as uint32) of a shard, in order; batches are viewed, not copied."""
    fs, root = _fs(folder)
    local = isinstance(fs, pafs.LocalFileSystem)
    opened = pa.memory_map if local else fs.open_input_file
    with opened(f"{root}/ids-{shard:05d}.arrows") as f, opened(f"{root}/docs-{shard:05d}.arrows") as g:
        batches = iter(pa.ipc.open_stream(f))
        have = np.zeros(0, np.uint32)
        for docs in pa.ipc.open_stream(g):
            for doc_id, n in zip(docs.column(0).to_pylist(), docs.column(1).to_pylist(), strict=True):
                parts, size = [have], len(have)
                while size < n:
                    b = next(batches)
                    ids = b.column("ids").flatten().to_numpy(zero_copy_only=True)
                    mask = b.column("mask").flatten().to_numpy(zero_copy_only=False)
                    ids = ids if mask.all() else ids[mask]
                    parts.append(ids)
                    size += len(ids)
                have = np.concatenate(parts) if len(parts) > 1 else have
                yield doc_id, have[:n].astype("<u4")
                have = have[n:]


def sequence_at(path: str, index: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence `index` of a shard's ids file and its mask, straight from the memory map."""
    with pa.memory_map(path) as f:
        reader = pa.ipc.open_stream(f)
        for b in reader:
            if index < b.num_rows:
                return b.column("ids")[index].values.to_numpy(), b.column("mask")[index].values.to_numpy(zero_copy_only=False)
            index -= b.num_rows
    raise IndexError(index)


def write(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Writes the file set into `folder`, a URI that all executors reach. Returns a row per shard: shard, n_docs, n_tokens.

    One range shuffle by id puts the documents in order; each task writes its shard under a name of its attempt and
    renames it when whole, so a lost executor leaves no half shard behind."""

    def task(batches):
        words, width = word_ids(tokenizer_path, end_id)
        end = int(end_id).to_bytes(width, "little")
        context, writer = TaskContext.get(), None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                if writer is None:
                    writer = ShardWriter(folder, context.partitionId(), context.taskAttemptId(), width, length, rows)
                writer.add(part.column(0).to_pylist(), [words.text(x) + end for x in part.column(1).to_pylist()])
        if writer is not None:
            writer.close()
            yield pa.record_batch({"shard": pa.array([context.partitionId()], pa.int32()), "n_docs": pa.array([writer.n_docs], pa.int64()), "n_tokens": pa.array([writer.n_tokens], pa.int64())})

    spark = docs.sparkSession
    n = max(1, common.input_bytes(docs, text) // (16 << 20), min(spark.sparkContext.defaultParallelism, 8))
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows_in.repartitionByRange(int(n), "doc_id").sortWithinPartitions("doc_id")
    return common.written(ordered.mapInArrow(task, "shard int, n_docs long, n_tokens long"), "shards")


def read(spark: SparkSession, shards: DataFrame, folder: str) -> DataFrame:
    """A row per document of a file set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    from pyspark.sql import Window

    # One row per shard, so a single ordered window is small however many documents there are.
    base = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = max(1, shards.count())

    def task(batches):
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, starts, counts, sums = [], [], [], []
                for doc_id, tokens in read_shard(folder, shard):
                    ids.append(doc_id)
                    starts.append(start)
                    counts.append(len(tokens))
                    sums.append(zlib.crc32(tokens.tobytes()))
                    start += len(tokens)
                    if len(ids) >= 10_000:
                        yield pa.record_batch([pa.array(x, pa.int64()) for x in (ids, starts, counts, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        ids, starts, counts, sums = [], [], [], []
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (ids, starts, counts, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return base.select("shard", "base").repartition(n, "shard").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.fresh_path(spark, "token-files")
    shards = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read(spark, shards, folder)
