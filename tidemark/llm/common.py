"""What the training-data operators share: shared folders, sizing, byte and word arrays.

Conventions of all operators here: a null text counts as empty unless an operator says otherwise; input columns
other than the named ones are ignored, so extra or clashing names do no harm; empty tables give empty results.
"""

from __future__ import annotations

import contextlib
import ctypes
import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir, written  # noqa: F401

#: The odd base of all polynomial prefix hashes (mod 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def input_bytes(df: DataFrame, text: str) -> int:
    """Bytes of the texts: Spark's own size estimate where it has one, else a sum over the column."""
    try:
        size = int(df.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())
    except Exception:  # noqa: BLE001  a plan without statistics
        size = 1 << 62
    if size >= 1 << 50:
        size = int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])
    return size


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves the remainder 1 by 3: rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(df: DataFrame, key: str, stratum: str, most: int, seed: int = 7) -> DataFrame:
    """At most `most` rows of each value of stratum, chosen by a hash of the key: a first filter leaves about twice as
    many, so that only a bounded number of rows is ranked."""
    from pyspark.sql import Window

    counts = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(stratum) == F.lit(value), F.lit(min(1.0, 2.0 * most / n + 50.0 / n))).otherwise(rate)
    inner = [f"_sample_{c}_{uuid.uuid4().hex[:8]}" for c in "hr"]  # no column of df has these names
    few = df.withColumn(inner[0], h).where(F.pmod(F.col(inner[0]), F.lit(1_000_003)) < rate * 1_000_003)
    ranked = few.withColumn(inner[1], F.row_number().over(Window.partitionBy(stratum).orderBy(inner[0], key)))
    return ranked.where(F.col(inner[1]) <= most).drop(*inner)


_THRIFTY: list[bool] = []


def thrifty() -> None:
    """For tasks that run in long pipelines, once a process: arrays from a MB on are mapped one by one and go back to the system when they are freed: Python workers live on
    after a task, idle ones too, and what each keeps of its largest task would add up. Where the C library has no such
    switch, nothing changes. It costs time, so only the operators that need it call it."""
    if _THRIFTY:
        return
    _THRIFTY.append(True)
    with contextlib.suppress(OSError, AttributeError):
        libc, mapped, trimmed = ctypes.CDLL(None), -3, -1  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
        libc.mallopt(mapped, 1 << 20)
        libc.mallopt(trimmed, 1 << 20)
    pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """Gives what is free now back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def learned(rows: DataFrame, learn):
    """learn(table) of a bounded sample, run in one task of an executor, so that the driver only holds its result."""
    schema = rows.schema

    def task(batches):
        batches = list(batches)
        yield pa.record_batch([pa.array([pickle.dumps(learn(pa.Table.from_batches(batches)) if batches else None)], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(task, "model binary").collect()
    model = next((m for r in got if (m := pickle.loads(r["model"])) is not None), None)
    return learn(empty_table(schema)) if model is None else model


def empty_table(schema) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i up to n at least."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        for key, base in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, np.uint64(base), dtype=np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[key] = p
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes H with H[0] = 0 and H[i+1] = H[i] + (data[i] + 1) * BASE**i."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of the spans start..end."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def as_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    buffer = col.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows whose bytes sum up to about `most`; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, spans: bool = False) -> tuple:
    """Hashes of all words (split at ASCII white space; A-Z lower-cased if lower) and the n + 1 word offsets of the rows;
    with spans also where the words start and end."""
    n = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), *([none, none] if spans else [])
    solid = ~_SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.ones(len(data) + 1, dtype=bool)
    after[:-1] = ~solid
    after[first] = True
    ends = np.flatnonzero(solid & after[1:]) + 1
    hashes = mix(span_hash(prefix_hash(_LOWER[data] if lower else data), starts, ends))
    return hashes, np.searchsorted(starts, offsets), *([starts, ends] if spans else [])


_ROLL = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order (a shorter row's whole sequence as one) and each one's row."""
    n, counts = len(woff) - 1, np.diff(woff)
    row = np.repeat(np.arange(n), counts)
    out, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= k:
        h = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            h = h * _ROLL + words[j : len(words) - k + 1 + j]
        same = row[: len(h)] == row[k - 1 :]
        out, rows = mix(h[same] ^ np.uint64(k)), row[: len(h)][same]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] = extra[has] * _ROLL + words[woff[short[has]] + j]
        extra = mix(extra ^ (counts[short].astype(np.uint64) << np.uint64(56)))
        out, rows = np.concatenate([out, extra]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows
