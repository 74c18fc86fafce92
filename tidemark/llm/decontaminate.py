"""Operator 9: benchmark decontamination by size-partitioned MinHash containment search.

A test item is inside a document if at least `threshold` of its distinct k-word shingles (k is `words`, or the item's
own length if that is shorter) occur in the document. Items are partitioned by the power of two of their shingle
count, and a document meets only the partitions whose items are small enough to be contained in it. An item's sketch
holds, for each of HASHES seeded permutations, its smallest shingle. Such a shingle is a random one of the item, so
a document that contains the share t of the item holds none of the sketch with probability (1 - t) ** HASHES, 1.7e-17
at 0.8; items with up to HASHES shingles are sketched whole. Looking the sketches' shingles up in a document's own
set needs no signature of the (long) document. Every candidate is then verified on whole shingle sets.

Only a block of items is sent to the tasks, at most BLOCK_BYTES of item text; a larger benchmark takes more passes
over the documents. The pass over documents is narrow: no shuffle.

Null or wordless texts contain nothing and null or wordless items are contained nowhere; repeated rows answer each for
itself; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

WORDS, THRESHOLD, HASHES = 5, 0.8, 24
BLOCK_BYTES = 32 << 20
SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long"


class ItemIndex:
    """Sketches and shingle sets of a block of items, by shingle length."""

    def __init__(self, item_ids: list, texts: list, words: int, hashes: int):
        data, off = common.as_bytes(pa.array(texts, pa.string()))
        hashed, woff = common.word_hashes(data, off)
        counts = np.diff(woff)
        self.ids, self.by_k = item_ids, {}
        for k in range(1, words + 1):
            rows = np.flatnonzero(counts == k) if k < words else np.flatnonzero(counts >= k)
            if not len(rows):
                continue
            sets, keys, owners = {}, [], []
            for r in rows:
                own = hashed[woff[r] : woff[r + 1]]
                s = np.unique(common.shingles(own, np.array([0, len(own)]), k)[0])
                sets[int(r)] = s
                if len(s) > hashes:
                    seeds = common.mix(np.arange(1, hashes + 1, dtype=np.uint64))
                    s = np.unique(s[np.argmin(common.mix(s[None, :] ^ seeds[:, None]), axis=1)])
                keys.append(s)
                owners.append(np.full(len(s), r))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            part = {r: len(s).bit_length() for r, s in sets.items()}
            self.by_k[k] = (keys[order], owners[order], sets, part)
            bits = np.zeros(1 << 20, dtype=bool)
            bits[keys & np.uint64((1 << 20) - 1)] = True
            self.by_k[k] += (bits,)

    def search(self, words: np.ndarray, woff: np.ndarray, threshold: float):
        """Yields (row, item's row, its shingles, shared shingles)."""
        counts = np.diff(woff)
        for k, (keys, owners, sets, part, bits) in self.by_k.items():
            h, rows = common.shingles(words, woff, k)
            full = counts[rows] >= k
            maybe = np.flatnonzero(bits[h & np.uint64((1 << 20) - 1)] & full)
            at = np.searchsorted(keys, h[maybe])
            hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == h[maybe])
            if not hit.any():
                continue
            found: dict[int, set] = {}
            for r, v in zip(rows[maybe[hit]], h[maybe[hit]], strict=True):
                lo, hi = np.searchsorted(keys, v, "left"), np.searchsorted(keys, v, "right")
                found.setdefault(int(r), set()).update(owners[lo:hi].tolist())
            first = np.searchsorted(rows, np.arange(len(counts) + 1))
            for r, items in found.items():
                own = np.unique(h[first[r] : first[r + 1]])
                for item in sorted(items):
                    if threshold * (1 << max(0, part[item] - 1)) > len(own):
                        continue
                    s = sets[item]
                    shared = int(np.isin(s, own, assume_unique=True).sum())
                    if shared >= threshold * len(s) - 1e-9:
                        yield r, item, len(s), shared


def _indexes(spark: SparkSession, items: DataFrame, item_id: str, item_text: str, words: int, hashes: int):
    """A broadcast index for each block of items, of about BLOCK_BYTES of text."""
    own = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where(F.col("text").isNotNull())
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    for b in range(blocks):
        block = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if block:
            yield spark.sparkContext.broadcast(ItemIndex([x[0] for x in block], [x[1] for x in block], words, hashes))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, hashes: int = HASHES) -> DataFrame:
    """A row per document and item that it contains: doc_id, item_id, n_item_shingles, n_shared."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for shared in _indexes(spark, items, item_id, item_text, words, hashes):

        def task(batches, shared=shared):
            index = shared.value
            for batch in batches:
                data, off = common.as_bytes(batch.column(1))
                doc_ids, found = batch.column(0).to_pylist(), []
                for lo, hi in common.chunks(off):
                    hashed, woff = common.word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    found += [(doc_ids[lo + r], index.ids[item], n, k) for r, item, n, k in index.search(hashed, woff, threshold)]
                if found:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["doc_id", "item_id", "n_item_shingles", "n_shared"])

        part = rows.mapInArrow(task, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, hashes: int = HASHES) -> DataFrame:
    """The rows of docs that contain no item; columns as they are. Narrow."""
    place, schema = docs.columns.index(text), docs.schema
    for shared in _indexes(docs.sparkSession, items, item_id, item_text, words, hashes):

        def task(batches, shared=shared):
            index = shared.value
            for batch in batches:
                data, off = common.as_bytes(batch.column(place))
                keep = np.ones(batch.num_rows, dtype=bool)
                for lo, hi in common.chunks(off):
                    hashed, woff = common.word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    for r, *_ in index.search(hashed, woff, threshold):
                        keep[lo + r] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(task, schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT DISTINCT item_id, least(len(ws), 5) AS k, unnest(list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda j: array_to_string(ws[j:j + least(len(ws), 5) - 1], ' '))) AS sh FROM i WHERE len(ws) > 0),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM s GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM s),
t AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' '))) AS sh FROM d, ks WHERE len(ws) >= k)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_shared
FROM t JOIN s USING (k, sh) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item_shingles HAVING count(*) * 10 >= 8 * n_item_shingles
"""
