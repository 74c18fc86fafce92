"""Operator 10: exact Jaccard similarity join of word n-gram sets, and its connected components.

Two documents link if their Jaccard distance is at most 1 - threshold. Distances between unrelated texts are all 1, so
documents can't serve as pivots: every document would lie in every window. The pivots are single shingles instead.
The distance of a set A to the pivot {s} is 1 - 1/|A| if A holds s, else 1, so the nearest pivots of A are its own
shingles, and a total order of the pivots breaks the ties; all sets nearest to a pivot are its Voronoi region.

* Window: if A and B are within the distance, A has at most floor((1 - threshold) * |A|) shingles that B lacks. So
  their first common pivot is one of the first floor(...) + 1 of either, and A is replicated into those regions only.
* Size window: the triangle inequality over the empty set bounds the sizes, threshold <= |A| / |B| <= 1 / threshold.
* Order: pivots that fewer documents hold come first. Documents count every shingle of the corpus to order them, and
  a shingle of one document can't be common, so a document with more of those than its window is out at once.
* Recursion: a document first meets those of its home region (least hash among its shared shingles), whose links are
  verified on whole sets and joined to components; ROUNDS times, each with another hash and only in regions that still
  hold two components. The regions of the windows are then joined, again only those with two components, and only
  pairs of different components whose bounds allow a link.
* Exact: a pair is linked only if 100 * intersection >= 100 * threshold * union on the sets (64-bit shingle hashes).

Identical sets are one node from the start. Hot groups: minima are pre-aggregated, home regions above MANY documents
are split by a hash (the windows join what the parts miss), windows are split by size. Nothing goes to the driver.

Null or wordless texts have 0 shingles and link with nothing; rows of equal ids are one node; rows with a null id keep
a null component; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.operators.graph import components
from tidemark.session import dealt, release

WORDS, THRESHOLD = 4, 85
GROUP_BYTES, BUCKET_SHINGLES, MANY, CELLS, ROUNDS = 2 << 20, 400_000, 1000, 64, 3


def sets(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' distinct shingle hashes, sorted within each row, and the n + 1 offsets."""
    hashed, woff = common.word_hashes(data, off)
    h, row = common.shingles(hashed, woff, words)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(off)))


def window(n: int, threshold: int) -> int:
    """How many shingles of a set of n a linked set can lack."""
    return n - -(-n * threshold // 100)


def histogram(s: np.ndarray) -> np.ndarray:
    """Shingles per cell of the hash space; sums of two sets' minima bound their intersection."""
    return np.bincount((s >> np.uint64(32)) % np.uint64(CELLS), minlength=CELLS).astype(np.uint32)


def linked(shared: int, a: int, b: int, threshold: int) -> bool:
    return 100 * shared >= threshold * (a + b - shared)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


class Union:
    """Disjoint sets of the places 0..n-1; the least is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def runs(batches, names: list[str]):
    """Tables of the rows of equal keys, from batches that are sorted by the columns names."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        key = np.zeros(table.num_rows - 1, dtype=bool)
        for name in names:
            v = table.column(name).to_numpy()
            key |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(key) + 1).tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                yield table.slice(a, b - a)
        rest = table.slice(edges[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest


def _bits(n: int) -> int:
    return max(0, int(n).bit_length())


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; threshold in hundredths."""
    spark = docs.sparkSession
    size = common.input_bytes(docs, text)
    groups = max(1, size // GROUP_BYTES)
    bits = _bits(size // 4 // BUCKET_SHINGLES)
    rows = docs.select(F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)), F.lit(groups)), F.lit(groups)).alias("grp"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def sign(batches):
        """Each document's set size and fingerprint."""
        common.thrifty()
        for batch in batches:
            data, off = common.as_bytes(batch.column(1))
            for lo, hi in common.chunks(off):
                h, soff = sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                n = np.diff(soff)
                prints = []
                for seed in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(h + np.uint64(seed)), dtype=np.uint64)])
                    prints.append((total[soff[1:]] - total[soff[:-1]]).view(np.int64))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(prints[0]), pa.array(prints[1])], names=["doc_id", "n_shingles", "f1", "f2"])
        common.trim()

    signed = common.written(rows.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, f1 long, f2 long"), "signatures")
    reps = signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    told = reps.select(F.pmod(F.xxhash64("rep", F.lit(groups)), F.lit(groups)).alias("grp"), F.lit(0).alias("kind"), F.col("rep").alias("bucket"), F.lit(None).cast("binary").alias("one"))

    def chosen(table, answers):
        """The group's representatives: ids, sets and offsets; all different shingles, sorted; the answers' rows."""
        kinds, buckets = answers.column("kind").to_numpy(), answers.column("bucket").to_numpy()
        ids = np.array([-1 if x is None else x for x in table.column("doc_id").to_pylist()], dtype=np.int64)
        valid = np.array([x is not None for x in table.column("doc_id").to_pylist()], dtype=bool)
        keep = np.flatnonzero(np.isin(ids, buckets[kinds == 0]) & valid)
        order = keep[np.argsort(ids[keep], kind="stable")]
        data, off = common.as_bytes(table.column("text").combine_chunks().take(pa.array(order, pa.int64())))
        hs, offs, at = [], [np.zeros(1, np.int64)], 0
        for lo, hi in common.chunks(off):
            h, soff = sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
            hs.append(h)
            offs.append(soff[1:] + at)
            at += len(h)
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        return ids[order], h, np.concatenate(offs)

    def ask(key, table, answers):
        common.thrifty()
        _, h, _ = chosen(table, answers)
        keys, counts = np.unique(h >> np.uint64(32 - bits), return_counts=True)
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(bucket)) if len(bucket) else first
        low, some = (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), np.minimum(counts, 65535).astype("<u2")
        return pa.table({"grp": pa.array([key[0].as_py()] * len(first), pa.int64()), "bucket": pa.array(bucket[first], pa.int64()), "keys": pa.array([low[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()), "counts": pa.array([some[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())})

    def answer(key, table):
        """For each shingle a byte: 0 if one document has it, else 8 times the base-2 logarithm of their number, rounded up."""
        own = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        _, inverse = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, "<u2") for x in table.column("counts").to_pylist()]))
        level = np.minimum(np.ceil(8 * np.log2(total)), 255).astype(np.uint8)[inverse]
        ends = np.cumsum([len(x) for x in own])
        return pa.table({"grp": table.column("grp"), "kind": pa.array([1] * len(own), pa.int32()), "bucket": table.column("bucket"), "one": pa.array([level[e - len(x) : e].tobytes() for e, x in zip(ends, own, strict=True)], pa.binary())})

    def candidates(key, table, answers):
        """Documents that can link at all: their shared shingles, the rarest first."""
        common.thrifty()
        ids, h, off = chosen(table, answers)
        keys, inverse = np.unique(h >> np.uint64(32 - bits), return_inverse=True)
        bucket, level = (keys >> np.uint64(32)).astype(np.int64), np.zeros(len(keys), np.uint8)
        for k, b, one in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "one")), strict=True):
            if k == 1:
                lo, hi = np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right")
                level[lo:hi] = np.frombuffer(one, np.uint8)[: hi - lo]
        levels = level[inverse]
        out = {"doc_id": [], "n": [], "alone": [], "homes": [], "parts": [], "pivots": [], "shared": []}
        for i in range(len(ids)):
            s, lv = h[off[i] : off[i + 1]], levels[off[i] : off[i + 1]]
            n, common_ones = len(s), s[lv > 0]
            alone = n - len(common_ones)
            if not len(common_ones) or alone > window(n, threshold):
                continue
            lv = lv[lv > 0]
            order = np.lexsort((common_ones, lv))
            homes, places = [], []
            for seed in range(1, ROUNDS + 1):
                k = int(np.argmin(common.mix(common_ones ^ np.uint64(seed))))
                many = int(math.ceil(2 ** (lv[k] / 8) / MANY))
                homes.append(int(common_ones[k].view(np.int64)))
                places.append(int(common.mix(np.array([ids[i]]).astype(np.uint64) + np.uint64(seed))[0] % np.uint64(many)))
            out["doc_id"].append(int(ids[i]))
            out["n"].append(n)
            out["alone"].append(alone)
            out["homes"].append(homes)
            out["parts"].append(places)
            out["pivots"].append(common_ones[order][: window(n, threshold) + 1 - alone].view(np.int64).tolist())
            out["shared"].append(common_ones.tobytes())
        types = {"n": pa.int32(), "alone": pa.int32(), "homes": pa.list_(pa.int64()), "parts": pa.list_(pa.int32()), "pivots": pa.list_(pa.int64()), "shared": pa.binary()}
        return pa.table({c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})

    answers = "grp long, kind int, bucket long, one binary"
    asked = rows.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(ask, "grp long, bucket long, keys binary, counts binary")
    told = told.unionByName(asked.groupBy("bucket").applyInArrow(answer, answers))
    found = rows.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(candidates, "doc_id long, n int, alone int, homes array<long>, parts array<int>, pivots array<long>, shared binary")
    cand = common.written(found, "candidates")
    del found, asked, told
    release(spark)

    def at_home(batches):
        """Links of a region's documents, each verified on whole sets; documents already joined need no other."""
        for t in runs(batches, ["home", "part"]):
            n = t.column("n").to_numpy()
            order = np.argsort(n, kind="stable")
            n, comp = n[order], t.column("component").to_numpy()[order]
            shared = [np.frombuffer(x, np.uint64) for x in t.column("shared").take(pa.array(order, pa.int64())).to_pylist()]
            hist = np.array([histogram(s) for s in shared])
            u = Union(len(n))
            by = np.argsort(comp, kind="stable")
            for i, j in zip(by[1:].tolist(), by[:-1].tolist(), strict=True):
                if comp[i] == comp[j]:
                    u.join(i, j)
            low = np.searchsorted(n, np.ceil(n * threshold / 100 - 1e-9))
            for i in range(1, len(n)):
                lo = int(low[i])
                most = np.minimum(hist[lo:i], hist[i]).sum(axis=1, dtype=np.int64)
                near = lo + np.flatnonzero(100 * most >= threshold * (n[lo:i].astype(np.int64) + int(n[i]) - most))
                for j in near[np.argsort(-most[near - lo], kind="stable")].tolist():
                    if u.find(i) != u.find(j) and linked(overlap(shared[i], shared[j]), int(n[i]), int(n[j]), threshold):
                        u.join(i, j)
            # Stars around the least component of each set, so that few rounds join them.
            roots, least = [u.find(i) for i in range(len(n))], {}
            for r, c in zip(roots, comp.tolist(), strict=True):
                least[r] = min(c, least.get(r, c))
            pairs = {(c, least[r]) for r, c in zip(roots, comp.tolist(), strict=True) if c != least[r]}
            a, b = [x for x, _ in pairs], [x for _, x in pairs]
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        common.trim()

    first = None
    for k in range(ROUNDS):
        # Each round has other homes, by another hash; only regions that still hold two components meet again.
        here = cand.select(F.element_at("homes", k + 1).alias("home"), F.element_at("parts", k + 1).alias("part"), "doc_id", "n", "shared")
        if first is None:
            here = here.withColumn("component", F.col("doc_id")).repartition(parts, "home", "part")
        else:
            here = here.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            mixed = here.groupBy("home", "part").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("home", "part")
            here = here.repartition(parts, "home", "part").join(dealt(mixed), ["home", "part"], "left_semi")  # dealt once: the sets stay where this puts them
        home = here.select("home", "part", "doc_id", "n", "component", "shared").sortWithinPartitions("home", "part")
        links = home.mapInArrow(at_home, "a long, b long")
        if first is not None:
            links = links.unionByName(first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        first = common.written(components(links), "regions")
        del here, home, links
        release(spark)

    def cells(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([histogram(np.frombuffer(x, np.uint64)).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "cells"])

    comp = cand.select("doc_id").distinct().join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    step = math.log(100 / threshold) if threshold < 100 else 1.0
    # Regions that one component has to itself go first, whatever the sizes, so that only what is left is dealt twice.
    near = cand.select("doc_id", "n", "alone", "pivots").join(comp, "doc_id").select("doc_id", "n", "alone", "component", F.posexplode("pivots").alias("pos", "pivot"))
    shared = near.groupBy("pivot").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("pivot")
    spread = common.written(near.join(shared, "pivot", "left_semi").select("doc_id", "n", (F.col("pos") + F.col("alone")).alias("pos"), "component", "pivot", F.floor(F.log("n") / F.lit(step) + F.lit(1e-9)).cast("int").alias("cls")), "windows")
    del near, shared, comp
    release(spark)
    # A set meets those of its own size class and of the one below.
    spread = spread.withColumn("cls", F.explode(F.array("cls", F.col("cls") + 1)))
    open_ = spread.groupBy("pivot", "cls").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("pivot", "cls")
    still = spread.join(open_, ["pivot", "cls"], "left_semi")
    hist = cand.select("doc_id", "shared").mapInArrow(cells, "doc_id long, cells binary")
    still = still.join(hist, "doc_id").repartition(parts, "pivot", "cls").sortWithinPartitions("pivot", "cls")

    def pairs(batches):
        """Pairs of a region's different components that sizes, places and cells allow to link."""
        for t in runs(batches, ["pivot", "cls"]):
            ids, c, n, pos = (t.column(x).to_numpy() for x in ("doc_id", "component", "n", "pos"))
            order = np.argsort(n, kind="stable")
            ids, c, n, pos = ids[order], c[order], n[order].astype(np.int64), pos[order].astype(np.int64)
            cells_ = np.frombuffer(b"".join(t.column("cells").take(pa.array(order, pa.int64())).to_pylist()), np.uint32).reshape(len(n), CELLS)
            low = np.searchsorted(n, np.ceil(n * threshold / 100 - 1e-9))
            a, b = [], []
            for i in range(1, len(n)):
                lo = int(low[i])
                j = lo + np.flatnonzero((c[lo:i] != c[i]) & (ids[lo:i] != ids[i]))
                most = np.minimum(n[j] - pos[j], n[i] - pos[i])
                j = j[100 * most >= threshold * (n[j] + n[i] - most)]
                if len(j):
                    most = np.minimum(cells_[j], cells_[i]).sum(axis=1, dtype=np.int64)
                    j = j[100 * most >= threshold * (n[j] + n[i] - most)]
                    a += [int(ids[i])] * len(j)
                    b += ids[j].tolist()
            if a:
                yield pa.record_batch([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], names=["a", "b"])
        common.trim()

    def verified(batches):
        for batch in batches:
            keep = [i for i, (x, y, n, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shared", "shared2", "n", "m")), strict=True)) if linked(overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), n, m, threshold)]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(keep, pa.int64()))

    asked_for = still.mapInArrow(pairs, "a long, b long").distinct()
    full = asked_for.join(cand.select(F.col("doc_id").alias("a"), "shared", "n"), "a").join(cand.select(F.col("doc_id").alias("b"), F.col("shared").alias("shared2"), F.col("n").alias("m")), "b")
    second = full.select("a", "b", "shared", "shared2", "n", "m").mapInArrow(verified, "a long, b long")
    stars = first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = common.written(components(stars.unionByName(second)), "components")

    release(spark)
    classes = signed.join(reps, ["n_shingles", "f1", "f2"], "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    return classes.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
