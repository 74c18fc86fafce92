"""Operator 1: removal of repeated byte strings by a hash-compared suffix sort.

A byte of a document is removed if some string of WIDTH bytes that covers it also starts in a document with a smaller
id. Sorting all suffixes of a corpus would move every byte WIDTH times over, so suffixes meet in buckets first:

1. Every string of WIDTH bytes has an anchor, its GRAM-byte substring of the least hash (leftmost). Equal strings
   have equal anchors at equal places, and consecutive strings share one, so there is one anchor in about 16 bytes.
   Each group of documents sends the hashes of its anchors, once each, to buckets, which answer with a bit for each
   hash whether it occurs in another
   document.
2. For those that do, a group sends the hash of the stretch of text whose strings have that anchor, equal stretches
   once with the smallest id, and learns whether a smaller document has the same stretch (anchor and stretch: two
   64-bit hashes; then all its strings repeat) and whether the anchor stands in other stretches too.
3. Only first stretches whose anchor has others send their text. Where an anchor has many, as at the ends of a passage
   that a third of all documents hold, they send their strings one by one instead, dealt by the string's own hash.
4. A bucket sorts the suffixes that start at its strings: bottom-up mergesort, all pairs of runs at once, in which two
   suffixes are compared by binary search for their common extension over prefix polynomial hashes. Neighbours whose
   extension reaches WIDTH are compared byte by byte, so a collision of hashes can't join them. Each run of equal
   strings has its smallest document; a bit for each string goes back to its group.
5. The groups mark what the strings cover, and hash what is left.

Shuffled are the texts (once, the exchange is reused), some bytes an anchor and a few repeated stretches; no task
holds more than a bucket or a group, whose sizes do not grow with the table, and nothing goes to the driver.

Null texts count as empty. Rows with equal ids don't make each other repeat, and answer for themselves; a null id is
larger than all. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

WIDTH, GRAM = 50, 20
SPAN = WIDTH - GRAM + 1
#: Bytes of input to a group, anchors to a bucket, and stretches from which on an anchor is sent string by string.
GROUP_BYTES, BUCKET_ANCHORS, MANY = 2 << 20, 200_000, 500
_LAST = np.int64(2**63 - 1)
_LOW = np.uint64(0xFFFFFFFF)


def anchors(data: np.ndarray, off: np.ndarray):
    """Of all strings of WIDTH bytes inside the rows: hash and place of each anchor, its first string and their count."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    prefix = common.prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    full = common.mix(span_hash := (prefix[GRAM:] - prefix[:-GRAM]) * common.powers(n)[1][: n - GRAM + 1])
    del span_hash, prefix
    key = (full & ~_LOW) | at.astype(np.uint64)
    m = key
    for step in (1, 2, 4, 8):
        m = np.minimum(m[:-step], m[step:])
    least = np.minimum(m[: len(m) - (SPAN - 16)], m[SPAN - 16 :])  # of SPAN grams, as 16 + 15 overlapping
    start = np.ones(n - WIDTH + 1, dtype=bool)
    for e in off[1:-1]:
        start[max(0, e - WIDTH + 1) : e] = False
    starts = np.flatnonzero(start)
    place = (least[starts] & _LOW).astype(np.int64)
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(place)))
    return full[place[first]], place[first], starts[first], count


class Group:
    """The documents of a group with their anchors."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, off: np.ndarray):
        self.ids, self.data, self.off = ids, data, off
        parts = []
        for lo, hi in common.chunks(off):
            h, place, start, count = anchors(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            parts.append((h, place + off[lo], start + off[lo], count))
        self.hash, self.place, self.start, self.count = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else [()] * 4))
        self.hash = self.hash.astype(np.uint64)
        self.doc = ids[np.searchsorted(off, self.start, side="right") - 1] if len(self.start) else np.zeros(0, np.int64)

    @classmethod
    def of(cls, table: pa.Table) -> Group:
        ids = np.array([_LAST if x is None else x for x in table.column("doc_id").to_pylist()], dtype=np.int64)
        return cls(ids, *common.as_bytes(table.column("text")))

    def shorts(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different hashes cut to bucket and 32 bits, sorted; whether in two documents here; each anchor's place in them."""
        cut = self.hash >> np.uint64(32 - bits)
        keys, first, inverse = np.unique(cut, return_index=True, return_inverse=True)
        more = np.zeros(len(keys), dtype=bool)
        more[inverse[self.doc != self.doc[first[inverse]]]] = True
        return keys, more, inverse

    def stretches(self, shared: np.ndarray, bits: int) -> Stretches:
        """The stretches of the shared anchors, equal ones once."""
        _, _, inverse = self.shorts(bits)
        use = np.flatnonzero(shared[inverse])
        key, start, count, ids = self.hash[use], self.start[use], self.count[use], self.doc[use]
        offset = self.place[use] - start
        stretch = self.hashes(start, count + WIDTH - 1)
        order = np.lexsort((start, ids, offset, count, stretch, key))
        return Stretches(*(x[order] for x in (key, stretch, count, offset, ids, start)), bits)

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hashes of stretches of text, none of which crosses two documents."""
        out = np.empty(len(start), np.uint64)
        for lo, hi in common.chunks(self.off):
            base = self.off[lo]
            inside = np.flatnonzero((start >= base) & (start < self.off[hi]))
            if len(inside):
                prefix = common.prefix_hash(self.data[base : self.off[hi]])
                a = start[inside] - base
                out[inside] = common.mix(common.span_hash(prefix, a, a + length[inside]))
        return out


class Stretches:
    """Different stretches (sorted by anchor and hash) with their smallest id, and their occurrences."""

    def __init__(self, key, stretch, count, offset, ids, start, bits: int):
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1]) | (count[1:] != count[:-1]) | (offset[1:] != offset[:-1])
        head = np.flatnonzero(new)
        self.key, self.hash, self.count, self.offset, self.ids, self.start = (x[head] for x in (key, stretch, count, offset, ids, start))
        self.owner, self.own_ids, self.own_start = np.cumsum(new) - 1, ids, start
        self.bucket = _bucket(self.key, bits)
        self.base = np.cumsum(self.count) - self.count

    def sent(self, group: Group, repeated: np.ndarray, mixed: np.ndarray, many: np.ndarray, bits: int):
        """What goes to the sort: (bucket, key, smallest id, first string, strings, offset) by bucket, and of each its
        strings' places among all strings of the stretches: (item, place, id)."""
        own = np.flatnonzero(~repeated & mixed & ~many)
        apart = np.flatnonzero(~repeated & mixed & many)
        inner = _ranges(self.count[apart])
        e = np.repeat(apart, self.count[apart])
        start = self.start[e] + inner
        h = group.hashes(start, np.full(len(start), WIDTH))
        order = np.lexsort((inner, e, self.ids[e], h))
        h, e, inner, start = h[order], e[order], inner[order], start[order]
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        key = np.concatenate([self.key[own], h[head]])
        ids = np.concatenate([self.ids[own], self.ids[e[head]]])
        first = np.concatenate([self.start[own], start[head]])
        count = np.concatenate([self.count[own], np.ones(len(head), np.int64)])
        offset = np.concatenate([self.offset[own], np.zeros(len(head), np.int64)])
        rank = np.argsort(key, kind="stable")
        back = np.empty(len(rank), np.int64)
        back[rank] = np.arange(len(rank))
        base = np.cumsum(count[rank]) - count[rank]
        # Places of the items' strings, in the order of the items, and what stretch strings they answer.
        whole_at = np.repeat(base[back[: len(own)]], self.count[own]) + _ranges(self.count[own])
        whole_to = np.repeat(self.base[own], self.count[own]) + _ranges(self.count[own])
        item = len(own) + np.cumsum(new) - 1
        at = np.concatenate([whole_at, base[back[item]] if len(item) else np.zeros(0, np.int64)])
        to = np.concatenate([whole_to, self.base[e] + inner])
        later = np.concatenate([np.zeros(len(whole_at), bool), self.ids[e] > ids[item] if len(item) else np.zeros(0, bool)])
        return (_bucket(key[rank], bits), key[rank], ids[rank], first[rank], count[rank], offset[rank]), (at, to, later)


def _bucket(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _edges(bucket: np.ndarray):
    """Begin and end of each bucket in sorted buckets."""
    if not len(bucket):
        return []
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=True))


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, in one array."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) - np.repeat(ends - counts, counts)


def extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """Lengths up to `most` of the common extensions of the suffixes at a and b: binary search over prefix hashes."""
    inverse = common.powers(len(prefix))[1]
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    pa_, pb_, ia, ib = prefix[a], prefix[b], inverse[a], inverse[b]
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) // 2
        same = (prefix[a[open_] + mid] - pa_[open_]) * ia[open_] == (prefix[b[open_] + mid] - pb_[open_]) * ib[open_]
        low[open_[same]] = mid[same]
        high[open_[~same]] = mid[~same] - 1


def suffix_order(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order that sorts the suffixes at start within each group (groups are consecutive), stable. Bottom-up
    mergesort: an element's place after a merge is its rank in its own run plus its rank in the other, found by binary
    search with hash-compared suffixes; all runs of all groups merge at once."""
    n = len(start)
    order = np.arange(n)
    if n < 2:
        return order
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, n))
    base, length = np.repeat(first, size), np.repeat(size, size)
    rank, run = _ranges(size), 1
    while run < size.max():
        active = np.flatnonzero(length > run)
        r = rank[active]
        left = (r // run) % 2 == 0
        begin = np.where(left, (r // run + 1) * run, (r // run - 1) * run)
        end = np.minimum(begin + run, length[active])
        have = begin < end
        active, r, left, begin, end = (x[have] for x in (active, r, left, begin, end))
        lo, hi, mine = begin.copy(), end.copy(), start[order[active]]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            other = start[order[base[active[open_]] + mid]]
            e = extension(prefix, mine[open_], other)
            x, y = data[np.minimum(mine[open_] + e, len(data) - 1)], data[np.minimum(other + e, len(data) - 1)]
            equal = e >= WIDTH
            # Left elements go before equal right ones, which keeps the sort stable.
            after = np.where(equal, ~left[open_], x > y)
            lo[open_[after]] = mid[after] + 1
            hi[open_[~after]] = mid[~after]
        to = base[active] + np.where(left, r, r - run) + (lo - begin)
        moved = order.copy()
        moved[to] = order[active]
        order = moved
        run *= 2
    return order


def repeated(data: np.ndarray, start: np.ndarray, group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each string's equals in its group have one with a smaller id."""
    out = np.zeros(len(start), dtype=bool)
    by = np.argsort(group, kind="stable")
    g = group[by]
    edge = np.append(True, g[1:] != g[:-1])
    alone = edge & np.append(edge[1:], True)
    by = by[~alone]
    if not len(by):
        return out
    prefix = common.prefix_hash(data)
    by = by[suffix_order(data, prefix, start[by], group[by])]
    s, g = start[by], group[by]
    same = np.zeros(len(by), dtype=bool)
    near = np.flatnonzero(g[1:] == g[:-1])
    near = near[extension(prefix, s[near], s[near + 1]) >= WIDTH]
    view = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
    for at in range(0, len(near), 1 << 16):
        k = near[at : at + (1 << 16)]
        same[k + 1] = (view[s[k]] == view[s[k + 1]]).all(axis=1)  # collisions are told apart here
    head = np.flatnonzero(~same)
    least = np.minimum.reduceat(ids[by], head)[np.cumsum(~same) - 1]
    out[by] = least < ids[by]
    return out


def _pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


_ANSWER = "grp long, kind int, bucket long, one binary, two binary, three binary"
#: Kinds of answers: of anchors, of stretches, of strings.
_ANCHORS, _STRETCHES, _STRINGS = 1, 2, 3


def _told(table: pa.Table, kind: int, columns) -> pa.Table:
    """Answers to the rows of table: packed bits of each row."""
    n = table.num_rows
    columns = [*columns, *[[b""] * n] * (3 - len(columns))]
    return pa.table({"grp": table.column("grp"), "kind": pa.array([kind] * n, pa.int32()), "bucket": table.column("bucket"), **{c: pa.array(v, pa.binary()) for c, v in zip(("one", "two", "three"), columns, strict=True)}})


def _flags(answers: pa.Table, kind: int, bucket: np.ndarray, count: np.ndarray | None = None) -> list[np.ndarray]:
    """The bits of a kind of answers for what is sorted by bucket; count: bits of each."""
    ends = np.arange(len(bucket) + 1) if count is None else np.concatenate([[0], np.cumsum(count)])
    out = [np.zeros(int(ends[-1]), bool) for _ in range(3)]
    for k, b, *bits in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "one", "two", "three")), strict=True):
        if k == kind:
            lo, hi = ends[np.searchsorted(bucket, b)], ends[np.searchsorted(bucket, b, "right")]
            for flags, data in zip(out, bits, strict=True):
                if data:
                    flags[lo:hi] = _unpack(data, int(hi - lo))
    return out


def _shared(group: Group, answers: pa.Table, bits: int) -> Stretches:
    keys, _, _ = group.shorts(bits)
    return group.stretches(_flags(answers, _ANCHORS, (keys >> np.uint64(32)).astype(np.int64))[0], bits)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, the kept bytes."""
    size = common.input_bytes(docs, text)
    groups = max(1, size // GROUP_BYTES)
    bits = max(0, int(size * 2 // (16 * BUCKET_ANCHORS)).bit_length())
    rows = docs.select(F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)), F.lit(groups)), F.lit(groups)).alias("grp"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))

    def ask(key, table):
        keys, more, _ = Group.of(table).shorts(bits)
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        low, edges = (keys & _LOW).astype("<u4"), _edges(bucket)
        return pa.table({"grp": pa.array([key[0].as_py()] * len(edges), pa.int64()), "bucket": pa.array([int(bucket[a]) for a, _ in edges], pa.int64()), "keys": pa.array([low[a:b].tobytes() for a, b in edges], pa.binary()), "more": pa.array([_pack(more[a:b]) for a, b in edges], pa.binary())})

    def answer(key, table):
        own = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        sizes = [len(x) for x in own]
        _, inverse, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        more = np.concatenate([_unpack(x, n) for x, n in zip(table.column("more").to_pylist(), sizes, strict=True)])
        shared = counts > 1
        shared[inverse[more]] = True
        s, ends = shared[inverse], np.cumsum(sizes)
        return _told(table, _ANCHORS, [[_pack(s[e - n : e]) for e, n in zip(ends, sizes, strict=True)]])

    def ask_stretches(key, table, answers):
        s = _shared(Group.of(table), answers, bits)
        low, edges = (s.key >> np.uint64(32 - bits)).astype("<u4"), _edges(s.bucket)
        out = {"keys": low, "stretches": s.hash, "ids": s.ids}
        return pa.table({"grp": pa.array([key[0].as_py()] * len(edges), pa.int64()), "bucket": pa.array([int(s.bucket[a]) for a, _ in edges], pa.int64()), **{n: pa.array([x[a:b].tobytes() for a, b in edges], pa.binary()) for n, x in out.items()}})

    def answer_stretches(key, table):
        """Of each stretch: whether a smaller document has it, whether its anchor has others, whether many."""
        keys, stretches, ids = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", "<u4"), ("stretches", np.uint64), ("ids", np.int64)))
        sizes = [len(x) // 8 for x in table.column("ids").to_pylist()]
        order = np.lexsort((ids, stretches, keys))
        k, h, i = keys[order], stretches[order], ids[order]
        edge = np.append(True, k[1:] != k[:-1])
        new = edge | np.append(True, h[1:] != h[:-1])
        head = np.flatnonzero(new)
        repeated = i > i[head][np.cumsum(new) - 1]
        kinds = np.bincount(np.cumsum(edge) - 1, weights=new)[np.cumsum(edge) - 1]
        flags = [np.empty(len(order), bool) for _ in range(3)]
        for f, v in zip(flags, (repeated, kinds > 1, kinds > MANY), strict=True):
            f[order] = v
        # Of equal stretches with equal ids in two groups (rows of one id) both stay: neither repeats the other.
        ends = np.cumsum(sizes)
        return _told(table, _STRETCHES, [[_pack(f[e - n : e]) for e, n in zip(ends, sizes, strict=True)] for f in flags])

    def send(key, table, answers):
        group = Group.of(table)
        s = _shared(group, answers, bits)
        (bucket, k, ids, start, count, offset), _ = s.sent(group, *_flags(answers, _STRETCHES, s.bucket), bits)
        out = {"grp": [], "bucket": [], "keys": [], "ids": [], "counts": [], "offsets": [], "text": []}
        for a, b in _edges(bucket):
            length = count[a:b] + WIDTH - 1
            place = np.repeat(start[a:b], length) + _ranges(length)
            for name, value in (("grp", key[0].as_py()), ("bucket", int(bucket[a])), ("keys", k[a:b].tobytes()), ("ids", ids[a:b].tobytes()), ("counts", count[a:b].astype(np.uint8).tobytes()), ("offsets", offset[a:b].astype(np.uint8).tobytes()), ("text", group.data[place].tobytes())):
                out[name].append(value)
        return pa.table({n: pa.array(v, pa.int64() if n in ("grp", "bucket") else pa.binary()) for n, v in out.items()})

    def sort(key, table):
        parts = {n: table.column(n).to_pylist() for n in ("keys", "ids", "counts", "offsets", "text")}
        sizes = [len(x) // 8 for x in parts["keys"]]
        k, ids = (np.frombuffer(b"".join(parts[n]), t) for n, t in (("keys", np.uint64), ("ids", np.int64)))
        count, offset = (np.frombuffer(b"".join(parts[n]), np.uint8).astype(np.int64) for n in ("counts", "offsets"))
        data = np.frombuffer(b"".join(parts.pop("text")), np.uint8)
        length = count + WIDTH - 1
        base = np.cumsum(length) - length
        alike = np.repeat(np.arange(len(k)), count)
        inner = _ranges(count)
        # Equal strings have their anchor at the same offset, so a suffix group is an anchor and an offset in it.
        whole = common.mix(k[alike] + (offset[alike] - inner + 1).astype(np.uint64))
        out = np.zeros(len(alike), dtype=bool)
        order = np.argsort(k, kind="stable")
        # Slices at borders of keys bound the memory of a sort.
        weight, last, lo = np.cumsum(length[order]), np.append(k[order][1:] != k[order][:-1], True) if len(k) else np.zeros(0, bool), 0
        cuts = np.flatnonzero(last) + 1
        string_base = np.cumsum(count) - count
        while lo < len(order):
            done = weight[lo - 1] if lo else 0
            hi = int(cuts[min(np.searchsorted(cuts, max(lo + 1, np.searchsorted(weight, done + (2 << 20)))), len(cuts) - 1)])
            e = order[lo:hi]
            place = np.repeat(base[e], length[e]) + _ranges(length[e])
            strings = np.repeat(string_base[e], count[e]) + _ranges(count[e])
            local = np.repeat(np.cumsum(length[e]) - length[e], count[e]) + _ranges(count[e])
            out[strings] = repeated(data[place], local, whole[strings], ids[alike[strings]])
            lo = hi
        ends = np.cumsum([0, *sizes])
        total = np.append(string_base, count.sum())
        return _told(table, _STRINGS, [[_pack(out[total[a] : total[b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]])

    def cut(key, table, answers):
        group = Group.of(table)
        s = _shared(group, answers, bits)
        repeated_, mixed, many = _flags(answers, _STRETCHES, s.bucket)
        (bucket, _, _, _, count, _), (at, to, later) = s.sent(group, repeated_, mixed, many, bits)
        hit = np.repeat(repeated_, s.count)
        hit[to] |= _flags(answers, _STRINGS, bucket, count)[0][at] | later
        n = s.count[s.owner]
        inner = _ranges(n)
        gone = hit[np.repeat(s.base[s.owner], n) + inner] | np.repeat(s.own_ids > s.ids[s.owner], n)
        place = (np.repeat(s.own_start, n) + inner)[gone]
        size = len(group.data)
        change = np.bincount(place, minlength=size + 1) - np.bincount(place + WIDTH, minlength=size + 1)[: size + 1]
        removed = np.cumsum(change)[:size] > 0
        before = np.concatenate([[0], np.cumsum(removed)])
        first = removed.copy()
        first[1:] &= ~removed[:-1]
        starts = group.off[:-1][group.off[:-1] < group.off[1:]]
        first[starts] = removed[starts]
        spans = np.concatenate([[0], np.cumsum(first)])
        kept = group.data[~removed]
        kept_at = group.off - before[group.off]
        raw = kept.tobytes()
        pieces = [raw[a:b] for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)]
        out = {"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(group.off), pa.int64()), "n_removed": pa.array(np.diff(before[group.off]), pa.int64()), "n_spans": pa.array(np.diff(spans[group.off]), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in pieces], pa.string())}
        if keep_text:
            out["kept"] = pa.array(pieces, pa.binary())
        return pa.table(out)

    by_group = rows.groupBy("grp")
    asked = by_group.applyInArrow(ask, "grp long, bucket long, keys binary, more binary")
    told = asked.groupBy("bucket").applyInArrow(answer, _ANSWER)
    asked = by_group.cogroup(told.groupBy("grp")).applyInArrow(ask_stretches, "grp long, bucket long, keys binary, stretches binary, ids binary")
    told = told.unionByName(asked.groupBy("bucket").applyInArrow(answer_stretches, _ANSWER))
    sent = by_group.cogroup(told.groupBy("grp")).applyInArrow(send, "grp long, bucket long, keys binary, ids binary, counts binary, offsets binary, text binary")
    told = told.unionByName(sent.groupBy("bucket").applyInArrow(sort, _ANSWER))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return by_group.cogroup(told.groupBy("grp")).applyInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
