"""Operator 6: language identification by interpolated Kneser-Ney character models.

One model of order ORDER per language, over lower-cased letters with every other run as one blank. The models share
sorted arrays of n-gram hashes; beside each stand the languages' interpolated log probabilities, so that most
characters cost one binary search, and only unseen n-grams walk down the orders by their back-off weights. A text
gets the language of the lowest cross-entropy per character; ties go to the first name. The score is a softmax over
the entropies times the square root of the length, with a temperature fitted on a part of the sample that the models
do not see; texts that score below `min_score` are rejected as `und`.

The models learn from a bounded sample of labelled rows (SAMPLE whole documents a language, of up to SAMPLE_BYTES
each, by a hash of the id); everything else reads all rows. Prediction is narrow: no shuffle.

A null text or one without a letter is `und` with score 0; rows with a null language are not learned from; with no
labelled row at all everything is `und`; repeated rows are answered once each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

ORDER, SAMPLE, SAMPLE_BYTES, TOTAL_BYTES, DISCOUNT, REJECTED = 4, 800, 1 << 20, 4 << 20, 0.75, 0.002
UND = "und"
_LETTERS = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(1 << 16)])
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and single blanks of all texts, each text led by a blank; the n + 1 offsets; each text's letter count."""
    raw = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    cp = np.frombuffer(b"".join(b" \0\0\0" + x for x in raw), dtype="<u4")
    off = np.concatenate([[0], np.cumsum([len(x) // 4 + 1 for x in raw])]).astype(np.int64)
    is_letter = _LETTERS[np.minimum(cp, 0xFFFF)]
    for c in np.unique(cp[cp > 0xFFFF]):
        is_letter[cp == c] = chr(c).isalpha()
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[off[:-1]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    counts = np.concatenate([[0], np.cumsum(is_letter)])
    return np.where(is_letter, cp, 32)[keep].astype(np.uint64), before[off], counts[off[1:]] - counts[off[:-1]]


def grams(chars: np.ndarray, off: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hashes of the n-grams that end at each place; 0 where a text is too short before it."""
    out = [common.mix(chars + np.uint64(1))]
    place = np.arange(len(chars)) - np.repeat(off[:-1], np.diff(off))
    for n in range(2, order + 1):
        h = np.zeros(len(chars), np.uint64)
        if len(chars) >= n:
            h[n - 1 :] = common.mix(out[-1][n - 1 :] * _STEP + common.mix(chars[: len(chars) - n + 1] + np.uint64(n << 32)))
        h[place < n - 1] = 0
        out.append(h)
    return out


def contexts(chars: np.ndarray, off: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hashes of what stands before the last character of each n-gram (0: nothing)."""
    shifted = [np.concatenate([np.zeros(1, np.uint64), g[:-1]]) for g in grams(chars, off, max(1, order - 1))]
    first = off[:-1][off[:-1] < off[1:]]
    for s in shifted:
        s[first] = 0
    return [np.zeros(len(chars), np.uint64), *shifted[: order - 1]]


class Models:
    """The languages' models: for each order sorted n-gram hashes with log probabilities, sorted contexts with back-off weights."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER, discount: float = DISCOUNT):
        self.langs, self.order, self.temperature = sorted(samples), order, 1.0
        self.limits = np.full(64, np.inf)
        size = len(self.langs)
        per, alphabet = [], set()
        for lang in self.langs:
            chars, off, _ = letters(samples[lang])
            g, c = grams(chars, off, order), contexts(chars, off, order)
            alphabet.update(np.unique(chars).tolist())
            one = []
            for n in range(order, 0, -1):
                keys, at, counts = np.unique(g[n - 1], return_index=True, return_counts=True)
                if n < order:  # continuation counts: how many different characters stand before it
                    wider = one[-1]
                    ends, have = np.unique(g[n - 1][wider["at"]], return_counts=True)
                    counts = np.zeros(len(keys), np.int64)
                    counts[np.searchsorted(keys, ends)] = have
                    counts = np.maximum(counts, 1)
                seen = keys != 0
                keys, at, counts = keys[seen], at[seen], counts[seen]
                before = c[n - 1][at]
                ctx, inverse = np.unique(before, return_inverse=True)
                total = np.bincount(inverse, weights=counts)
                types = np.bincount(inverse)
                one.append({"keys": keys, "at": at, "own": np.maximum(counts - discount, 0) / total[inverse], "ctx": ctx, "weight": discount * types / total, "g": g, "c": c})
            per.append(one[::-1])
        self.floor = 1.0 / (len(alphabet) + 1)
        self.keys, self.logp, self.ctx, self.weight = [], [], [], []
        below = None
        for n in range(1, order + 1):
            keys = np.unique(np.concatenate([p[n - 1]["keys"] for p in per]))
            ctx = np.unique(np.concatenate([p[n - 1]["ctx"] for p in per]))
            weight = np.ones((len(ctx), size))
            for j, p in enumerate(per):
                weight[np.searchsorted(ctx, p[n - 1]["ctx"]), j] = p[n - 1]["weight"]
            own, before, shorter = np.zeros((len(keys), size)), np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            for j, p in enumerate(per):
                at = np.searchsorted(keys, p[n - 1]["keys"])
                own[at, j] = p[n - 1]["own"]
                before[at] = p[n - 1]["c"][n - 1][p[n - 1]["at"]]
                if n > 1:
                    shorter[at] = p[n - 1]["g"][n - 2][p[n - 1]["at"]]
            lower = np.full((len(keys), size), self.floor) if n == 1 else below[np.searchsorted(self.keys[-1], shorter)]
            prob = own + weight[np.searchsorted(ctx, before)] * lower
            below = prob
            self.keys.append(keys)
            self.logp.append(np.log(prob).astype(np.float32))
            self.ctx.append(ctx)
            self.weight.append(np.log(weight).astype(np.float32))

    def _at(self, n: int, keys: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Log probabilities of order n for the places whose n-gram and context hashes are given in lists by order."""
        out = np.empty((len(keys[n - 1]), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(self.keys[n - 1], keys[n - 1]), len(self.keys[n - 1]) - 1)
        hit = self.keys[n - 1][at] == keys[n - 1]
        out[hit] = self.logp[n - 1][at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            less = np.full((len(miss), len(self.langs)), np.log(self.floor), np.float32) if n == 1 else self._at(n - 1, [x[miss] for x in keys], [x[miss] for x in ctx])
            at = np.minimum(np.searchsorted(self.ctx[n - 1], ctx[n - 1][miss]), len(self.ctx[n - 1]) - 1)
            known = self.ctx[n - 1][at] == ctx[n - 1][miss]
            less[known] += self.weight[n - 1][at[known]]
            out[miss] = less
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character in each language, characters and letters of each text."""
        chars, off, n_letters = letters(texts)
        lp = self._at(self.order, grams(chars, off, self.order), contexts(chars, off, self.order))
        n = np.diff(off)
        total = np.add.reduceat(lp, off[:-1], axis=0, dtype=np.float64) if len(texts) else np.zeros((0, len(self.langs)))
        return -total / n[:, None], n, n_letters

    def scores(self, texts: list[str | None], reject: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The best language's place and its probability; place -1 without a letter."""
        entropy, n, n_letters = self.entropies(texts)
        z = -entropy * np.sqrt(n)[:, None] / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        best = np.argmin(entropy, axis=1)
        score = np.clip(p[np.arange(len(best)), best], 0.0, 1.0)
        good = n_letters > 0
        if reject:
            good &= entropy.min(axis=1) <= self.limits[np.log2(n).astype(int)]
        return np.where(good, best, -1), np.where(good, score, 0.0)

    def calibrate(self, texts: list[str], truth: list[str]) -> None:
        """Sets the temperature that gives the labelled texts the highest likelihood."""
        if not texts or len(self.langs) < 2:
            return
        entropy, n, _ = self.entropies(texts)
        y = np.array([self.langs.index(t) for t in truth])
        best = (np.inf, 1.0)
        for t in np.geomspace(0.02, 10, 40):
            z = -entropy * np.sqrt(n)[:, None] / t
            z -= z.max(axis=1, keepdims=True)
            loss = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))
            best = min(best, (loss, float(t)))
        self.temperature = best[1]
        # The limit falls with the length: steps of twice the characters, each at most that of the step before.
        lowest, step, limit = entropy.min(axis=1), np.log2(n).astype(int), np.inf
        for k in range(64):
            own = lowest[step == k]
            if len(own) >= 10:
                limit = min(limit, float(np.quantile(own, 1 - REJECTED)) * 1.1)
            self.limits[k] = limit


def fit(rows: DataFrame, sample: int = SAMPLE) -> Models | None:
    """Models from a bounded sample of rows with text and lang, of which a fifth calibrates the scores."""
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").where(F.octet_length("text") <= SAMPLE_BYTES)
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    few = common.bounded_sample(rows, "doc_id", "lang", sample).withColumn("size", size).where(F.col("size") <= TOTAL_BYTES)
    return common.learned(few.select("doc_id", "lang", "text"), learn)[0]


def learn(table: pa.Table) -> tuple[Models | None]:
    """Models of rows doc_id, lang, text, or None without a letter."""
    got = sorted(table.select(["lang", "doc_id", "text"]).to_pylist(), key=lambda r: (r["lang"], str(r["doc_id"]), r["text"]))
    fitted: dict[str, list[str]] = {}
    kept: list[tuple[str, str]] = []
    for i, r in enumerate(got):
        if i % 5 == 4:
            kept.append((r["text"], r["lang"]))
        else:
            fitted.setdefault(r["lang"], []).append(r["text"])
    fitted = {k: v for k, v in fitted.items() if letters(v)[2].sum()}
    if not fitted:
        return (None,)
    models = Models(fitted)
    kept = [(t, y) for t, y in kept if y in fitted]
    # Short pieces too, or the temperature would only fit whole documents, where errors hardly occur.
    kept += [(" ".join(t.split()[i : i + n]), y) for i, n in ((0, 1), (3, 1), (7, 2), (11, 4)) for t, y in kept if len(t.split()) > i]
    models.calibrate([t for t, _ in kept], [y for _, y in kept])
    return (models,)


def identify(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text: str = "text", reject: bool = False) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score; with reject, `und` where every language is unlikely."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.held_out(id_col).alias("held_out"), F.col(text).cast("string").alias("text"))
    if models is None:
        return rows.select("doc_id", "held_out", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def task(batches):
        models = shared.value
        names = np.array([*models.langs, UND], dtype=object)
        for batch in batches:
            sizes = common.as_bytes(batch.column(2))[1]
            for lo, hi in common.chunks(sizes, 1 << 19):
                part = batch.slice(lo, hi - lo)
                best, score = models.scores(part.column(2).to_pylist(), reject)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(task, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs.where(~common.held_out())))
