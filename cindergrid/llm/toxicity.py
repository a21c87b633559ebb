"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values.

A token is a run of letters, digits and non-ASCII bytes, A-Z as a-z. Its log-odds compare the share of toxic texts among
the labelled texts that hold it with the share among all, under a Dirichlet prior worth `prior` texts, lowered by
`margin` standard errors; tokens below `least` nats count as neutral and cost `drift`. The linear-time scan finds every
maximal-scoring segment of a text; the expected number of chance segments of its score in a text of that length,
K * length * exp(-lambda * score), has lambda and K from texts labelled harmless. A text's evidence is the sum over its
segments of the nats by which they pass that; a logistic curve fitted on labelled texts that gave no counts turns it
into a probability.

Labels: rows of (doc_id, toxic); other values than 0 and 1 and null ids are left out, repeated ids count once, toxic
if any row is. The fit reads at most about max_labelled of them, taken by a hash of the id; equal texts of one label count
once, and a hash of their smallest id says whether they give counts or the curve, so that reruns agree. With no toxic or no harmless
labelled text every score is the share of toxic ones (0 without labels). Null and empty texts have no segment.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindergrid.llm import bytewords as bw
from cindergrid.llm.common import written

PASSAGE = T.ArrayType(T.StructType([T.StructField("first_token", T.LongType()), T.StructField("last_token", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))
BINS, STEP = 400, 0.25


def maximal_segments(place: list[int], gain: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence that gains at the places and loses drift at any other.

    One pass with a stack of candidates, each with the running sum left of it and up to its end.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, previous = 0.0, -1
    for at, g in zip(place, gain):
        left = total - drift * (at - previous - 1)
        total, previous = left + g, at
        first, low, high = at, left, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                stack.append((first, at, low, high))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high in stack]


class Toxicity:
    def __init__(self, words: np.ndarray, gains: np.ndarray, drift: float, rate: float, k: float, slope: float, offset: float):
        self.words, self.gains, self.drift, self.rate, self.k, self.slope, self.offset = words, gains, drift, rate, k, slope, offset

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, max_labelled: int = 200_000, prior: float = 5.0, margin: float = 1.64, least: float = 1.0, drift: float = 0.05) -> Toxicity:
        """docs (doc_id, text); learn: condition on doc_id of the labels that may be used."""
        own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        n = own.count()
        if n > max_labelled:
            own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * max_labelled / n))
        # at most about max_labelled ids: a bounded table
        held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")
        held = held.groupBy(F.xxhash64("text").alias("key"), "toxic").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
        held = held.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)))
        held = written(held.select("text", "toxic", F.when(F.col("part") == 0, 1).otherwise(0).alias("calibrate")))

        def words(batches):
            for batch in batches:
                toxic = batch.column("toxic").to_numpy()
                for lo, hi, h, first in bw.word_hashes(batch.column("text"), bw.MARKS):
                    owner = np.repeat(np.arange(hi - lo), np.diff(first))
                    order = np.lexsort((h, owner))
                    h, owner = h[order], owner[order]
                    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
                    h, bad = h[new], toxic[lo:hi][owner[new]]
                    key, back = np.unique(h, return_inverse=True)
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.bincount(back, bad, len(key)).astype(np.int64)), pa.array(np.bincount(back, 1 - bad, len(key)).astype(np.int64))], names=["word", "bad", "good"])

        sizes = {(r.calibrate, r.toxic): r.n for r in held.groupBy("calibrate", "toxic").agg(F.count("*").alias("n")).collect()}
        bad, good = sizes.get((0, 1), 0), sizes.get((0, 0), 0)
        seen_bad, seen = bad + sizes.get((1, 1), 0), sum(sizes.values())
        share = min(max(seen_bad / max(seen, 1), 1e-9), 1 - 1e-9) if seen else 1e-9
        nothing = Toxicity(np.zeros(0, np.uint64), np.zeros(0), drift, 1.0, 1.0, 0.0, math.log(share / (1 - share)))
        if not bad or not good:
            return nothing
        base = bad / (bad + good)
        a, b = F.col("bad") + prior * base, F.col("good") + prior * (1 - base)
        odds = F.log(a / b) - math.log(base / (1 - base)) - margin * F.sqrt(1 / a + 1 / b)
        counted = held.where("calibrate = 0").mapInArrow(words, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        # words of the bounded labelled texts that pass the bound, two texts each at least
        table = counted.where("bad > 1").withColumn("gain", odds).where(F.col("gain") >= least).select("word", "gain").toArrow()
        key = table["word"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        model = Toxicity(key[order], table["gain"].to_numpy()[order], drift, 1.0, 1.0, 1.0, 0.0)

        def background(batches):
            seen, found, tokens = np.zeros(BINS), np.zeros(BINS), 0
            for batch in batches:
                for place, gain, n in model.hits(batch.column("text")):
                    tokens += n
                    for g in gain:
                        seen[min(int(g / STEP), BINS - 1)] += 1
                    for _, _, s in maximal_segments(place, gain, model.drift):
                        found[min(int(s / STEP), BINS - 1)] += 1
            yield pa.record_batch([pa.array(np.r_[seen, found, tokens].tolist(), pa.float64()), pa.array(np.arange(2 * BINS + 1))], names=["n", "bin"])

        rows = held.where("calibrate = 1 and toxic = 0").mapInArrow(background, "n double, bin long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
        sums = np.zeros(2 * BINS + 1)
        for r in rows:
            sums[r.bin] = r.n
        model.rate, model.k = extreme_values(sums[:BINS], sums[BINS : 2 * BINS], sums[-1], drift)

        def evidence(batches):
            count = np.zeros((BINS, 2))
            for batch in batches:
                for (place, gain, n), toxic in zip(model.hits(batch.column("text")), batch.column("toxic").to_numpy()):
                    count[min(int(model.evidence(place, gain, n) / STEP), BINS - 1), toxic] += 1
            yield pa.record_batch([pa.array(np.arange(BINS)), pa.array(count[:, 0]), pa.array(count[:, 1])], names=["bin", "good", "bad"])

        rows = sorted(held.where("calibrate = 1").mapInArrow(evidence, "bin long, good double, bad double").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect(), key=lambda r: r.bin)
        model.slope, model.offset = logistic([(r.bin + 0.5 * (r.bin > 0)) * STEP for r in rows], [r.bad for r in rows], [r.good for r in rows], share)
        return model

    @property
    def separates(self) -> bool:
        """Whether scores depend on the texts."""
        return len(self.words) > 0 and self.slope > 0

    def hits(self, texts: pa.Array):
        """For each text the places and gains of its tokens that have log-odds, and its number of tokens."""
        for lo, hi, h, first in bw.word_hashes(texts, bw.MARKS):
            if len(self.words):
                i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
                at = np.flatnonzero(self.words[i] == h)
                gain = self.gains[i[at]]
            else:
                at, gain = np.zeros(0, np.int64), np.zeros(0)
            cut = np.searchsorted(at, first)
            for r in range(hi - lo):
                a, b = cut[r], cut[r + 1]
                yield ((at[a:b] - first[r]).tolist(), gain[a:b].tolist(), int(first[r + 1] - first[r])) if b > a else ([], [], int(first[r + 1] - first[r]))

    def nats(self, score: float, n: int) -> float:
        return self.rate * score - math.log(max(self.k * n, 1e-9))

    def evidence(self, place: list[int], gain: list[float], n: int) -> float:
        return sum(max(0.0, self.nats(s, n)) for _, _, s in maximal_segments(place, gain, self.drift)) if place else 0.0

    def score(self, docs: DataFrame, text: str = "text", significant: float = 0.05) -> DataFrame:
        """docs' other columns, toxicity (0 to 1) and passages: the segments of which chance gives at most `significant` in such a text."""
        keep = [c for c in docs.columns if c not in (text, "toxicity", "passages")]
        schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField("toxicity", T.DoubleType()), T.StructField("passages", PASSAGE)])
        model = self

        def run(batches):
            for batch in batches:
                score, spans = [], []
                for place, gain, n in model.hits(batch.column("__text")):
                    found = [(a, b, s, model.nats(s, n)) for a, b, s in maximal_segments(place, gain, model.drift)] if place else []
                    x = model.slope * sum(max(0.0, f[3]) for f in found) + model.offset
                    score.append(1 / (1 + math.exp(-x)) if x > -700 else 0.0)
                    spans.append([{"first_token": a, "last_token": b, "score": s, "expected": math.exp(-e)} for a, b, s, e in found if e >= -math.log(significant)])
                kind = pa.list_(pa.struct([("first_token", pa.int64()), ("last_token", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score, pa.float64()), pa.array(spans, kind)], names=[*keep, "toxicity", "passages"])

        return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(run, schema)


def extreme_values(seen: np.ndarray, found: np.ndarray, tokens: float, drift: float) -> tuple[float, float]:
    """lambda and K from the scores of harmless tokens and of the maximal segments among them, both in bins."""
    value = (np.arange(BINS) + 0.5) * STEP
    if not tokens or not seen.sum():
        return 1.0, 1.0 / max(tokens, 1.0)
    p = seen / tokens
    rest = 1 - p.sum()
    moment = lambda x: float((p * np.exp(x * value)).sum() + rest * math.exp(-x * drift)) - 1
    low, high = 1e-6, 1.0
    if moment(low) >= 0 or moment(high) <= 0:
        rate = 1.0 if moment(low) < 0 else 0.05
    else:
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if moment(mid) < 0 else (low, mid)
        rate = (low + high) / 2
    tail = np.cumsum(found[::-1])[::-1]
    k = [t / tokens * math.exp(rate * v) for t, v in zip(tail, np.arange(BINS) * STEP) if t >= 5]
    return rate, max(float(np.median(k)) if k else 1.0 / tokens, 1e-9)


def logistic(x: list[float], bad: list[float], good: list[float], share: float) -> tuple[float, float]:
    """Slope and offset that fit the counts best, with one bad text at the top and one good at 0 more; slope is not negative."""
    top = max([x_ for x_, b in zip(x, bad) if b] + [10.0])
    x, bad, good = np.r_[x, top, 0.0], np.r_[bad, 1.0, 0.0], np.r_[good, 0.0, 1.0]
    w = np.zeros(2)
    X = np.stack([x, np.ones(len(x))], axis=1)
    n = bad + good
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve((X * (n * p * (1 - p))[:, None]).T @ X + np.diag([1e-3, 1e-6]), X.T @ (bad - n * p) - np.array([1e-3, 1e-6]) * w)
        step = step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, math.log(share / (1 - share)))
