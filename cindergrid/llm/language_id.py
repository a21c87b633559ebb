"""Language identification by a byte convolutional network, trained and applied with numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, all of them used. Filters two, three and four bytes wide run over
the window, each keeps its greatest response, and a softmax over the learned languages follows; a text's prediction
averages its windows' probabilities by their length. Filters read bytes as one-hot vectors, so that a filter's response
at a position is a sum of table entries; for scoring, entries of two neighbouring bytes are added up in advance.

The network is fitted on the driver on a bounded sample of the labelled rows: of each language about max_docs divided by the
number of languages, or all where it has fewer, taken by a hash of id and text, and of each text at most `pieces` pieces of
PIECE characters at places given by that hash; max_docs and pieces are the bound. Rows without language or
without a letter are not learned from. A null text, or one without any letter, is 'und' with score 0; so is every text
when nothing could be learned. Ties of probability go to the first language in order. Repeated rows get equal predictions. Other
columns pass through; columns named lang_pred or score are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindergrid.llm import bytewords as bw

WINDOW, PIECE, FILTERS, WIDTHS = 256, 240, 8, (2, 3, 4)
SLICE, AT_ONCE = 1 << 18, 1024  # bytes of texts, windows of a text
UND = "und"


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with four zeros after each text; start of each window in them, its text and its number of bytes. Texts aren't empty."""
    length = np.diff(offsets)
    begin = offsets[:-1] + 4 * np.arange(len(length))
    line = np.zeros(len(raw) + 4 * len(length), np.uint8)
    if len(length) == 1:  # a long text is alone
        line[: len(raw)] = raw
    else:
        line[np.arange(len(raw)) + np.repeat(4 * np.arange(len(length)), length)] = raw
    count = -(-length // WINDOW)
    text = np.repeat(np.arange(len(length)), count)
    nth = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    return line, begin[text] + nth * WINDOW, text, np.minimum(WINDOW, length[text] - nth * WINDOW)


class ByteNet:
    def __init__(self, languages: list[str], tables: list[np.ndarray], bias: np.ndarray, weights: np.ndarray, offset: np.ndarray):
        """tables: for each width an array (width, 256, FILTERS); weights: (filters, languages)."""
        self.languages, self.tables, self.bias, self.weights, self.offset = languages, tables, bias, weights, offset

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of two neighbouring bytes' entries: for the first two bytes of every filter, and for the next two of wider ones."""
        t2, t3, t4 = self.tables
        head = np.concatenate([t[0][:, None, :] + t[1][None, :, :] for t in (t2, t3, t4)], axis=2).reshape(65536, -1)
        tail = np.concatenate([np.broadcast_to(t3[2][:, None, :], (256, 256, FILTERS)), t4[2][:, None, :] + t4[3][None, :, :]], axis=2).reshape(65536, -1)
        return np.ascontiguousarray(head, np.float32), np.ascontiguousarray(tail, np.float32)

    def responses(self, line: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        pair = np.zeros(len(line) + 2, np.int32)
        pair[: len(line) - 1] = line[:-1].astype(np.int32) * 256 + line[1:]
        out = np.take(tables[0], pair[:-2], axis=0)
        out[:, FILTERS:] += np.take(tables[1], pair[2:], axis=0)
        return out

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray, tables) -> np.ndarray:
        """One row of probabilities for each text."""
        line, start, text, size = windows(raw, offsets)
        parts = []
        for a in range(0, len(start), AT_ONCE):
            low, own, long = start[a], start[a : a + AT_ONCE] - start[a], size[a : a + AT_ONCE]
            # responses at the window's own bytes alone; those of its last bytes reach into what follows in the text, or zeros
            responses = self.responses(line[low : low + own[-1] + long[-1] + 4], tables)
            pooled = np.maximum.reduceat(responses, np.stack([own, own + long], axis=1).ravel(), axis=0)[::2] + self.bias
            logit = np.maximum(pooled, 0) @ self.weights + self.offset
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            parts.append(p * (long / p.sum(axis=1))[:, None])
        p = np.concatenate(parts)
        first = np.searchsorted(text, np.arange(len(offsets) - 1))
        return np.add.reduceat(p, first, axis=0) / np.diff(offsets)[:, None]

    @staticmethod
    def train(pieces: list[bytes], labels: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 3) -> ByteNet | None:
        """Adam on the cross-entropy; the gradient of a maximum goes to the bytes at its place."""
        languages = sorted(set(labels))
        pieces, labels = zip(*((p[:WINDOW], x) for p, x in zip(pieces, labels) if p)) if any(pieces) else ((), ())
        if not pieces:
            return None
        rng = np.random.default_rng(seed)
        n = len(FILTERS_AT)
        net = ByteNet(languages, [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(n, np.float32), rng.normal(0, 0.2, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
        y = np.array([languages.index(x) for x in labels])
        params = [*net.tables, net.bias, net.weights, net.offset]
        moment, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        data = np.zeros((len(pieces), WINDOW + 4), np.uint8)
        for i, p in enumerate(pieces):
            data[i, : len(p)] = np.frombuffer(p, np.uint8)
        size = np.array([len(p) for p in pieces])
        for epoch in range(epochs):
            order = rng.permutation(len(pieces))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                x, m = data[own], len(own)
                valid = np.arange(WINDOW)[None, :] < size[own][:, None]
                pooled, where = [], []
                for table, width in zip(net.tables, WIDTHS):
                    r = table[0][x[:, :WINDOW]]
                    for j in range(1, width):
                        r = r + table[j][x[:, j : WINDOW + j]]
                    r[~valid] = -1e9
                    at = r.argmax(axis=1)
                    where.append(at)
                    pooled.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0, :])
                z = np.concatenate(pooled, axis=1) + net.bias
                h = np.maximum(z, 0)
                keep = (rng.random(h.shape) > 0.2) / 0.8
                logit = (h * keep) @ net.weights + net.offset
                p = np.exp(logit - logit.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = p.copy()
                d[np.arange(m), y[own]] -= 1
                d /= m
                dz = (d @ net.weights.T) * keep * (z > 0)
                grads = []
                for k, (table, width) in enumerate(zip(net.tables, WIDTHS)):
                    g = np.zeros_like(table)
                    part = dz[:, k * FILTERS : (k + 1) * FILTERS]
                    f = np.broadcast_to(np.arange(FILTERS), part.shape)
                    for j in range(width):
                        np.add.at(g[j], (x[np.arange(m)[:, None], where[k] + j], f), part)
                    grads.append(g)
                grads += [dz.sum(axis=0), (h * keep).T @ d, d.sum(axis=0)]
                step += 1
                now = rate * (1 - epoch / epochs)
                for q, g, mo, sq in zip(params, grads, moment, square):
                    mo += 0.1 * (g - mo)
                    sq += 0.01 * (g * g - sq)
                    q -= (now * (mo / (1 - 0.9**step)) / (np.sqrt(sq / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return net


FILTERS_AT = [(w, f) for w in WIDTHS for f in range(FILTERS)]


def fit(docs: DataFrame, learn: Column, *, max_docs: int = 3000, pieces: int = 4, text: str = "text", lang: str = "lang") -> ByteNet | None:
    """docs (doc_id, text, lang); learn: condition on the rows that may be learned from."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64("doc_id", text).alias("h"))
    # a row for each language; the classes of the network, tens or hundreds
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(1, max_docs // max(1, len(sizes)))
    if any(n > each for n in sizes.values()):
        least = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))))
        # the hash as a number in [0, 1); rows of one id and text have one hash, so they count once
        rows = rows.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < F.element_at(least, F.col("lang"))).distinct()
    length = F.length("text")
    places = F.array_distinct(F.array(*(F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(F.lit(1), length - PIECE)).cast("int") for i in range(pieces))))
    found = rows.select("lang", F.explode(places).alias("at"), "text").select("lang", F.substring("text", F.col("at") + 1, F.lit(PIECE)).alias("piece"))
    # about max_docs * pieces pieces of PIECE characters at most
    found = sorted((r.piece.encode(), r.lang) for r in found.collect())
    return ByteNet.train([p for p, _ in found], [x for _, x in found])


def predict(docs: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """docs' other columns, lang_pred and score (0 to 1) of every whole text."""
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    rows = docs.select(*keep, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).otherwise("").alias("__text"))
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = np.array(net.languages if net else [UND], object)

    def run(batches):
        tables = net.pair_tables() if net else None
        for batch in batches:
            raw, offsets = bw.text_bytes(batch.column("__text"))
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            full = np.flatnonzero(np.diff(offsets)) if net else np.zeros(0, np.int64)
            if len(full):
                at = np.r_[offsets[full], offsets[-1]]
                for lo, hi in bw.slices(at, SLICE):
                    p = net.probabilities(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], tables)
                    best[full[lo:hi]] = p.argmax(axis=1)
                    score[full[lo:hi]] = np.clip(p.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([names[i] if i >= 0 else UND for i in best], pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
