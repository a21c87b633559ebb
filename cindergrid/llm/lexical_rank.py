"""Ranked lexical search by K2-treaps: compressed quadtrees over a term-document grid whose cells hold the greatest impact inside.

Documents' terms are written as they are read, then packed into shards by the size of their text; neither is shuffled. In a shard
documents are columns by ascending id and terms are rows, the frequent ones first. The grid's points, an impact for each term of a
document, are sorted by their interleaved row and column digits; a cell with points in two or more of its quarters becomes a node,
cells between are left out. An index is a table with a row for each shard, written to a folder and readable by any later search.

A search sends blocks of items to all shards. Each term of an item follows its row through the tree, so a range of documents has
for each term the cell it has come to, and the sum of these cells' maxima times the terms' weights bounds every score in the
range. Ranges are halved best first, for all terms at once, until none can beat the k-th best document; a range of one document
has its score as its bound. A task keeps each item's k best over all its shards; lists merge in a tree, salted first.

Terms are the maximal runs of characters other than ASCII signs, only A-Z lower-cased. Null and empty texts, and texts without a term,
are in no shard and have no rows. Equal scores go by ascending id, null ids last; rows with one id are documents of their own. Equal
rows of items count once; an item id with several texts is answered for each. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cindergrid.llm import bytewords as bw
from cindergrid.llm.common import discard, shared_dir, tree_sum, written

SHARD, SLICE, ITEMS, WIDE, FAN = 4 << 20, 1 << 18, 8 << 20, 256, 64
#: A shard to a row group, and its arrays neither looked up nor compared, so that neither writer nor reader holds more copies of them.
STORED = {"compression": "zstd", "parquet.block.row.count.limit": 1, "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false", "parquet.page.size.row.check.min": 1}
#: What JVM and Python hand each other at once, about 2 MB of text or one shard, and the rows that the JVM decodes at once.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}
POSTINGS = "docs long, words long, bytes long, ids binary, nulls binary, sizes binary, counts binary, terms binary, tf binary"
NAMES = [c.split()[0] for c in POSTINGS.split(", ")]
INDEX = "docs long, ids binary, nulls long, terms binary, counts binary, row binary, z binary, kids binary, level binary, top binary"
ROWS = np.uint64(0xAAAAAAAAAAAAAAAA)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside pass on small batches; what the session had set holds again afterwards."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spaced(x: np.ndarray) -> np.ndarray:
    """The low 32 bits of each number with a zero before each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def norm(n_terms: np.ndarray, n: int, length: int) -> np.ndarray:
    """100 - 90 + ((90 * terms * N) div L)."""
    if 90 * int(n_terms.max(initial=0)) * n < 1 << 62:
        return 10 + (90 * n_terms * n) // length
    return np.array([10 + 90 * int(v) * n // length for v in n_terms], np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def quadtree(z: np.ndarray, value: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes over sorted codes of height base-4 digits: children by quarter (-1: none), level and greatest value. Points are nodes
    0 to len(z) - 1; the inner ones follow, the deepest first, the root last."""
    points = len(z)
    at, best, node = np.arange(points), value.copy(), np.arange(points)  # of the topmost nodes so far: first point, value, number
    apart = z[1:] ^ z[:-1]
    # digits that a point shares with the one before, from the number of bits below the highest differing one
    for s in (1, 2, 4, 8, 16, 32):
        apart = apart | (apart >> np.uint64(s))
    shared = np.r_[-1, height - 1 - (np.bitwise_count(apart).astype(np.int64) - 1) // 2]
    kids, level, top = [], [], []
    count = points
    for own in range(height - 1, -1, -1):
        joined = np.flatnonzero(shared == own)
        if not len(joined):
            continue
        first = joined[np.r_[True, np.diff(joined) != 1]] - 1  # the node that a run of joined ones follows
        size = np.diff(np.r_[np.flatnonzero(np.r_[True, np.diff(joined) != 1]), len(joined)]) + 1
        member = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        group = np.repeat(np.arange(len(first)), size)
        quarter = (z[at[member]] >> np.uint64(2 * (height - 1 - own))) & np.uint64(3)
        new = np.full((len(first), 4), -1, np.int32)
        new[group, quarter.astype(np.int64)] = node[member]
        most = np.maximum.reduceat(best[member], np.cumsum(size) - size)
        kids.append(new)
        level.append(np.full(len(first), own, np.uint8))
        top.append(most)
        node[first], best[first] = count + np.arange(len(first)), most
        count += len(first)
        stay = np.ones(len(at), bool)
        stay[joined] = False
        at, best, node, shared = at[stay], best[stay], node[stay], shared[stay]
    if not kids:
        return np.zeros((0, 4), np.int32), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    return np.concatenate(kids), np.concatenate(level), np.concatenate(top)


def shard_of(ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int, length: int) -> dict[str, np.ndarray | int]:
    """A shard of documents (ids, whether null, terms with repeats) and their postings (doc, term, tf)."""
    order = np.lexsort((ids, nulls))
    column = np.empty(len(ids), np.int64)
    column[order] = np.arange(len(ids))
    terms, back, counts = np.unique(term, return_inverse=True, return_counts=True)
    row = np.empty(len(terms), np.int64)
    row[np.argsort(-counts, kind="stable")] = np.arange(len(terms))
    height = max(1, int(max(len(terms), len(ids)) - 1).bit_length())
    z = (spaced(row[back]) << np.uint64(1)) | spaced(column[doc])
    by = np.argsort(z)
    z, value = z[by], impact(tf, norm(sizes, n, length)[doc])[by]
    kids, level, top = quadtree(z, value, height)
    return {"docs": len(ids), "ids": ids[order], "nulls": int(nulls.sum()), "terms": terms, "counts": counts.astype(np.int64), "row": row.astype(np.int32), "z": z, "kids": kids, "level": level, "top": np.r_[value, top].astype(np.int32)}


def row_of(made: dict[str, np.ndarray | int]) -> pa.RecordBatch:
    """One row of numbers and, without a copy, the bytes of arrays."""
    size = lambda v: pa.py_buffer(np.array([0, v.nbytes], np.int32))
    cells = [pa.array([v], pa.int64()) if isinstance(v, int) else pa.Array.from_buffers(pa.binary(), 1, [None, size(v), pa.py_buffer(np.ascontiguousarray(v))]) for v in made.values()]
    return pa.record_batch(cells, names=list(made))


def postings_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each slice of texts: how many have a term, all their terms with repeats, bytes; by text its id, whether that is null, its terms
    with repeats and without; the terms of each text and how often it has them. Written, so that no task holds a row group of texts beside shards."""

    def read(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            empty, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            raw, offsets = bw.text_bytes(batch.column("text"))
            for lo, hi in bw.slices(offsets, SLICE):
                own, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = bw.bounds(own, at, bw.MARKS)
                size = np.diff(first)
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                word = bw.hashes(own, starts, ends)
                doc = np.repeat(np.arange(len(full)), size[full])
                order = np.lexsort((word, doc))
                word, doc = word[order], doc[order]
                head = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])])
                tf = np.diff(np.r_[head, len(word)]).astype(np.int32)
                made = len(full), len(word), len(own), ids[lo:hi][full], empty[lo:hi][full], size[full], np.bincount(doc[head]), word[head], tf
                yield row_of(dict(zip(NAMES, made)))

    with small_batches(docs.sparkSession):
        return written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(read, POSTINGS), **STORED)


def build_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD) -> tuple[DataFrame, int]:
    """Writes the shards of all docs to a folder; returns the table and N, the documents with a term."""
    spark, postings = docs.sparkSession, postings_of(docs, doc_id, text)
    n, length = (int(v or 0) for v in postings.agg(F.sum("docs"), F.sum("words")).first())  # length: all their terms with repeats

    def build(batches):
        parts, docs_in, held = [], 0, 0

        def out():
            columns = [np.concatenate(x) for x in zip(*parts)]
            parts.clear()
            return row_of(shard_of(*columns, n, length))

        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
                counts = get("counts", np.int64)
                doc = np.repeat(np.arange(docs_in, docs_in + len(counts)), counts)
                parts.append((get("ids", np.int64), get("nulls", bool), get("sizes", np.int64), doc, get("terms", np.uint64), get("tf", np.int32).astype(np.int64)))
                docs_in, held = docs_in + len(counts), held + batch.column("bytes")[i].as_py()
                if held >= shard_bytes:
                    yield out()
                    docs_in = held = 0
        if parts:
            yield out()

    with small_batches(spark):
        postings.mapInArrow(build, INDEX).write.options(**STORED).parquet(path)
    discard(postings)
    return spark.read.schema(INDEX).parquet(path), n


class Treap:
    """A shard's tree and the rows of its terms."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
        self.ids, self.terms, self.row, self.z, self.top = get("ids", np.int64), get("terms", np.uint64), get("row", np.int32), get("z", np.uint64), get("top", np.int32)
        self.known = len(self.ids) - batch.column("nulls")[i].as_py()
        self.kids, self.points = get("kids", np.int32).reshape(-1, 4), len(self.z)
        self.height = max(1, int(max(len(self.terms), len(self.ids)) - 1).bit_length())
        self.top_level = self.height - max(1, (len(self.ids) - 1).bit_length())
        self.level = np.concatenate([np.full(self.points, self.height, np.uint8), get("level", np.uint8)])
        self.below = 2 * (self.height - self.level).astype(np.uint64)  # bits of a code below the node's digits
        self.worth = np.append(self.top, 0).astype(np.int64)
        self.code = np.empty(self.points + len(self.kids), np.uint64)  # of a node: that of a point in it
        self.code[: self.points] = self.z
        some = self.kids.max(axis=1) if len(self.kids) else np.zeros(0, np.int32)
        for own in np.unique(self.level[self.points :])[::-1]:
            at = np.flatnonzero(self.level[self.points :] == own)
            self.code[self.points + at] = self.code[some[at]]

    def rows_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those terms that the shard has, and their rows."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = np.flatnonzero(self.terms[at] == terms)
        return there, self.row[at[there]].astype(np.int64)

    def on_row(self, node: np.ndarray, path: np.ndarray) -> np.ndarray:
        """Whether the row crosses the node's cell."""
        return ((self.code[node] ^ path) & ROWS) >> self.below[node] == 0

    def halves(self, cells: np.ndarray, level: np.ndarray, path: np.ndarray) -> np.ndarray:
        """cells (ranges, terms) at the ranges' level, -1 where a term has none, to those of the left halves, then of the right ones."""
        out = np.full((2, cells.size), -1, np.int32)
        at = np.flatnonzero(cells.ravel() >= 0)
        node, own, row = cells.ravel()[at], level[at // cells.shape[1]], path[at % cells.shape[1]]
        down = (2 * (self.height - 1 - own)).astype(np.uint64)
        here = self.level[node] == own
        passed = ~here  # the node's cell is narrower: it lies in one half
        out[((self.code[node[passed]] >> down[passed]) & np.uint64(1)).astype(np.int8), at[passed]] = node[passed]
        at, inner, row = at[here], node[here] - self.points, row[here]
        quarter = ((row >> down[here]) & np.uint64(2)).astype(np.int64)
        for half in (0, 1):
            below = self.kids[inner, quarter | half]
            there = np.flatnonzero(below >= 0)
            there = there[self.on_row(below[there], row[there])]
            out[half, at[there]] = below[there]
        return out.reshape(-1, cells.shape[1])

    def enter(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each term's row digits, and its cell at the highest level that parts documents; -1 without one."""
        there, row = self.rows_of(terms)
        path, cells = np.zeros(len(terms), np.uint64), np.full(len(terms), -1, np.int32)
        path[there] = spaced(row) << np.uint64(1)
        if len(there):
            root = len(self.code) - 1
            own = path[there]
            at = np.where(self.on_row(np.full(len(there), root), own), np.int32(root), np.int32(-1))[None, :]
            for level in range(self.top_level):
                at = self.halves(at, np.array([level]), own)[:1]
            cells[there] = at[0]
        return path, cells

    def best(self, path: np.ndarray, cells: np.ndarray, weight: np.ndarray, k: int, last: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, columns) of the k best documents for terms entered, by falling score, then column; last: score and least id that they must beat."""
        there = np.flatnonzero(cells >= 0)
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(there):
            return nothing
        path, weight, h = path[there], weight[there], self.height
        cells = cells[None, there]
        level, begin = np.full(1, self.top_level), np.zeros(1, np.int64)
        bound = self.bounds(cells, weight)
        got_score, got_at = nothing
        while len(bound):
            if len(got_score) >= k:
                keep = (bound > got_score[k - 1]) | ((bound == got_score[k - 1]) & (begin < got_at[k - 1]))
                cells, level, begin, bound = cells[keep], level[keep], begin[keep], bound[keep]
            if last is not None:
                keep = (bound > last[0]) | ((bound == last[0]) & (begin < self.known) & (self.ids[np.minimum(begin, len(self.ids) - 1)] < last[1]))
                cells, level, begin, bound = cells[keep], level[keep], begin[keep], bound[keep]
            if not len(bound):
                break
            if len(bound) > WIDE:
                order = np.lexsort((begin, -bound))
                cells, level, begin, bound = cells[order], level[order], begin[order], bound[order]
            own, own_level = cells[:WIDE], level[:WIDE]
            below = self.halves(own, own_level, path)
            after = np.concatenate([own_level, own_level]) + 1
            start = np.concatenate([begin[:WIDE], begin[:WIDE] + (np.int64(1) << (h - 1 - own_level))])
            limit = self.bounds(below, weight)
            live = limit > 0
            below, after, start, limit = below[live], after[live], start[live], limit[live]
            done = after == h
            if done.any():
                got_score, got_at = np.concatenate([got_score, limit[done]]), np.concatenate([got_at, start[done]])
                order = np.lexsort((got_at, -got_score))[:k]
                got_score, got_at = got_score[order], got_at[order]
            rest = ~done
            cells, level, begin, bound = (np.concatenate([old[WIDE:], new[rest]]) for old, new in ((cells, below), (level, after), (begin, start), (bound, limit)))
        return got_score, got_at

    def bounds(self, cells: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return self.worth[cells] @ weight  # -1 is the last entry: nothing


def asked_terms(texts: list[str]) -> list[np.ndarray]:
    """The distinct terms' hashes of each text."""
    out = []
    for _, _, word, first in bw.word_hashes(pa.array(texts, pa.large_string()), bw.MARKS):
        out += [np.unique(word[a:b]) for a, b in zip(first[:-1], first[1:])]
    return out


def search(index: DataFrame, n: int, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", block_bytes: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents. Items go in blocks of about block_bytes of text, each read once."""
    kind = items.schema[item_id].dataType
    asked = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    schema = f"item_id {kind.simpleString()}, ask long, doc_id long, score long"
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        terms = asked_terms([r.text for r in rows])
        known = np.unique(np.concatenate([*terms, np.zeros(0, np.uint64)]))

        def count(batch, known=known):
            df = np.zeros(len(known), np.int64)
            for i in range(batch.num_rows):
                own, counts = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("terms", np.uint64), ("counts", np.int64)))
                at = np.minimum(np.searchsorted(own, known), len(own) - 1)
                df += np.where(own[at] == known, counts[at], 0)
            return df

        with small_batches(index.sparkSession):
            df = tree_sum(index.select("terms", "counts"), count, (len(known),), np.int64)
        weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
        terms, ids = [np.searchsorted(known, t) for t in terms], [r.item_id for r in rows]

        def run(batches, ids=ids, known=known, terms=terms, weight=weight):
            best: list[list[tuple]] = [[] for _ in ids]  # (-score, id or none last, id)
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = Treap(batch, i)
                    path, cells = shard.enter(known)
                    for a, own in enumerate(best):
                        last = (-own[-1][0], own[-1][2] if own[-1][2] is not None else np.iinfo(np.int64).max) if len(own) >= k else None
                        score, at = shard.best(path[terms[a]], cells[terms[a]], weight[terms[a]], k, last)
                        if len(score):
                            found = [(-int(s), int(c >= shard.known), int(shard.ids[c]) if c < shard.known else None) for s, c in zip(score, at)]
                            best[a] = sorted([*own, *found], key=lambda r: (r[0], r[1], r[2] or 0))[:k]
            flat = [(ids[a], a, r[2], -r[0]) for a, own in enumerate(best) for r in own]
            if flat:
                yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "ask", "doc_id", "score"), r)) for r in flat], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_type

        arrow = pa.schema([("item_id", to_arrow_type(kind)), ("ask", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
        lists = index.mapInArrow(run, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN)))
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        for keys in (["ask", "salt"], ["ask"]):
            lists = lists.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        with small_batches(index.sparkSession):
            found = written(lists.select("item_id", "rank", "doc_id", "score"))
        out = found if out is None else out.union(found)
    return out


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, shard_bytes: int = SHARD) -> DataFrame:
    """Indexes all docs in the shared folder and ranks them for each item."""
    index, n = build_index(docs, shared_dir(docs.sparkSession), shard_bytes=shard_bytes)
    return search(index, n, items, k)
