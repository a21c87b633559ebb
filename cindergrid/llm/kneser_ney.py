"""Interpolated modified Kneser-Ney trigram model, counted in Spark, kept as sorted hash arrays, scored from memory maps.

Words are counted first; each gets a number that is small where it is frequent, so that n-grams travel as columns of
numbers that compress well. Trigrams (w1, w2, w3) are counted within tasks, then by shard, and a shard holds all trigrams
of its middle words: what starts with (w1, w2), what ends with (w2, w3) and what follows w2 is complete there, so one
shuffle counts both orders. A shard's task writes its counts as one file of sorted hashes into the shared folder.

A word that makes up more than half a shard is hot: its trigrams are dealt by (w1, w2), its pairs (w2, w3) are summed
by a second, smaller shuffle. A hot pair (w1, w2) is dealt by the whole trigram. What is kept of hot words and pairs
as contexts are four sums each, for at most HOT_MOST of each, whatever the input.

Scoring brings the n-grams to the shards, not the shards to the texts: trigrams of the texts travel to the task of
their shard, which maps that file once and returns a sum for each text. Trigrams with a hot middle word stop at
the task of (w2, w3) on their way. A trigram that is very frequent in a slice is dealt to any task, which maps its file. Only the
words' table is mapped by every task. Nothing is loaded whole, broadcast or sent to the driver but the bounded sums.
A file keeps of each hash the bits that its place doesn't tell and 40 more: an unseen n-gram is taken for a seen one once in 3e10.

A null text counts as empty: it holds the end token alone. A null doc_id is learned from like any other id. Equal texts,
ties and repeated rows count each on its own. Very long texts are cut by no limit: a slice holds one text at least.
docs must give the same rows in the same order when a lost task is computed again, as a table does.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cindergrid.llm import bytewords as bw
from cindergrid.llm.common import discard, shared_dir, written

BOS, EOS = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6B27D4EB2F)
#: Numbers of the unknown word and of the begin of a text; words follow.
UNKNOWN, BEGIN, FIRST_WORD = 0, 1, 2
SLICE_TOKENS, SHARD_TOKENS, LOOKUP_TOKENS = 1_000_000, 2_500_000, 1_500_000
WORD_BYTES, MERGE_WORDS, BLOCK_BITS = 256 << 20, 1_500_000, 13
LEAST_SHARDS, MOST_PARTS, HOT_MOST = 32, 20_000, 1 << 20
ROWS = "kind int, part int, file long, blob binary, sums array<long>"
#: Kinds of rows while counting: sums alone, parts of counts, hot words and pairs.
TALLY, WORDS, GRAMS, NEXT, HOT_WORD, HOT_PAIR = range(6)


# files: arrays one after the other


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def narrow(column: np.ndarray) -> np.ndarray:
    return column.astype(np.min_scalar_type(int(column.max()) if len(column) else 0))


def save(uri: str, arrays: list[np.ndarray]) -> None:
    """The number of arrays, their lengths and widths, then the arrays; under another name first, so that only whole files are seen."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(part := f"{path}.{os.getpid()}-{os.urandom(4).hex()}") as f:
        f.write(np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], np.int64).tobytes())
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
    fs.move(part, path)


class Maps:
    """Memory maps of model files, the last few hundred of them open. Files in a remote store are spooled to the task's disk."""

    def __init__(self, limit: int = 400):
        self.open, self.limit = OrderedDict(), limit

    def get(self, uri: str) -> list[np.ndarray]:
        """The file's arrays; none where there is no such file."""
        if uri in self.open:
            self.open.move_to_end(uri)
            return self.open[uri]
        from pyarrow import fs as pafs

        fs, path = filesystem(uri)
        found = []
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            if not isinstance(fs, pafs.LocalFileSystem):
                with tempfile.NamedTemporaryFile() as spool, fs.open_input_stream(path) as f:
                    while piece := f.read(8 << 20):
                        spool.write(piece)
                    spool.flush()
                    raw = np.memmap(spool.name, np.uint8, "r")  # the map outlives the name
            else:
                raw = np.memmap(path, np.uint8, "r")
            n = int(raw[:8].view(np.int64)[0])
            at = 8 + 16 * n
            for length, width in raw[8:at].view(np.int64).reshape(n, 2).tolist():
                found.append(raw[at : at + length * width].view(f"u{width}"))
                at += -(-length * width // 8) * 8
        self.open[uri] = found
        if len(self.open) > self.limit:
            self.open.popitem(last=False)
        return found


# columns of whole numbers as compressed bytes


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length: their bytes plane by plane, so that what varies little is squeezed well."""
    planes, widths = [], []
    for c in columns:
        c = np.ascontiguousarray(c.view(np.uint64) if c.dtype.itemsize == 8 else c.astype(np.uint64))
        widths.append((int(c.max()).bit_length() + 7) // 8 if len(c) else 0)
        planes.append(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, : widths[-1]].T).tobytes())
    raw = b"".join([np.array([len(columns[0]), *widths], np.int64).tobytes(), *planes])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, *widths = raw[: 8 * (columns + 1)].view(np.int64).tolist()
    at, out = 8 * (columns + 1), []
    for w in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = raw[at : at + n * w].reshape(w, n).T
        out.append(wide.reshape(-1).view(np.int64))
        at += n * w
    return out


def rows_of(kind: int, parts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    n = len(parts)
    return pa.record_batch([pa.array([kind] * n, pa.int32()), pa.array(parts, pa.int32()), pa.array(parts, pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))], names=["kind", "part", "file", "blob", "sums"])


def sum_rows(kind: int, part: int, sums: list[list[int]]) -> pa.RecordBatch:
    n = len(sums)
    return pa.record_batch([pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(sums, pa.list_(pa.int64()))], names=["kind", "part", "file", "blob", "sums"])


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows that differ from the row before start."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def sorter(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by columns of whole numbers from 0, the first one first; equal rows in any order.

    Columns are joined to as few 64-bit keys as hold them; of one key the sort is many times faster than of several.
    """
    keys, room = [np.zeros(len(columns[0]), np.uint64)], 64
    for c in reversed(columns):
        bits = int(c.max()).bit_length() if len(c) else 0
        if bits > room:
            keys, room = [*keys, np.zeros(len(c), np.uint64)], 64
        if bits:
            keys[-1] |= c.astype(np.uint64) << np.uint64(64 - room)
            room -= bits
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys)


def settled(order: np.ndarray, times: np.ndarray) -> np.ndarray:
    """An order whose runs of equal rows have the given lengths, each run put in ascending order."""
    bits = len(order).bit_length()
    if bits > 31:
        return order[np.lexsort((order, np.repeat(np.arange(len(times)), times)))]
    key = np.repeat(np.arange(len(times)), times) << bits | order
    key.sort()
    return key & ((1 << bits) - 1)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with the sums of n."""
    order = np.argsort(key)
    at = runs(key[order])
    return key[order][at], np.add.reduceat(n[order], at) if len(at) else n


def dealt(kind: int, part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each part, which sorts the columns together."""
    at = runs(part)
    ends = np.r_[at[1:], len(part)]
    return rows_of(kind, part[at].tolist(), [pack(*(c[a:b] for c in columns)) for a, b in zip(at, ends)])


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes of equal width."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def folded(*words: np.ndarray) -> np.ndarray:
    """A hash of rows of word numbers."""
    return bw.fold([bw.mix(words[0].astype(np.uint64) + np.uint64(bw.BASE)), *(w.astype(np.uint64) for w in words[1:])])


def place_in(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Each wanted value's place among the ascending values, -1 where it isn't there."""
    if not len(values) or not len(wanted):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[at] == wanted, at, -1)


# hash tables


def table(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Arrays of rows in order of their hash: how many share the top bits, the next 40 bits, the values."""
    bits = max(0, len(key).bit_length() - 5)
    rest = key >> np.uint64(24 - bits)
    top = (rest >> np.uint64(40)).astype(np.int64)
    return [narrow(np.bincount(top, minlength=1 << bits)), (rest >> np.uint64(8)).astype(np.uint32), rest.astype(np.uint8), *map(narrow, values)]


def found_in(arrays: list[np.ndarray], key: np.ndarray) -> np.ndarray:
    """Each key's row in a table, -1 where it isn't there."""
    count, high, low = arrays[:3]
    bits = len(count).bit_length() - 1
    top = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    known = top << np.uint64(40) | high.astype(np.uint64) << np.uint64(8) | low
    return place_in(known, key >> np.uint64(24 - bits))


def count_table(key: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Two tables: of what was counted once, and of the rest with its counts."""
    more = np.flatnonzero(count != 1)
    more = more[np.argsort(key[more])]
    return [*table(np.sort(key[count == 1])), *table(key[more], count[more])]


def counts_in(arrays: list[np.ndarray], key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)  # ascending keys are found much faster
    key = key[order]
    found = (found_in(arrays[:3], key) >= 0).astype(np.float64)
    at = found_in(arrays[3:7], key)
    found[at >= 0] = arrays[6][at[at >= 0]]
    out = np.empty(len(key))
    out[order] = found
    return out


def sums_table(key: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
    """Of contexts: two tables, those seen once, and the rest with (total, seen once, twice, more often)."""
    more = np.flatnonzero(sums[0] != 1)
    more = more[np.argsort(key[more])]
    return [*table(np.sort(key[sums[0] == 1])), *table(key[more], *(x[more] for x in sums))]


def sums_in(arrays: list[np.ndarray], key: np.ndarray) -> np.ndarray:
    key, back = np.unique(key, return_inverse=True)
    out = np.zeros((4, len(key)))
    out[:2, found_in(arrays[:3], key) >= 0] = 1
    at = found_in(arrays[3:6], key)
    for o, column in zip(out, arrays[6:10]):
        o[at >= 0] = column[at[at >= 0]]
    return out[:, back]


def context_sums(count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For groups of counts that start at `at`: total, and how many are 1, 2 and more."""
    if not len(count):
        return np.zeros((4, 0), np.int64)
    return np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (count, count == 1, count == 2, count > 2)])


def tally(count: np.ndarray) -> list[int]:
    return [int((count == i).sum()) for i in (1, 2, 3, 4)]


# texts


def slices(batches, keep: list[str]):
    """Lists of (rows' kept columns, their words' hashes, number of words of each row) of about SLICE_TOKENS tokens together."""
    held, n = [], 0
    for batch in batches:
        own = batch.select(keep)
        for lo, hi, h, first in bw.word_hashes(batch.column("__text")):
            held.append((own.slice(lo, hi - lo), h, np.diff(first)))
            n += len(h) + hi - lo
            if n >= SLICE_TOKENS:
                yield held
                held, n = [], 0
    if held:
        yield held


def trigrams(words: np.ndarray, count: np.ndarray, begin, end) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """w1, w2 and w3 of every token of texts with two begins before and an end after each, and the token's text."""
    n = len(count)
    start = np.r_[0, np.cumsum(count[:-1] + 3)] if n else np.zeros(0, np.int64)
    line = np.full(len(words) + 3 * n, begin, words.dtype)
    line[np.arange(len(words)) + 3 * np.repeat(np.arange(n), count) + 2] = words
    line[start + count + 2] = end
    token = np.ones(len(line), bool)
    token[start], token[start + 1] = False, False
    at = np.flatnonzero(token)
    return line[at - 2], line[at - 1], line[at], np.repeat(np.arange(n), count + 1)


def by_file(batches, kind: int, columns: int, most: float = math.inf):
    """Rows of the kind, sorted by file, as (file, columns), at most about `most` of these together. Other rows come as (None, batch)."""
    held, now, n = [], None, 0
    for batch in batches:
        own = batch.column("kind").to_numpy() == kind
        if not own.all():
            yield None, batch.filter(pa.array(~own))
        files = batch.column("file").to_numpy()
        for i in np.flatnonzero(own).tolist():
            if held and (now != files[i] or n >= most):
                yield now, [np.concatenate(c) for c in zip(*held)]
                held, n = [], 0
            held.append(unpack(batch.column("blob")[i].as_py(), columns))
            now, n = int(files[i]), n + len(held[-1][0])
    if held:
        yield now, [np.concatenate(c) for c in zip(*held)]


def spread(rows: DataFrame, parts: int, part: Column | None = None) -> DataFrame:
    """Rows by part, sorted by file; a task holds several parts only where there are more of them than tasks."""
    part = F.col("part") if part is None else part
    return rows.repartitionById(parts, F.pmod(part, F.lit(parts)).cast("int")).sortWithinPartitions("file")


class KneserNey:
    """A trained model: the folder of its files, and the few numbers that hold for all of it."""

    def __init__(self, folder: str, order: int):
        self.folder, self.order = folder, order

    @staticmethod
    def fit(docs: DataFrame, text: str = "text", order: int = 3, shard_tokens: int = SHARD_TOKENS, least_shards: int = LEAST_SHARDS) -> KneserNey:
        """Learns from every text of docs. order: 3, or 2 for pairs alone."""
        if order not in (2, 3):
            raise ValueError("order must be 2 or 3")
        model = KneserNey(shared_dir(docs.sparkSession), order)
        texts = docs.select(F.col(text).alias("__text"))
        model.count_words(texts, least_shards)
        model.shards = max(least_shards, math.ceil(model.total / shard_tokens))
        model.find_hot(shard_tokens)
        model.count_grams(texts)
        return model

    def count_words(self, texts: DataFrame, least_shards: int) -> None:
        """Files words/<shard>: hashes, numbers within the shard by descending count, counts. Sets total and types."""
        size = texts.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
        shards = self.word_shards = max(least_shards, math.ceil(size / WORD_BYTES))
        folder = self.folder
        # a pair is reported by a slice in which it is a quarter as frequent as a hot one, or four times there
        share = 1 / (4 * min(HOT_MOST, 2 * max(least_shards, size // (6 * SHARD_TOKENS))))

        def count(batches):
            words, n = [], 0
            for held in slices(batches, []):
                h, texts = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
                words.append(np.unique(np.r_[h, np.full(len(texts), EOS, np.uint64)], return_counts=True))
                n += len(words[-1][0])
                if n > MERGE_WORDS:
                    words = [summed(*(np.concatenate(x) for x in zip(*words)))]
                    n = len(words[0][0])
                    if n > MERGE_WORDS // 2:
                        yield dealt(WORDS, shard_of(words[0][0], shards), *words[0])
                        words, n = [], 0
                _, b, c, _ = trigrams(h, texts, BOS, EOS)
                pair, times = np.unique(bw.fold([b, c]), return_counts=True)
                often = times >= max(4, share * len(h))
                if often.any():
                    for part in np.unique(own := shard_of(pair[often], shards)).tolist():
                        at = own == part
                        yield sum_rows(HOT_PAIR, part, np.c_[pair[often][at].view(np.int64), times[often][at]].tolist())
            if words:
                key, n = summed(*(np.concatenate(x) for x in zip(*words)))
                yield dealt(WORDS, shard_of(key, shards), key, n)

        def merge(batches):
            for shard, got in by_file(batches, WORDS, 2):
                if shard is None:
                    yield got
                    continue
                key, n = summed(got[0].view(np.uint64), got[1])
                rank = np.zeros(len(n), np.int64)
                rank[np.lexsort((key, -n))] = np.arange(len(n))
                save(f"{folder}/words/{shard}", [key, narrow(rank), narrow(n)])
                often = n >= max(2, int(share * size / 64))
                yield sum_rows(TALLY, shard, [[int(n.sum()), len(n)]])
                yield sum_rows(HOT_WORD, shard, [[FIRST_WORD + int(r) * shards + shard, int(m)] for r, m in zip(rank[often], n[often])])

        made = spread(texts.mapInArrow(count, ROWS), min(shards, MOST_PARTS)).mapInArrow(merge, ROWS)
        self.found = written(made)
        at = lambda i: F.get("sums", F.lit(i))
        self.total, self.types = self.found.where(F.col("kind") == TALLY).agg(F.coalesce(F.sum(at(0)), F.lit(0)), F.coalesce(F.sum(at(1)), F.lit(0))).first()
        end = Maps().get(f"{folder}/words/{int(shard_of(np.array([EOS]), shards)[0])}")
        place = int(place_in(end[0], np.array([EOS]))[0]) if end else -1
        self.texts = int(end[2][place]) if place >= 0 else 0
        self.end = FIRST_WORD + int(end[1][place]) * shards + int(shard_of(np.array([EOS]), shards)[0]) if place >= 0 else UNKNOWN

    def find_hot(self, shard_tokens: int) -> None:
        """Sets the hot words (numbers, and where each one's parts start) and the hot pairs (hashes of hashes)."""
        at = lambda i: F.get("sums", F.lit(i))
        least = self.total / min(HOT_MOST, 2 * self.shards)
        words = [(r[0], r[1]) for r in self.found.where((F.col("kind") == HOT_WORD) & (at(1) > least)).select(at(0), at(1)).collect()]
        words = sorted(words + ([(BEGIN, self.texts)] if self.texts > least else []))
        pairs = self.found.where(F.col("kind") == HOT_PAIR).groupBy(at(0).alias("pair")).agg(F.sum(at(1)).alias("n")).where(F.col("n") > least).select("pair").collect()
        self.hot = np.array([w for w, _ in words], np.int64)
        # a hot word's pairs with the next word are dealt to as many parts as it has shards' worth of tokens
        self.parts = np.array([max(1, math.ceil(n / max(shard_tokens, 1))) for _, n in words], np.int64)
        self.first_part = np.r_[0, np.cumsum(self.parts)]
        self.hot_pairs = np.sort(np.array([r.pair for r in pairs], np.int64).view(np.uint64))
        discard(self.found)
        del self.found

    def word_numbers(self, maps: Maps, h: np.ndarray, uses: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the distinct hashes: number, count, if asked for the number of words seen before it; and each hash's place among these."""
        key, back = np.unique(h, return_inverse=True)
        number, count, before = np.full(len(key), UNKNOWN, np.int64), np.zeros(len(key)), np.zeros(len(key))
        shard = shard_of(key, self.word_shards)
        at = runs(shard)
        for a, b in zip(at, np.r_[at[1:], len(key)]):
            s = int(shard[a])
            if arrays := maps.get(f"{self.folder}/words/{s}"):
                i = place_in(arrays[0], key[a:b])
                hit = np.flatnonzero(i >= 0)
                rank = arrays[1][i[hit]].astype(np.int64)
                number[a + hit], count[a + hit] = FIRST_WORD + rank * self.word_shards + s, arrays[2][i[hit]]
                if uses:
                    before[a + hit] = maps.get(f"{self.folder}/before/{s}")[0][rank]
        return number, count, before, back

    def before(self, maps: Maps, words: np.ndarray) -> np.ndarray:
        """How many different words each word was seen after."""
        key, back = np.unique(words, return_inverse=True)
        out = np.zeros(len(key))
        shard, rank = (key - FIRST_WORD) % self.word_shards, (key - FIRST_WORD) // self.word_shards
        shard[key < FIRST_WORD] = -1
        order = np.argsort(shard, kind="stable")
        at = runs(shard[order])
        for a, b in zip(at, np.r_[at[1:], len(key)]):
            own = order[a:b]
            if shard[own[0]] >= 0:
                out[own] = maps.get(f"{self.folder}/before/{shard[own[0]]}")[0][rank[own]]
        return out[back]

    def hot_part(self, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The part of pairs (b, c), b hot."""
        j = np.searchsorted(self.hot, b)
        return self.first_part[j] + ((folded(c) >> np.uint64(32)) * self.parts[j].astype(np.uint64) >> np.uint64(32)).astype(np.int64)

    def cold_shard(self, b: np.ndarray) -> np.ndarray:
        return shard_of(bw.mix(folded(b)), self.shards)

    def shard(self, heat: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """heat: 0, or 1 where b is hot, or 2 where (a, b) is."""
        key = folded(b)
        key[heat == 1] = folded(a[heat == 1], b[heat == 1])
        key[heat == 2] = folded(a[heat == 2], b[heat == 2], c[heat == 2])
        return shard_of(bw.mix(key), self.shards)

    def count_grams(self, texts: DataFrame) -> None:
        """Files grams/<shard>, hot/<part> and before/<word shard>, and the numbers that scoring needs."""
        model, folder, order, shards, word_shards = self, self.folder, self.order, self.shards, self.word_shards
        hot_parts = int(self.first_part[-1])

        def count(batches):
            maps = Maps()
            for held in slices(batches, []):
                h, n = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
                number, _, _, back = model.word_numbers(maps, h)
                # places among the slice's own numbers are small, so that a trigram is sorted as one key
                ids, place = np.unique(np.r_[number, BEGIN, model.end], return_inverse=True)
                a, b, c, _ = trigrams(place[back], n, place[-2], place[-1])
                if order == 2:
                    a = np.zeros_like(a)
                before = lambda a: np.zeros_like(a) if order == 2 else ids[a]
                heat = (place_in(model.hot, ids) >= 0).astype(np.int64)[b]
                warm = np.flatnonzero(heat)
                if order == 2:
                    heat *= 2
                elif len(model.hot_pairs) and len(warm):
                    x, y, _, _ = trigrams(h, n, BOS, EOS)
                    heat[warm[place_in(model.hot_pairs, bw.fold([x[warm], y[warm]])) >= 0]] = 2
                shard = model.cold_shard(ids)[b]
                shard[warm] = model.shard(heat[warm], before(a[warm]), ids[b[warm]], ids[c[warm]])
                sort = sorter(shard, b, a, c)
                shard, a, b, c = (x[sort] for x in (shard, a, b, c))
                at = runs(shard, a, b, c)
                yield dealt(GRAMS, shard[at], heat[sort[at]], ids[b[at]], before(a[at]), ids[c[at]], np.diff(np.r_[at, len(sort)]))

        def next_words(b, c, n):
            """From counts of pairs sorted by b: the sums of each b; and rows of how many different words each c follows."""
            word, times = np.unique(c, return_counts=True)
            own = (word - FIRST_WORD) % word_shards
            sort = sorter(own, word)
            at = runs(b)
            return b[at], context_sums(n, at), dealt(NEXT, own[sort], word[sort], times[sort])

        def merge(batches):
            for shard, (heat, b, a, c, n) in by_file(batches, GRAMS, 5):
                sort = sorter(b, a, c)
                heat, b, a, c, n = (x[sort] for x in (heat, b, a, c, n))
                at = runs(b, a, c)
                heat, b, a, c, n = heat[at], b[at], a[at], c[at], np.add.reduceat(n, at)
                ends = tally(n)
                files = count_table(folded(a, b, c), n) if order == 3 else count_table(np.zeros(0, np.uint64), n[:0])
                at = runs(b, a)
                sums, own = context_sums(n, at), heat[at] < 2
                kept = own if order == 3 else np.zeros(len(at), bool)
                files += sums_table(folded(a[at], b[at])[kept], sums[:, kept])
                if order == 3 and not own.all():
                    yield sum_rows(HOT_PAIR, shard, np.c_[a[at], b[at], sums.T][~own].tolist())
                # pairs: how many words were seen before them; what starts a text has none, so its own count stands
                sort = sorter(b, c)
                heat, b, c, n = heat[sort], b[sort], c[sort], n[sort]
                at = runs(b, c)
                seen = np.add.reduceat(n if order == 2 else np.where(b == BEGIN, n, 1), at)
                heat, b, c = heat[at], b[at], c[at]
                cold = heat == 0
                files += count_table(folded(b[cold], c[cold]), seen[cold])
                word, sums, rows = next_words(b[cold], c[cold], seen[cold])
                save(f"{folder}/grams/{shard}", files + sums_table(folded(word), sums))
                yield rows
                yield sum_rows(TALLY, shard, [[*ends, *tally(seen[cold])]])
                b, c, seen = b[~cold], c[~cold], seen[~cold]
                part = model.hot_part(b, c)
                sort = np.argsort(part, kind="stable")
                yield dealt(GRAMS, part[sort], b[sort], c[sort], seen[sort])

        def merge_hot(batches):
            for part, (b, c, n) in by_file(batches, GRAMS, 3):
                sort = sorter(b, c)
                b, c, n = b[sort], c[sort], n[sort]
                at = runs(b, c)
                b, c, n = b[at], c[at], np.add.reduceat(n, at)
                save(f"{folder}/hot/{part}", count_table(folded(b, c), n))
                word, sums, rows = next_words(b, c, n)
                yield rows
                yield sum_rows(TALLY, part, [[0, 0, 0, 0, *tally(n)]])
                yield sum_rows(HOT_WORD, part, np.c_[word, sums.T].tolist())

        def merge_next(batches):
            for shard, (word, n) in by_file(batches, NEXT, 2):
                rank = (word - FIRST_WORD) // word_shards
                times = np.bincount(rank, n).astype(np.int64)
                save(f"{folder}/before/{shard}", [narrow(times)])
                yield sum_rows(TALLY, shard, [[*tally(times), int(times.sum())]])

        cold = written(spread(texts.mapInArrow(count, ROWS), min(shards, MOST_PARTS)).mapInArrow(merge, ROWS))
        is_ = lambda kind: F.col("kind") == kind
        warm = written(spread(cold.where(is_(GRAMS)), min(max(hot_parts, 1), MOST_PARTS)).mapInArrow(merge_hot, ROWS))
        both = cold.union(warm)
        last = written(spread(both.where(is_(NEXT)), min(word_shards, MOST_PARTS)).mapInArrow(merge_next, ROWS))
        add = lambda df, n: [x or 0 for x in df.where(is_(TALLY)).agg(*(F.sum(F.get("sums", F.lit(i))) for i in range(n))).first()]
        counts, firsts = add(both, 8), add(last, 5)
        self.discounts = [np.array([0.0, *discount(n)]) for n in (firsts[:4], counts[4:], counts[:4])]
        self.base = firsts[4]
        d, once, twice = self.discounts[0], firsts[0], firsts[1]
        # what the single words' discounts leave to the even spread over all words and the unknown one
        self.left = (d[1] * once + d[2] * twice + d[3] * (self.types - once - twice)) / self.base if self.base else 1.0

        def sums_by(df, kind, keys):
            """Of at most HOT_MOST words or pairs: their hashes in order, and their sums."""
            rows = df.where(is_(kind)).groupBy(*(F.get("sums", F.lit(i)).alias(f"k{i}") for i in range(keys))).agg(*(F.sum(F.get("sums", F.lit(keys + i))) for i in range(4))).collect()
            got = np.array([tuple(r) for r in rows], np.int64).reshape(-1, keys + 4)
            key = folded(*(got[:, i] for i in range(keys)))
            sort = np.argsort(key)
            return key[sort], got[sort, keys:].T.astype(np.float64)

        self.hot_key, self.hot_sums = sums_by(warm, HOT_WORD, 1)
        self.pair_key, self.pair_sums = sums_by(cold, HOT_PAIR, 2)
        discard(cold, warm, last)

    # probabilities

    def single(self, before: np.ndarray) -> np.ndarray:
        """Probabilities of words by how many words each was seen after; none for the unknown one."""
        d = self.discounts[0]
        return (before - d[np.minimum(before, 3).astype(int)]) / max(self.base, 1) + self.left / (self.types + 1)

    def raised(self, order: int, p: np.ndarray, count: np.ndarray, sums: np.ndarray, times: np.ndarray | int = 1) -> np.ndarray:
        """Of the order, from those of the order below, counts and the contexts' sums; a context is that of so many rows in turn."""
        d, total = self.discounts[order - 1], np.maximum(sums[0], 1)
        held = np.where(sums[0] > 0, (d[1] * sums[1] + d[2] * sums[2] + d[3] * sums[3]) / total, 1.0)
        total, held = np.repeat(total, times), np.repeat(held, times)
        return (count - d[np.minimum(count, 3).astype(int)]) / total + held * p

    def score(self, docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """The kept columns and n_tokens, n_known, base_score (smoothed unigrams) and score (log10 of each whole text)."""
        keep = [c for c in docs.columns if c != text] if keep is None else keep
        named = [f"k{i}" for i in range(len(keep))]
        rows = docs.select(F.monotonically_increasing_id().alias("row"), *(F.col(c).alias(k) for c, k in zip(keep, named)), F.coalesce(F.col(text), F.lit("")).alias("__text"))
        model, folder, order, shards = self, self.folder, self.order, self.shards
        parts, hot_parts = min(shards, MOST_PARTS), min(max(int(self.first_part[-1]), 1), MOST_PARTS)
        WHOLE, COLD, HOT, RAISED, ANSWER = range(5)
        fields = [T.StructField("row", T.LongType()), *(T.StructField(k, docs.schema[c].dataType) for c, k in zip(keep, named)), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
        asked = [T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("file", T.LongType()), T.StructField("blob", T.BinaryType())]
        whole, request = T.StructType([*asked, *fields]), T.StructType(asked)
        kinds = to_arrow_schema(T.StructType(fields)).types

        def requests(kind, part, file, columns):
            """Columns sorted by part and file as rows of (kind, part, file, blob)."""
            at = runs(part, file)
            blobs = [pack(*(c[x:y] for c in columns)) for x, y in zip(at, np.r_[at[1:], len(part)])]
            return [pa.array([kind] * len(at), pa.int32()), pa.array(part[at], pa.int32()), pa.array(file[at], pa.int64()), pa.array(blobs, pa.binary())]

        def part_of(block):
            # row numbers of tasks are far apart, so blocks are dealt by a hash
            return shard_of(bw.mix(block.astype(np.uint64) + np.uint64(bw.BASE)), parts)

        def ask(want_hot: bool):
            def run(batches):
                maps, N, V = Maps(), model.total, model.types
                for held in slices(batches, ["row", *named]):
                    h, n = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
                    row = np.concatenate([x[0].column("row").to_numpy() for x in held])
                    number, count, before, back = model.word_numbers(maps, np.r_[h, EOS], not want_hot)
                    number = np.r_[number, BEGIN]
                    a, b, c, owner = trigrams(back[:-1], n, len(number) - 1, back[-1])
                    if not want_hot:
                        lone = np.where((number == UNKNOWN)[b], np.log10(model.single(before))[c], 0.0)
                        each = lambda x: np.bincount(owner, x, len(n))
                        sums = [n + 1, each((count > 0)[c]).astype(np.int64), each(np.log10((count + 0.5) / (N + 0.5 * (V + 1)))[c]), each(lone)]
                        lo = 0
                        for own, _, _ in held:
                            hi = lo + own.num_rows
                            blank = [pa.array(np.full(hi - lo, WHOLE, np.int32)), pa.array(part_of(row[lo:hi] >> BLOCK_BITS), pa.int32()), pa.array(row[lo:hi] >> BLOCK_BITS), pa.nulls(hi - lo, pa.binary())]
                            yield pa.RecordBatch.from_arrays([*blank, *(own.column(x) for x in ["row", *named]), *(pa.array(s[lo:hi]) for s in sums)], names=whole.names)
                            lo = hi
                    at = np.flatnonzero(((number != UNKNOWN) & ((place_in(model.hot, number) >= 0) == want_hot))[b])
                    # places among the slice's own numbers are small; middle words are placed by shard first, which need not be sorted by then
                    ids, place = np.unique(number, return_inverse=True)
                    shard = model.cold_shard(ids)
                    own = sorter(shard, ids)
                    rank = np.empty(len(own), np.int64)
                    rank[own] = np.arange(len(own))
                    middle, shard = ids[own], shard[own]
                    a, b, c, owner = place[a[at]], rank[place[b[at]]], place[c[at]], owner[at]
                    if order == 2:
                        a = np.zeros_like(a)
                    sort = sorter(model.hot_part(middle[b], ids[c]), b, a, c) if want_hot else sorter(b, a, c)
                    a, b, c = (x[sort] for x in (a, b, c))
                    at = runs(b, a, c)
                    times = np.diff(np.r_[at, len(b)])
                    owner = owner[settled(sort, times)]
                    file = shard[b]
                    a, b, c = np.zeros_like(a) if order == 2 else ids[a], middle[b], ids[c]
                    if want_hot:
                        file, heat = model.hot_part(b, c), np.where(place_in(model.pair_key, folded(a, b)) >= 0, 2, 1)
                    # what fills a good part of a shard by itself goes to any task
                    often = np.repeat(times > max(256, len(file) // (2 * shards)), times)
                    tasks = hot_parts if want_hot else parts
                    part = np.where(often, (file + int(row[0] % 1_000_003)) % tasks, file % tasks)
                    sort = sorter(part, file, np.arange(len(part)))
                    made = requests(HOT if want_hot else COLD, part[sort], file[sort], [x[sort] for x in (b, a, c, row[owner])] + ([heat[sort]] if want_hot else []))
                    if want_hot:
                        yield pa.RecordBatch.from_arrays(made, names=request.names)
                    else:
                        yield pa.RecordBatch.from_arrays([*made, *(pa.nulls(len(made[0]), k) for k in kinds)], names=whole.names)

            return run

        def answers(row, logs):
            """The sum of logarithms for each text, by blocks of texts that are neighbours in the input."""
            key, back = np.unique(row, return_inverse=True)
            block = key >> BLOCK_BITS
            return requests(ANSWER, part_of(block), block, [key, np.bincount(back, logs, len(key))])

        def answered(row, p):
            made = answers(row, np.log10(p))
            return pa.RecordBatch.from_arrays(made, names=request.names)

        def look_up(batches):
            maps, words = Maps(8), Maps()
            for file, got in by_file(batches, COLD, 4, LOOKUP_TOKENS):
                if file is None:
                    yield got
                    continue
                # each trigram is looked up once
                sort = sorter(*got[:3])
                b, a, c, row = (x[sort] for x in got)
                at = runs(b, a, c)
                times = np.diff(np.r_[at, len(b)])
                b, a, c = b[at], a[at], c[at]
                p = model.single(model.before(words, c))
                if arrays := maps.get(f"{folder}/grams/{file}"):
                    at = runs(b)
                    p = model.raised(2, p, counts_in(arrays[17:24], folded(b, c)), sums_in(arrays[24:34], folded(b[at])), np.diff(np.r_[at, len(b)]))
                    if order == 3:
                        at = runs(b, a)
                        p = model.raised(3, p, counts_in(arrays[:7], folded(a, b, c)), sums_in(arrays[7:17], folded(a[at], b[at])), np.diff(np.r_[at, len(b)]))
                made = answers(row, np.repeat(np.log10(p), times))
                yield pa.RecordBatch.from_arrays([*made, *(pa.nulls(len(made[0]), k) for k in kinds)], names=whole.names)

        def look_up_hot(batches):
            maps, words = Maps(8), Maps()
            for file, (b, a, c, row, heat) in by_file(batches, HOT, 5, LOOKUP_TOKENS):
                p = model.single(model.before(words, c))
                arrays, at = maps.get(f"{folder}/hot/{file}"), place_in(model.hot_key, folded(b))
                p = model.raised(2, p, counts_in(arrays, folded(b, c)) if arrays else np.zeros(len(b)), np.where(at >= 0, model.hot_sums[:, at], 0.0))
                if order == 2:
                    yield answered(row, p)
                    continue
                goal = model.shard(heat, a, b, c)
                sort = sorter(goal, b, a, c, row)
                goal, a, b, c, row, heat, p = (x[sort] for x in (goal, a, b, c, row, heat, p))
                times = np.diff(np.r_[runs(goal, a, b, c), len(goal)])
                often = np.repeat(times > LOOKUP_TOKENS // 8, times)
                part = np.where(often, (goal + file) % parts, goal % parts)
                sort = sorter(part, goal, np.arange(len(part)))
                yield pa.RecordBatch.from_arrays(requests(RAISED, part[sort], goal[sort], [x[sort] for x in (b, a, c, row, heat, p)]), names=request.names)

        def look_up_raised(batches):
            maps = Maps(8)
            for file, (b, a, c, row, heat, p) in by_file(batches, RAISED, 6, LOOKUP_TOKENS):
                arrays, p, pair = maps.get(f"{folder}/grams/{file}"), p.view(np.float64), folded(a, b)
                at = place_in(model.pair_key, pair)
                sums = np.zeros((4, len(b)))
                sums[:, at >= 0] = model.pair_sums[:, at[at >= 0]]
                if arrays:
                    sums[:, at < 0] = sums_in(arrays[7:17], pair[at < 0])
                yield answered(row, model.raised(3, p, counts_in(arrays[:7], folded(a, b, c)) if arrays else np.zeros(len(b)), sums))

        def combine(batches):
            """The texts of each block with the sum of their answers."""

            def out(texts, answers):
                texts = pa.Table.from_batches(texts).combine_chunks().to_batches()[0]
                row, score = texts.column("row").to_numpy(), texts.column("score").to_numpy().copy()
                order = np.argsort(row)
                for key, more in answers:
                    score[order[np.searchsorted(row, key, sorter=order)]] += more.view(np.float64)
                return pa.RecordBatch.from_arrays([*(texts.column(c) for c in out_names[:-1]), pa.array(score)], names=out_names)

            out_names, now, texts, answers = [*named, "n_tokens", "n_known", "base_score", "score"], None, [], []
            for batch in batches:
                block, own = batch.column("file").to_numpy(), batch.column("kind").to_numpy() == WHOLE
                at = runs(block)
                for a, b in zip(at, np.r_[at[1:], len(block)]):
                    if now is not None and block[a] != now:
                        yield out(texts, answers)
                        texts, answers = [], []
                    now = block[a]
                    part = batch.slice(a, b - a)
                    if own[a:b].any():
                        texts.append(part.filter(pa.array(own[a:b])))
                    answers += [unpack(part.column("blob")[i].as_py(), 2) for i in np.flatnonzero(~own[a:b]).tolist()]
            if texts:
                yield out(texts, answers)

        # texts' own rows only pass the look-up, so they are dealt one by one there and meet their block's answers after it
        anywhere = F.when(F.col("kind") == WHOLE, F.xxhash64("row")).otherwise(F.col("part"))
        found = spread(rows.mapInArrow(ask(False), whole), parts, anywhere).mapInArrow(look_up, whole)
        if len(self.hot):
            warm = spread(rows.mapInArrow(ask(True), request), hot_parts).mapInArrow(look_up_hot, request)
            warm = warm if order == 2 else spread(warm, parts).mapInArrow(look_up_raised, request)
            found = found.union(warm.select(*request.names, *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields)))
        out = spread(found, parts).mapInArrow(combine, T.StructType(fields[1:]))
        return out.select(*(F.col(k).alias(c) for c, k in zip(keep, named)), "n_tokens", "n_known", "base_score", "score")


def discount(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen once to four times; fixed ones if those are degenerate."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < x < i for i, x in enumerate(d, 1)):
            return d
    return (0.5, 1.0, 1.5)


def perplexity_table(docs: DataFrame, learn: Column, text: str = "text", order: int = 3, **sizes: int) -> DataFrame:
    """docs' other columns with n_tokens, n_known, train_tokens, base_score and score; learns from the rows where learn holds.

    With no training rows every score is the even spread over the unknown word alone. Columns named like a result
    column are replaced by it; other columns pass through. sizes: see KneserNey.fit.
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    model = KneserNey.fit(docs.where(learn), text, order, **sizes)
    return model.score(docs, text, [c for c in docs.columns if c != text and c not in made]).withColumn("train_tokens", F.lit(model.total).cast("long"))
