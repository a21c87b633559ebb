"""Size-aware heavy-light self-join of n-gram sets under a Jaccard threshold, and its components.

Texts with the same set form one class, which is joined once. Below a boundary the sets are small: there a link can
only be a set and the same set with one n-gram more, so each set enumerates its subsets of one n-gram less and meets
its partner by an equi-join on the subset's hash. Larger sets scan inverted lists of their rarest n-grams: the first
size - ceil(threshold * size) + 1 in order of (bucketed document count, hash) must share one with any partner.
The boundary is where the subsets' cost first exceeds the lists' cost, by totals over all documents.

A list of up to SHORT_LIST sets gives its pairs of compatible size, of which those go that provably differ too much: each set
has a bitmap in which every n-gram flips one bit, and two bitmaps never differ in more bits than the sets in n-grams. A longer
list is never turned into pairs: sorted by size, each run of neighbours of compatible size is tied to the run's smallest id, which many
lists share, so their edges coincide. An n-gram of a hot bucket is a node of its own; its list is dealt by id into PARTS parts, each tied
to its smallest id and that one to the node, so no list is sorted in one place. The components of all this hold every possible link. Each component is cut into blocks by size class and hash; pairs of blocks that
may hold links meet in one task, which counts all overlaps exactly and returns a spanning forest of its links. A component of one
block is shipped once; one of r blocks r times, so only components larger than a partition's share cost more than their size.

Null and empty texts have no set and are linked with nothing; a null doc_id stays in the result with a null
component and cannot be a smallest id. Repeated rows are one class. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm import bytewords as bw
from cindergrid.llm.common import connected_components, discard, with_facts, written

SLICES = 64
#: Bits of the document counts' buckets, one for each KB of text between these: 64 MB of counts at most.
LEAST_BITS, MOST_BITS = 20, 24
BLOCK_SETS, BLOCK_GRAMS, LEAST_GRAMS = 512, 1_000_000, 4096
BROADCAST_IDS = 200_000
SHORT_LIST, PARTS = 32, 64
NODE = "node long"


def needed(a: int, b: int, percent: int) -> int:
    """Least overlap of sets of a and b n-grams at the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def largest_boundary(percent: int) -> int:
    """Below this size a linked pair of different sets is a set and itself with one n-gram more."""
    x = 1
    while needed(x, x, percent) == x and needed(x, x + 2, percent) > x:
        x += 1
    return x


def set_slices(texts: pa.Array, k: int):
    """For slices of the texts: first row, end row, sorted distinct n-gram hashes of each, rows' starts (rows + 1), set ids."""
    for lo, hi, words, first in bw.word_hashes(texts):
        gram, owner = bw.shingles(words, first, k)
        order = np.lexsort((gram, owner))
        gram, owner = gram[order], owner[order]
        fresh = np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])] if len(gram) else np.zeros(0, bool)
        gram, owner = gram[fresh], owner[fresh]
        at = np.searchsorted(owner, np.arange(hi - lo + 1))
        total = np.r_[np.uint64(0), np.cumsum(bw.mix(gram), dtype=np.uint64)]
        yield lo, hi, gram, at, total[at[1:]] - total[at[:-1]]


def set_id(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    return bw.mix(total + size.astype(np.uint64) * np.uint64(bw.BASE)).view(np.int64)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the smallest doc_id reachable by links.

    keyed: also text_key, the xxhash64 of the text, and label, which tells components apart that a repeated doc_id
    makes alike; null for texts without a set.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hashed = texts.withColumn("text_key", F.xxhash64("text"))
    limit = largest_boundary(percent)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size >> 10).bit_length()))
    bucket = lambda gram: (gram >> np.uint64(64 - bits)).astype(np.int64)

    def classes(batches):
        counts = np.zeros(1 << bits, np.int64)
        sizes = np.zeros((limit + 1, 2), np.int64)
        seen = False
        for batch in batches:
            for lo, hi, gram, at, total in set_slices(batch.column(1), n):
                seen = True
                counts += np.bincount(bucket(gram), minlength=1 << bits)
                size = np.diff(at)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(set_id(total, size)), batch.column(2).slice(lo, hi - lo), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names=["doc_id", "size", "cid", "text_key", "slice", "counts"])
        if seen:
            parts = np.split(counts.astype(np.uint32), SLICES)
            yield pa.record_batch([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["doc_id", "size", "cid", "text_key", "slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in table["counts"])
        return pa.table({"slice": table["slice"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    both = written(hashed.mapInArrow(classes, "doc_id long, size long, cid long, text_key long, slice int, counts binary"))
    members = both.where("slice is null").select("doc_id", "size", "cid", "text_key")
    # at most 2**MOST_BITS counts, whatever the input
    counts = np.zeros(1 << bits, np.int64)
    for r in both.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():
        each = (1 << bits) // SLICES
        counts[r.slice * each : (r.slice + 1) * each] = np.frombuffer(r.counts, np.int64)
    hot_at = max(1024, int(8 * counts.mean()))
    rank = spark.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))
    classes_of = written(members.where("size > 0").groupBy("cid", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    total_sets = classes_of.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    groups = classes_of.where("rep is not null")
    # classes with more than a thousandth of all sets, so fewer than a thousand: each task shows one set of each
    many_copies = np.sort(np.array([r.cid for r in classes_of.where(F.col("copies") * 1000 > total_sets).where("copies > 1").select("cid").collect()], np.int64))

    # boundary by cost: subsets are size + 1 rows for each set; lists are the prefix rows and what shares them
    by_size = {r["size"]: r.n for r in groups.where(F.col("size") <= limit).groupBy("size").agg(F.count("*").alias("n")).collect()}
    share = 1 + float((counts.astype(np.float64) ** 2).sum() / max(1, counts.sum())) / max(1.0, float(counts.mean()))
    cost = lambda x: sum(by_size.get(s, 0) * (s + 1) for s in range(1, x + 1)) + sum(by_size.get(s, 0) * (s - -(-percent * s // 100) + 1) * share for s in range(x, limit + 1))
    boundary = min(range(1, limit + 1), key=lambda x: (cost(x), x))

    def repeats(cid: np.ndarray, shown: set[int]) -> np.ndarray:
        """Which sets are of a class with many copies that the task has shown."""
        again = np.zeros(len(cid), bool)
        for i in np.flatnonzero(np.isin(cid, many_copies)).tolist():
            again[i] = int(cid[i]) in shown
            shown.add(int(cid[i]))
        return again

    def signatures(batches):
        """Rows (kind, gram, size, cid): 0 an inverted list's entry, 1 a hot bucket's entry, 2 a subset's hash, 3 a set's own hash."""
        table = rank.value
        shown: set[int] = set()
        for batch in batches:
            for _, _, gram, at, total in set_slices(batch.column(1), n):
                size = np.diff(at)
                cid = set_id(total, size)
                if (again := repeats(cid, shown)).any():
                    gram = gram[np.repeat(~again, size)]
                    size, cid, total = size[~again], cid[~again], total[~again]
                    at = np.r_[0, np.cumsum(size)]
                owner = np.repeat(np.arange(len(size)), size)
                out = []
                if len(own := np.flatnonzero((size > 0) & (size < boundary))):
                    out.append((np.full(len(own), 3), total[own], size[own], cid[own]))
                if len(sub := np.flatnonzero((size[owner] <= boundary) & (100 * (size[owner] - 1) >= percent * size[owner]))):
                    out.append((np.full(len(sub), 2), total[owner[sub]] - bw.mix(gram[sub]), size[owner[sub]] - 1, cid[owner[sub]]))
                gram_all = gram
                keep = size[owner] >= boundary
                gram, owner = gram[keep], owner[keep]
                if len(gram):
                    often = table[bucket(gram)]
                    order = np.lexsort((gram, often, owner))
                    gram, owner, often = gram[order], owner[order], often[order]
                    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    place = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
                    first = place < size[owner] + (-percent * size[owner]) // 100 + 1
                    gram, owner, often = gram[first], owner[first], often[first]
                    out.append(((often >= hot_at).astype(np.int64), gram, size[owner], cid[owner]))
                    yield from bitmaps(gram_all, at, cid, np.flatnonzero(np.diff(at) >= boundary))
                if out:
                    kind, gram, size, cid = (np.concatenate(x) for x in zip(*out))
                    yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(gram.view(np.int64)), pa.array(size, pa.int64()), pa.array(cid, pa.int64()), pa.nulls(len(kind), pa.binary())], names=NAMES)

    rows = texts.where("doc_id is not null").mapInArrow(signatures, "kind int, gram long, size long, cid long, bitmap binary")
    part = F.when(F.col("kind") == 1, F.pmod("cid", F.lit(PARTS)))
    rows = written(rows.repartition("kind", "gram", part).sortWithinPartitions("kind", "gram", part, "size", "cid").mapInArrow(chains(percent), "kind int, u long, v long, bitmap binary"))
    # a set and what it lacks one n-gram of: each set hash has one owner, so this is as long as the subsets
    whole = rows.where("kind = 3").select(F.col("u"), F.col("v").alias("key")).distinct()
    small = rows.where("kind = 2").select(F.col("u").alias("v"), F.col("v").alias("key")).distinct().join(whole, "key").select("u", "v")
    bits = rows.where("kind = 4").select("u", F.col("v").alias("size"), "bitmap").dropDuplicates(["u"])
    pairs = rows.where("kind = 5").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = pairs.join(bits.withColumnsRenamed({"size": "size_u", "bitmap": "bitmap_u"}), "u").join(bits.withColumnsRenamed({"u": "v", "size": "size_v", "bitmap": "bitmap_v"}), "v")
    near = pairs.select("u", "v", "size_u", "size_v", "bitmap_u", "bitmap_v").mapInArrow(close(percent), "u long, v long")
    label = connected_components(rows.where("kind < 2").select("u", "v").distinct().union(near))

    links = small.union(block_links(texts, groups, label, n, percent))
    reach = connected_components(links)
    tops = groups.join(reach.withColumnsRenamed({"node": "cid"}), "cid", "left").select("cid", "size", "rep", "copies", F.coalesce("label", "cid").alias("label"))
    tops = written(tops)
    least = tops.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    at, nothing = F.struct("cid", "size").alias("at"), F.lit(None).cast("long")
    tops = with_facts(tops, least, "label", tops.count()).select(at, "component_id", "label", F.col("copies").alias("n"))
    tops = written(tops.unionByName(classes_of.where("rep is null").select(at, nothing.alias("component_id"), nothing.alias("label"), F.col("copies").alias("n"))))
    sets = members.where("size > 0").select("doc_id", "size", "text_key", at)
    found = with_facts(sets, tops, "at", total_sets).drop("at")
    # texts without a set are alike and meet nowhere
    empty = members.where("coalesce(size, 0) = 0").select("doc_id", "size", "text_key", nothing.alias("component_id"), nothing.alias("label"))
    found = found.unionByName(empty)
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), *(["text_key", "label"] if keyed else []))


NAMES = ["kind", "gram", "size", "cid", "bitmap"]


def bitmaps(gram: np.ndarray, at: np.ndarray, cid: np.ndarray, rows: np.ndarray):
    """Rows of kind 4: for each set a bitmap of twice its size or more, rounded up to a power of two, each n-gram flipping a bit."""
    out = []
    for r in rows.tolist():
        own = gram[at[r] : at[r + 1]]
        width = max(64, 1 << (2 * len(own) - 1).bit_length())
        flips = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        out.append(np.packbits(flips.astype(np.uint8)).tobytes())
    if out:
        m = len(rows)
        yield pa.record_batch([pa.array(np.full(m, 4), pa.int32()), pa.array(cid[rows], pa.int64()), pa.array(np.diff(at)[rows], pa.int64()), pa.array(cid[rows], pa.int64()), pa.array(out, pa.binary())], names=NAMES)


def close(percent: int):
    """Keeps the pairs that may be linked: whose bitmaps differ in no more bits than linked sets of these sizes differ in n-grams."""

    def run(batches):
        for batch in batches:
            u, v, a, b = (batch.column(i).to_numpy() for i in range(4))
            most = (100 - percent) * (a + b) // (100 + percent)
            keep = np.zeros(len(u), bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
                while len(x) > len(y):  # halves of a bitmap folded together are the bitmap of half the width
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                keep[i] = np.bitwise_count(x ^ y).sum() <= most[i]
            yield pa.record_batch([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    return run


def chains(percent: int):
    """Sorted entries to edges, list by list.

    Kind 5: pairs of compatible sizes in short lists; 0: a set and the smallest of its run in longer ones; 1: the smallest of a hot
    n-gram's part and the n-gram. Kinds 2 to 4 pass.
    A list that a batch cuts is held back until it ends, or is long: then its last entry is enough.
    """

    def run(batches):
        held = None
        for batch in batches:
            kind, gram, size, cid = (batch.column(i).to_numpy() for i in range(4))
            rest = kind >= 2
            if rest.any():
                own = batch.filter(pa.array(rest))
                value = np.where(kind[rest] == 4, size[rest], gram[rest])
                yield pa.record_batch([own.column(0), own.column(3), pa.array(value), own.column(4)], names=["kind", "u", "v", "bitmap"])
            part = [x[~rest] for x in (kind, gram, size, cid)]
            if held is not None:
                part = [np.r_[a, b] for a, b in zip(held, part)]
            if not len(part[0]):
                continue
            kind, gram, _, cid = part
            start = int(np.flatnonzero(list_starts(kind, gram, cid))[-1])
            if len(kind) - start > 4 * SHORT_LIST + 200_000:  # a long list goes on: its part here is chained, from the end on later
                yield from edges(part, start)
                held = [x[-1:] for x in part]
                long_list.add((int(kind[-1]), int(gram[-1])))  # a hot list's parts are treated alike, long or not
            else:
                yield from edges([x[:start] for x in part], None)
                held = [x[start:] for x in part]
        if held is not None and len(held[0]):
            yield from edges(held, None)

    long_list: set = set()

    def list_starts(kind, gram, cid):
        part = np.where(kind == 1, cid % PARTS, 0)
        return np.r_[True, (kind[1:] != kind[:-1]) | (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])]

    def edges(part, forced):
        kind, gram, size, cid = part
        if not len(kind):
            return
        fresh = np.r_[True, (kind[1:] != kind[:-1]) | (gram[1:] != gram[:-1]) | (cid[1:] != cid[:-1])]
        kind, gram, size, cid = (x[fresh] for x in (kind, gram, size, cid))
        first = list_starts(kind, gram, cid)
        run_of = np.cumsum(first) - 1
        length = np.bincount(run_of)[run_of]
        if forced is not None:
            length[run_of == run_of[-1]] = SHORT_LIST + 1
        if (int(kind[0]), int(gram[0])) in long_list:
            length[run_of == 0] = SHORT_LIST + 1
        apart = first.copy()
        apart[1:] |= (kind[1:] == 0) & (100 * size[:-1] < percent * size[1:])
        at = np.flatnonzero(apart)
        least = np.minimum.reduceat(cid, at)
        tied = np.repeat(least, np.diff(np.r_[at, len(cid)]))
        star = (cid != tied) & ((kind == 1) | (length > SHORT_LIST))
        out = [(np.zeros(star.sum(), np.int64), cid[star], tied[star])]
        hot = kind[at] == 1
        out.append((np.ones(hot.sum(), np.int64), least[hot], gram[at[hot]]))
        listed = np.flatnonzero((kind == 0) & (length > 1) & (length <= SHORT_LIST))
        for step in range(1, SHORT_LIST):
            a, b = listed[:-step], listed[step:]
            good = (run_of[a] == run_of[b]) & (100 * size[a] >= percent * size[b])
            if not good.any():
                break
            out.append((np.full(good.sum(), 5), cid[a[good]], cid[b[good]]))
        k, u, v = (np.concatenate(x) for x in zip(*out))
        yield pa.record_batch([pa.array(k, pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.nulls(len(k), pa.binary())], names=["kind", "u", "v", "bitmap"])

    return run


def block_links(texts: DataFrame, groups: DataFrame, label: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) between classes that suffice to connect all linked ones, from exact overlaps within each component."""
    ratio = percent / 100 * 0.999  # so that sizes at the threshold are never two classes apart
    own = label.join(groups.withColumnsRenamed({"cid": "node"}), "node").select("node", "label", "size", "rep", F.floor(F.log(F.col("size").cast("double")) / -F.log(F.lit(ratio))).cast("int").alias("class"))
    own = written(own)
    # a block holds a partition's fair share of all n-grams at most, so that one large component is dealt to many tasks
    total, count = own.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    grams = min(BLOCK_GRAMS, max(LEAST_GRAMS, total // int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # a component that fits into one block is one
    whole = own.groupBy("label").agg(((F.count("*") <= BLOCK_SETS) & (F.sum("size") <= grams)).alias("whole"), F.count("*").alias("n"))
    own = with_facts(own, whole, "label", count).withColumn("class", F.when(F.col("whole"), 0).otherwise(F.col("class"))).drop("whole")
    own = own.withColumn("at", F.struct("label", "class"))
    per = own.groupBy("at").agg(F.count("*").alias("n"), F.least(F.count("*"), F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / grams))).cast("int").alias("blocks"))
    near = per.select("at.label", "at.class", "blocks", "n").select("label", F.explode(F.array(F.col("class"), F.col("class") - 1, F.col("class") + 1)).alias("class"), (F.col("class")).alias("of"), "blocks", "n")
    around = near.groupBy(F.struct("label", "class").alias("at")).agg(F.max(F.when(F.col("of") == F.col("class"), F.col("n"))).alias("n"), *(F.max(F.when(F.col("of") == F.col("class") + d, F.col("blocks"))).alias(a) for d, a in ((0, "same"), (-1, "below"), (1, "above"))))
    own = with_facts(own, around.where("same is not null"), "at", count).withColumn("block", F.pmod(F.xxhash64("node"), F.col("same")).cast("int"))
    need = written(own.select("node", "label", "size", "rep", "class", "block", "same", F.coalesce("below", F.lit(0)).alias("below"), F.coalesce("above", F.lit(0)).alias("above")))

    placed = [c for c in need.columns if c != "rep"]
    # the one text of each class that takes part; their ids are broadcast where they are few, else both sides are shuffled
    ids = need.withColumnRenamed("rep", "doc_id")
    texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id")
    texts = texts.withColumn("same_text", F.xxhash64("text")).dropDuplicates(["node", "same_text"]).select(*placed, "text")

    def sets(batches):
        for batch in batches:
            node = batch.column(0).to_numpy()
            for lo, hi, gram, at, total in set_slices(batch.column(len(placed)), n):
                own = np.flatnonzero(set_id(total, np.diff(at)) == node[lo:hi])
                part = batch.slice(lo, hi - lo).take(pa.array(own))
                blobs = pa.array([gram[at[i] : at[i + 1]].tobytes() for i in own], pa.binary())
                yield pa.record_batch([*(part.column(c) for c in placed), blobs], names=[*placed, "grams"])

    with_sets = texts.mapInArrow(sets, ", ".join(f"{c} {dict(need.dtypes)[c]}" for c in placed) + ", grams binary")
    pair = lambda c1, b1, c2, b2, right: F.struct(c1.alias("c1"), b1.alias("b1"), c2.alias("c2"), b2.alias("b2"), F.lit(right).alias("right"))
    c, b = F.col("class"), F.col("block")
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), f)).otherwise(F.array().cast("array<struct<c1:int,b1:int,c2:int,b2:int,right:boolean>>"))
    within = upto(F.col("same"), lambda j: F.struct(c.alias("c1"), F.least(b, j).alias("b1"), c.alias("c2"), F.greatest(b, j).alias("b2"), (b > j).alias("right")))
    lower = upto(F.col("below"), lambda j: pair(c - 1, j, c, b, True))
    upper = upto(F.col("above"), lambda j: pair(c, b, c + 1, j, False))
    dealt = with_sets.select("node", "label", "size", "grams", F.explode(F.concat(within, lower, upper)).alias("p")).select("node", "label", "size", "grams", "p.*")

    def link(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        size = table["size"].to_numpy()
        right = table["right"].to_numpy(zero_copy_only=False)
        grams = [np.frombuffer(x.as_py(), np.uint64) for x in table["grams"]]
        both = (table["c1"][0], table["b1"][0]) == (table["c2"][0], table["b2"][0])
        m = len(node)
        row, flat = np.repeat(np.arange(m), size), np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        new = np.r_[True, flat[1:] != flat[:-1]]
        column = np.cumsum(new) - 1
        shared = np.bincount(column) > 1
        keep = shared[column]
        row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
        overlap = np.zeros((m, m), np.float64)
        width = 1 << 14
        for lo in range(0, int(shared.sum()), width):  # each list of the block is scanned once
            a, b = np.searchsorted(column, [lo, lo + width])
            at = np.zeros((m, width), np.float32)
            at[row[a:b], column[a:b] - lo] = 1
            overlap += at @ at.T
        linked = 100 * overlap >= percent * (size[:, None] + size[None, :] - overlap)
        linked &= np.tri(m, k=-1, dtype=bool).T
        if not both:
            linked &= right[:, None] != right[None, :]
        parent = list(range(m))

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for i, j in zip(*np.nonzero(linked)):
            if (x := top(int(i))) != (y := top(int(j))):
                parent[x] = y
                out.append((int(node[i]), int(node[j])))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    return dealt.groupBy("label", "c1", "b1", "c2", "b2").applyInArrow(link, "u long, v long")
