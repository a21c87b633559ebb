"""One-permutation MinHash fingerprints in DataFrame operations alone.

A text's lower-cased words give k-word shingles, fewer words one shingle of all. Each shingle is hashed once; the top bits
name one of BINS bins, each bin keeps its smallest hash. An empty bin takes the value of the first filled bin among those
that a hash function of its own proposes (optimal densification; each function reaches every bin, so it ends). The low BITS bits of
the bins, packed as hexadecimal, are the fingerprint. Likeness is the share of equal bins freed of chance agreement:
(share - 2**-BITS) / (1 - 2**-BITS), from 0 to 1. All of it happens within the row: no shuffle, nothing beside the text.

A null text counts as empty. A text without words has an empty fingerprint, which is like another empty one (1.0) and
unlike any other (0.0).
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS, BITS, K = 128, 8, 5
SHIFT = 64 - (BINS - 1).bit_length()


def densifying() -> Column:
    """(bin, step, start) of each bin: it tries bins (step * j + start) % BINS for j = 0, 1, ...; odd steps reach all bins."""
    rng = random.Random(5)
    return F.array(*(F.struct(F.lit(b).alias("bin"), F.lit(2 * rng.randrange(BINS // 2) + 1).alias("step"), F.lit(rng.randrange(BINS)).alias("start")) for b in range(BINS)))


def with_fingerprint(df: DataFrame, text: str, into: str, k: int = K) -> DataFrame:
    """df with a column `into`: the low bits of the bins, array<int>, empty for a text without words."""
    t = lambda x: f"__{into}_{x}"
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    out = df.withColumn(t("t"), trimmed)
    words = F.when(F.col(t("t")) == "", F.array().cast("array<string>")).otherwise(F.split(t("t"), r"[\x20\x09-\x0D]+"))
    out = out.withColumn(t("w"), F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size(t("w"))
    # hashes of 2, 4, ... neighbouring words, then the k-th: each pass joins a list with itself shifted
    width = 1
    shifted = lambda col, by: F.slice(col, by + 1, F.greatest(F.size(col) - by, F.lit(0)))
    pieces, col = [], t("w")
    while width <= k:
        if k & width:
            pieces.append((col, width))
        if width * 2 <= k:
            name = t(f"s{width * 2}")
            out = out.withColumn(name, F.zip_with(F.slice(col, 1, F.greatest(F.size(col) - width, F.lit(0))), shifted(F.col(col), width), lambda a, b: F.xxhash64(a, b)))
            col = name
        width *= 2
    pieces = pieces[::-1]
    span, at = F.col(pieces[0][0]), pieces[0][1]
    for name, width in pieces[1:]:
        left, right = span, shifted(F.col(name), at)
        span = F.zip_with(F.slice(left, 1, F.greatest(F.size(right), F.lit(0))) if at else left, right, lambda a, b: F.xxhash64(a, b))
        at += width
    grams = F.when(n >= k, span).when(n > 0, F.array(F.xxhash64(F.array_join(F.transform(t("w"), lambda x: x.cast("string")), " ")))).otherwise(F.array().cast("array<bigint>"))
    # a last possible hash for each bin stands for an empty one; each bin keeps its first value in order
    last = F.array(*(F.lit((b << SHIFT | (1 << SHIFT) - 1) - (b >= BINS // 2) * 2**64).cast("long") for b in range(BINS)))
    out = out.withColumn(t("g"), F.when(n > 0, F.sort_array(F.concat(grams, last))))
    bin_of = lambda h: F.shiftrightunsigned(h, SHIFT)
    out = out.withColumn(t("m"), F.filter(t("g"), lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col(t("g")), i - 1)))))
    low = lambda h: F.when(h.bitwiseAND(F.lit((1 << SHIFT) - 1)) != (1 << SHIFT) - 1, h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    # sorted as signed numbers the upper half of the bins comes first
    out = out.withColumn(t("f"), F.transform(F.concat(F.slice(t("m"), BINS // 2 + 1, BINS // 2), F.slice(t("m"), 1, BINS // 2)), low))
    filled = F.col(t("f"))
    tried = lambda d, j: F.get(filled, F.pmod(d["step"] * j + d["start"], F.lit(BINS)))
    rest = lambda d: F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: tried(d, j)), lambda x: x.isNotNull()), F.lit(0))
    sparse = F.transform(densifying(), lambda d: F.coalesce(F.get(filled, d["bin"]), *(tried(d, F.lit(j)) for j in range(12)), rest(d)))
    bins = F.when(n == 0, F.array().cast("array<int>")).when(F.exists(filled, lambda x: x.isNull()), sparse).otherwise(filled)
    out = out.withColumn(into, bins)
    return out.drop(*(c for c in out.columns if c.startswith(f"__{into}_")))


def packed(bins: Column) -> Column:
    """The bins' low bits as hexadecimal digits."""
    return F.array_join(F.transform(bins, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / float(BINS)
    freed = F.greatest(F.lit(0.0), (equal - 2.0**-BITS) / (1 - 2.0**-BITS))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(freed)


def in_bucket(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """rows with __first, whether __at is the last cut that it reaches, and __b, that cut's place, found by binary search."""
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    table = F.from_json(F.lit(json.dumps([{"k": k, "t": t} for k, t in cuts])), "array<struct<k:bigint,t:bigint>>")
    upto = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(table, at + step - 1) <= F.col("__at")), at + step).otherwise(at))
    rows = rows.withColumn("__b", F.greatest(upto - 1, F.lit(0)))
    return rows.withColumn("__first", F.get(table, F.col("__b")) == F.col("__at"))


def with_next(df: DataFrame, order: str, carried: list[str], rows_per_bucket: int = 250, buckets: int = 20_000) -> DataFrame:
    """df with __next, a struct of the carried columns of the next row in ascending order; after the last comes the first.

    Rows are cut into buckets at quantiles of order, of about rows_per_bucket rows (more only beyond `buckets` of them); the
    first row of each bucket also goes to the end of the bucket before, so that each bucket finds its pairs alone. Beyond
    `buckets` a bucket's rows are sorted on disk. A number that more rows share than four buckets and a thousandth of all hold
    is cut further, at equal steps of the hash of the first carried column, by which its rows then follow each other; nulls
    come first and count as one number. Other equal keys follow each other by the carried columns. Only rows equal in both
    order and the first carried column stay in one bucket, however many they are.
    """
    key = F.coalesce(F.col(order).cast("long"), F.lit(-(2**63)))
    keys = df.select(key.alias("k"))
    n = keys.count()
    parts = min(max(1, n // rows_per_bucket), buckets)
    often = {r.k: r["count"] for r in keys.groupBy("k").count().where(F.col("count") > max(4 * rows_per_bucket, n // 1000)).collect()}  # fewer than 1000
    found = keys.agg(F.percentile_approx("k", [i / parts for i in range(parts)], max(10_000, 4 * parts)).alias("q"), F.min("k").alias("low")).first()
    cuts = {(k, -(2**63)) for k in (found.q or []) + [found.low or 0]}
    for k, count in often.items():
        own = max(1, parts * count // n)
        cuts |= {(k, -(2**63) + i * 2**64 // own) for i in range(own)} | {(k + 1, -(2**63))} - {(2**63, -(2**63))}
    tie = F.when(key.isin(list(often)), F.xxhash64(carried[0])).otherwise(F.lit(-(2**63))) if often else F.lit(-(2**63))
    at = F.struct(key.alias("k"), tie.cast("long").alias("t"))
    # quantiles of long numbers are rounded and steps may be empty: each bucket is cut at the least key that it really has
    cuts = sorted(tuple(r.low) for r in in_bucket(df.select(at.alias("__at")), sorted(cuts)).groupBy("__b").agg(F.min("__at").alias("low")).collect()) or [(0, 0)]
    rows = in_bucket(df.withColumn("__at", at), cuts)
    own = F.struct(F.col("__b").alias("b"), F.lit(0).alias("wrap"), F.lit(False).alias("copy"))
    before = F.struct(F.when(F.col("__b") > 0, F.col("__b") - 1).otherwise(len(cuts) - 1).alias("b"), (F.col("__b") == 0).cast("int").alias("wrap"), F.lit(True).alias("copy"))
    rows = rows.withColumn("__to", F.explode(F.when(F.col("__first"), F.array(own, before)).otherwise(F.array(own))))
    w = W.partitionBy("__to.b").orderBy("__to.wrap", "__at", *carried)
    rows = rows.withColumn("__next", F.lead(F.struct(*carried)).over(w))
    return rows.where("not __to.copy").drop("__at", "__b", "__first", "__to")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (second half replaced by the next text's start), and their likeness."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "bins"), "doc_id", ["text", "bins"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "bins", F.col("__next.bins").alias("next_bins"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("__next.text", F.lit(1), half)).alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_bins")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"), likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))
