"""Mixing sources to target weights, in DataFrame operations alone.

Sources in code-point order, null last, take the weights of a repeating cycle. They share `percent` of all words by weight;
no target passes `cap` times its source's words, and what it would have more is shared again by weight among the others.
With the sources sorted by cap / weight this is one level: target = min(cap * words, level * weight).

The sources' table, a row for each source, is worked on in one task: fit for tens of millions of sources, not for more.
Texts are only counted and hashed; what is joined, sorted and summed are narrow rows, written once to the shared folder.

Within a source documents follow ascending Efraimidis-Spirakis keys, -ln(u) / quality, u a hash of the seed, id and text.
A target of whole rounds takes every document that often; the rest is a prefix of that order, and the last document of
it counts with the words that still fit, so a source's words come to the whole part of its target. The order is never
sorted in one place: keys are cut at equal steps of their logarithm, only rows of one such bucket are sorted together, and the
buckets' sums are added up per source. Exponential keys of any rates, mixed in any shares, hold at most ln(2) / (e * steps) of
their rows within one of `steps` parts of an octave: about BUCKET rows, and a 16,000th of the source's rows beyond MOST_STEPS. All
octaves together have some 60 * MOST_STEPS buckets at most, so their sums are few whatever the source's size.

A null text has no words; documents without words are never taken. Quality is 1 where it is null, no number or not above zero.
Null ids have no quality and are dealt by their hash. Repeated rows count each on its own: where more than BUCKET rows and a
thousandth of all are alike in id and text, each copy draws a key of its own by its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cindergrid.llm.common import WORD, written

BUCKET = 250
MOST_STEPS = 4096


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), percent: int = 150, cap: int = 2) -> DataFrame:
    """(source, source_size, target and the rest per source) of rows (source, size); the table has a row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    one = F.lit(0)
    place = F.row_number().over(W.partitionBy(one).orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), F.pmod(place - 1, F.lit(len(cycle))) + 1)
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap)).withColumn("at", F.col("most") / F.col("weight"))
    order = W.partitionBy(one).orderBy("at", "source")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy(one)) * (percent / 100) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # the first source, by cap / weight, that the level doesn't reach sets the level for all
    found = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(W.partitionBy(one))["level"]
    per = per.withColumn("target", F.least("most", F.coalesce(found, F.lit(float("inf"))) * F.col("weight")))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    return per.select("source", "source_size", "n", "target", rounds.alias("rounds"), (F.floor("target").cast("long") - rounds * F.col("source_size")).alias("rest"))


def with_own_hashes(rows: DataFrame, most: int = BUCKET) -> DataFrame:
    """The written rows, where copies of a hash that more than `most` rows and a thousandth of all have get hashes of their own.

    Copies are numbered file by file and the files' counts added up, so none of this meets in one task. Equal rows may change
    places, which no result shows.
    """
    most = max(most, rows.count() // 1000)
    often = [r["hash"] for r in rows.groupBy("hash").count().where(F.col("count") > most).select("hash").collect()]  # fewer than 1000
    if not often:
        return rows
    columns = rows.columns
    alike = rows.where(F.col("hash").isin(often)).withColumn("file", F.input_file_name()).withColumn("hash", F.xxhash64("hash", "row"))
    per = alike.groupBy("hash", "file").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("hash").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(W.partitionBy("hash", "file").orderBy("row"))
    alike = alike.withColumn("number", number).join(F.broadcast(per.withColumn("before", before).drop("count")), ["hash", "file"])
    alike = alike.withColumn("hash", F.xxhash64("hash", F.col("number") + F.col("before")))
    return rows.where(~F.col("hash").isin(often)).union(alike.select(columns))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, *, cycle: tuple[int, ...] = (3, 1, 2), percent: int = 150, cap: int = 2, seed: int = 1, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all but the text unless named) with size, source_size, target and taken, in words.

    quality has a row (doc_id, quality) for each id that has one.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    rows = docs.select(
        F.struct(*(F.col(c) for c in keep)).alias("row"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(doc_id).alias("id"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("hash"),
    )
    if quality is None:
        rows = rows.withColumn("quality", F.lit(1.0))
    else:
        deal = lambda c, salt: F.struct(F.col(c).alias("id"), salt.alias("salt"))
        known = quality.where(F.col("doc_id").isNotNull()).select(deal("doc_id", F.lit(0).cast("long")).alias("known"), F.col("quality").cast("double").alias("quality"))
        rows = rows.withColumn("id", deal("id", F.when(F.col("id").isNull(), F.col("hash")).otherwise(F.lit(0).cast("long"))))
        rows = rows.join(known, rows["id"] == known["known"], "left").drop("known")
    good = (F.col("quality") > 0) & ~F.isnan("quality")
    rows = with_own_hashes(written(rows.withColumn("quality", F.when(good, F.col("quality")).otherwise(1.0)).drop("id")))
    targets = source_targets(rows.select("source", "size"), cycle, percent, cap).withColumnRenamed("source", "own")
    u = (F.shiftrightunsigned("hash", 11) + 0.5) / 2.0**53
    rows = rows.withColumn("key", -F.log(u) / F.col("quality")).join(targets, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    steps = F.least(F.lit(MOST_STEPS), F.ceil(F.col("n") / (4 * BUCKET)))
    rows = rows.withColumn("bucket", F.floor(steps * F.coalesce(F.log2("key"), F.lit(-2000.0))))
    within = W.partitionBy("source", "bucket").orderBy("key", "hash", "row").rowsBetween(W.unboundedPreceding, 0)
    upto = rows.withColumn("upto", F.sum("size").over(within))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    offset = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(offset, F.lit(0)).alias("before"))
    upto = upto.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    fits = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - F.col("upto") + F.col("size")))
    made = ["size", "source_size", "target", "taken"]
    return upto.withColumn("taken", F.col("rounds") * F.col("size") + fits).select(*(F.col(f"row.`{c}`").alias(c) for c in keep if c not in made), *made)
