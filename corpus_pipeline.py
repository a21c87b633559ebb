"""A corpus from documents to token ids: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindergrid.llm import language_id, mixing, ngram_join, piece_tokens, queries, toxicity
from cindergrid.llm.common import crc_mod, discard, table, written

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: list[str] | None = None) -> DataFrame:
    """Drops documents of no language, or of none of `languages` if given, and sets lang of the others to the predicted one.

    No language: null texts, texts without a letter, and texts predicted to be like those that the table itself labels 'und'.
    A low likelihood rejects nothing: windows that disagree lower the average of texts whose prediction is right.
    Where no language could be learned, or a single one, there is nothing to tell apart: the letters alone decide and
    lang stays. Null ids, repeated rows and other columns make no difference; an empty table gives none.
    """
    net = language_id.fit(docs.select("doc_id", "text", "lang"), crc_mod(F.col("doc_id"), 4) != 2)
    if net is None or len(net.languages) < 2:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*DOCUMENT)
    found = language_id.predict(docs.select(*DOCUMENT, F.col("text").alias("__t")), net, "__t").where(F.col("lang_pred") != language_id.UND)
    if languages is not None:
        found = found.where(F.col("lang_pred").isin(languages))
    return found.withColumn("lang", F.col("lang_pred")).select(*DOCUMENT)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored toxic (0.5 or more) by a model fitted on the labelled ones among them.

    A model that scores all texts alike, as without toxic or without harmless labelled texts, drops none. Null and empty
    texts have no toxic passage and stay; null ids are scored like others; repeated rows share their fate.
    """
    model = toxicity.Toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    if not model.separates:
        return docs.select(*DOCUMENT)
    found = model.score(docs.select(*DOCUMENT, F.col("text").alias("__t")), "__t")
    return found.where(F.col("toxicity") < 0.5).select(*DOCUMENT)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 on five-word shingles the smallest doc_id stays, once.

    Documents without an id belong to no group and stay. Where an id is repeated, each of its texts counts as a document:
    a text that is linked with no other stays, and of equal ids in a group the text with the smallest hash. Of rows
    equal in id and text the one with the smallest lang stays, then the smallest source (null first).
    """
    groups = ngram_join.jaccard_components(docs, n=5, percent=80, keyed=True).where("doc_id is not null")
    alone = F.col("label").isNull()
    first = groups.groupBy("label", F.when(alone, F.col("doc_id")), F.when(alone, F.col("text_key"))).agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    named = docs.where("doc_id is not null").withColumn("text_key", F.xxhash64("text"))
    kept = named.join(first, ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("row"))
    return kept.select("doc_id", "row.*").select(*DOCUMENT).union(docs.where("doc_id is null").select(*DOCUMENT))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and selects documents so that sources meet their targets; the last one that a source takes stays whole.

    Rows without texts are mixed; then each distinct document meets its number of copies, which moves its text once.
    Documents without words, null texts among them, are never taken; null ids and sources are ids and a source like others;
    repeated rows add up their copies.
    """
    docs = docs.select(*DOCUMENT)
    same = F.xxhash64(F.col("doc_id").isNull(), *DOCUMENT[1:])
    keyed = docs.withColumn("__id", F.coalesce("doc_id", F.lit(0))).withColumn("__same", same)
    mixed = mixing.mix_sources(keyed, queries.label_quality(table(spark, sf_dir, "labels")), keep=["__id", "__same"])
    copies = mixed.where("taken > 0").groupBy("__id", "__same").agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("__copies"))
    found = keyed.dropDuplicates(["__id", "__same"]).join(copies, ["__id", "__same"])
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*DOCUMENT)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str | None = None) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, ids) of every document; a null text counts as empty."""
    if model is None:
        import public_tokenizers

        model = str(public_tokenizers.path("piece_bpe_32k.model"))
    return piece_tokens.encode_pieces(docs.select("doc_id", "lang", "source", "text"), model, with_ids=True)


STAGES = [("language ID", language_stage), ("toxicity", toxicity_stage), ("n-gram Jaccard join", near_duplicate_stage), ("mixing sources to target weights", mixing_stage), ("SentencePiece encoding and decoding", token_stage)]

#: Trained models and exact hashes of library tokens: not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
