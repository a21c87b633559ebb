"""Memory of long texts, tables of chunks and samples of large languages."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cindergrid.llm import fingerprints, language_id, mixing, ngram_join, piece_tokens


def net():
    rng = random.Random(1)
    texts = [("".join(rng.choices(a, k=300)).encode(), x) for x, a in (("en", "aeiou th"), ("de", "äöü schn")) for _ in range(40)]
    return language_id.ByteNet.train([t for t, _ in texts], [x for _, x in texts], epochs=2)


def test_windows_in_blocks_change_nothing(monkeypatch):
    model = net()
    rng = np.random.default_rng(2)
    lengths = [1, 255, 256, 257, 5000, 3]
    raw, offsets = rng.integers(97, 123, sum(lengths)).astype(np.uint8), np.r_[0, np.cumsum(lengths)]
    tables = model.pair_tables()
    want = model.probabilities(raw, offsets, tables)
    for n in (1, 2, 7):
        monkeypatch.setattr(language_id, "AT_ONCE", n)
        assert np.allclose(model.probabilities(raw, offsets, tables), want, atol=1e-6)
    assert np.allclose(np.concatenate([model.probabilities(raw[a:b], np.array([0, b - a]), tables) for a, b in zip(offsets, offsets[1:])]), want, atol=1e-6)


def test_memory_of_a_long_text():
    model, raw = net(), np.frombuffer(b"the house " * 800_000, np.uint8)
    tables = model.pair_tables()
    tracemalloc.start()
    p = model.probabilities(raw, np.array([0, len(raw)]), tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert p.shape == (1, 2) and peak < 8 * len(raw) + (80 << 20)


def test_a_large_language_is_sampled(spark):
    many = spark.range(2_300_000).select(F.col("id").alias("doc_id"), F.lit("the house of the many").alias("text"), F.lit("en").alias("lang"))
    few = spark.createDataFrame([(-i, "das schöne haus", "de") for i in range(1, 4)], "doc_id long, text string, lang string")
    model = language_id.fit(many.union(few), F.lit(True), max_docs=8)
    assert model.languages == ["de", "en"]
    # one id and text on every row is one piece of text
    same = language_id.fit(many.withColumn("doc_id", F.lit(1).cast("long")).union(few), F.lit(True), max_docs=1 << 22)
    assert same.languages == ["de", "en"]


@pytest.mark.parametrize("ids,piece", [(50, 300), (4_000_000, 1 << 20)])
def test_texts_without_spaces(spark, monkeypatch, ids, piece):
    monkeypatch.setattr(piece_tokens, "IDS", ids)
    monkeypatch.setattr(piece_tokens, "SLICE", piece)
    import sentencepiece

    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n)) for n in (1000, 1, 400, 1000)] + ["a b", None, "lang " * 500]
    table = piece_tokens.Chunks(model)
    for t in texts[:4]:
        line, begin = piece_tokens.spaced(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        if len(table.ids) > ids:
            table.clear()
        before = len(table.ids)
        table.look_up(line, begin[:-1], begin[1:])
        assert before <= ids and len(table.ids) <= before + len(line)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in piece_tokens.encode_pieces(df, model).collect():
        want = [sp.bos_id(), *sp.encode(texts[r.doc_id] or ""), sp.eos_id()]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()


def largest_share(df, by):
    """Rows of the largest group of columns `by`, over all rows."""
    counts = [r["count"] for r in df.groupBy(*by).count().collect()]
    return max(counts) / sum(counts)


def test_one_id_is_cut_by_its_texts(spark, monkeypatch):
    """A third of all rows with one id, a third with none: as many buckets as without, one ring through all rows."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"t{i}") for i in range(3000)]
    seen = []
    inner = fingerprints.in_bucket
    monkeypatch.setattr(fingerprints, "in_bucket", lambda r, cuts: seen.append(inner(r, cuts)) or seen[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.with_next(df, "doc_id", ["text"], rows_per_bucket=10).collect()
    assert largest_share(seen[-1], ["__b"]) < 0.01
    ids, after, at, ring = dict((t, i) for i, t in rows), {r.text: r["__next"].text for r in got}, "t1", []
    for _ in rows:
        ring.append(ids[at])
        at = after[at]
    turns = sum((a is None, a or 0) > (b is None, b or 0) and not (a is None and b is not None) for a, b in zip(ring, ring[1:]))
    assert at == "t1" and len(got) == len(after) == 3000 and turns <= 1
    known = [i for i in ring if i is not None]
    k = next((j for j in range(1, len(known)) if known[j] < known[j - 1]), 0)
    assert known[k:] + known[:k] == sorted(known)


def test_skewed_qualities_and_copies_spread(spark, monkeypatch):
    """Half of the rows of low quality: no bucket holds many. Copies of one row draw keys of their own, reruns agree, sums are right."""
    monkeypatch.setattr(mixing, "BUCKET", 20)
    docs = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    quality = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0.01).alias("quality"))
    runs = []
    for d in (docs, docs.repartition(5)):
        got = mixing.mix_sources(d, quality, keep=["doc_id", "source"])
        runs.append(sorted((r.doc_id or -1, r.taken) for r in got.collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 40_000
    assert sum(t for _, t in runs[0]) == 120_000 and {t for _, t in runs[0]} == {2, 4}
    # the copies without an id are taken a second time about as often as the others of their quality
    again = [t == 4 for i, t in runs[0] if i == -1]
    assert 0.5 < sum(again) / len(again) < 1.0


def test_copies_of_one_text_meet_once_a_task(spark, monkeypatch):
    """A third of all rows one text, a third without words: few signatures of it reach its key, the links are right."""
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(i if i % 7 else None, same if i % 3 == 0 else "" if i % 3 == 1 else f"{i} " * 3 + " ".join(f"v{i}x{j}" for j in range(30))) for i in range(1200)]
    rows += [(5000, same + " more"), (5001, "w0 " + " ".join(f"w{i}" for i in range(1, 60)) + " tail")]
    seen = []
    inner = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df: seen.append(inner(df)) or seen[-1])
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, keyed=True).collect()
    marks = next(t for t in seen if "bitmap" in t.columns).where("kind = 4")
    assert marks.groupBy("u").count().agg(F.max("count")).first()[0] <= 4
    least = min(i for i, t in rows if t == same and i is not None)
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.component_id == (least if text.startswith("w0 ") else r.doc_id) and (r.label is None) == (text == "")
