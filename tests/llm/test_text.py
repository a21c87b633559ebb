import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cindergrid.llm import chat_format, exact_topk, fingerprints, kneser_ney, language_id, mixing, ngram_join, piece_tokens, queries, toxicity, url_filters
from cindergrid.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}).encode())


@pytest.fixture(scope="module")
def odd():
    """Null, empty, blank, very long, repeated and one-word texts, null ids and sources."""
    rng = random.Random(1)
    base = [rng.choice("the of an idiot schön été Über x y z".split()) + str(rng.randrange(4)) for _ in range(60)]
    rows = [(i, " ".join(base[: 50 + i % 10] + [f"w{i % 3}"]), ("en", "de")[i % 2], "s" + str(i % 3)) for i in range(24)]
    rows += [(30, None, "en", "s0"), (31, "", None, None), (32, " \t\n", "de", "s1"), (33, "one", "en", None), (34, "a b c", "en", "s1"), (35, "a b c", "en", "s1"), (36, "lang " * 20000, "en", "s2"), (None, "no id here at all", "en", "s1"), (34, "a b c", "en", "s1"), (38, "▁x  ▁ y ", "en", "s2")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (12, 11), (5, 5)], "u long, v long")
    assert {r.node: r.label for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10}
    assert connected_components(e.limit(0)).count() == 0


@pytest.mark.parametrize("order,sizes", [(2, {}), (3, {}), (2, {"shard_tokens": 500, "least_shards": 3}), (3, {"shard_tokens": 500, "least_shards": 3}), (3, {"shard_tokens": 40, "least_shards": 2})])
def test_kneser_ney(spark, odd, order, sizes):
    """Against dictionaries; small shards make words and pairs hot."""
    docs = spark.createDataFrame(odd, SCHEMA).withColumns({"score": F.lit("clash"), "k0": F.lit(1), "row": F.lit(2)})
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0
    got = kneser_ney.perplexity_table(docs, learn, order=order, **sizes).collect()
    lines = [split(r[1]) for r in odd if (r[0] or 0) % 2 == 0]
    counts = {order: collections.Counter(tuple(s[i : i + order]) for w in lines for s in [["<s>"] * (order - 1) + w + ["</s>"]] for i in range(len(w) + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter()
        for g, c in counts[n + 1].items():
            counts[n][g[1:]] += c if g[1] == "<s>" else 1
    cut = {n: kneser_ney.discount([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]) for n, c in counts.items()}
    single = collections.Counter(w for x in lines for w in [*x, "</s>"])
    types, total = len(single), sum(single.values())
    after = collections.defaultdict(list)
    for n, c in counts.items():
        for g, k in c.items():
            after[g[:-1]].append(k)

    @functools.cache
    def p(g):
        n = len(g)
        low = p(g[1:]) if n > 1 else 1 / (types + 1)
        own = after.get(g[:-1])
        if not own:
            return low
        d = (0, *cut[n])
        c = counts[n].get(g, 0)
        return (c - d[min(c, 3)]) / sum(own) + sum(d[min(c, 3)] for c in own) / sum(own) * low

    want = []
    for r in odd:
        w = [*split(r[1]), "</s>"]
        s = ["<s>"] * (order - 1) + w
        want.append((r[0], len(w), sum(x in single for x in w), total, sum(math.log10((single[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w), sum(math.log10(p(tuple(s[i : i + order]))) for i in range(len(w)))))
    key = lambda r: (r[0] or -1, *r[1:])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[4:], b[4:]))


def test_kneser_ney_without_rows(spark, odd):
    docs = spark.createDataFrame(odd, SCHEMA)
    none = kneser_ney.perplexity_table(docs, F.lit(False)).first()
    assert none.train_tokens == 0 and math.isfinite(none.score)
    assert kneser_ney.perplexity_table(docs.limit(0), F.lit(True)).count() == 0


def test_lm_score_uses_trigrams(spark, tmp_path):
    # with equal word pairs, only three words tell the texts apart
    texts = ["a b c", "d b e"] * 10 + ["a b c", "a b e"]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1][:20] + [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in zip(ids, texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_lm_score(spark, str(tmp_path)).collect()}
    seen, other = got[ids[-2]], got[ids[-1]]
    assert seen.held_out and other.held_out and seen.score - other.score > 0.5


def test_packed_columns_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 300, 70000):
        columns = [rng.integers(0, top, n) for top in (1, 2, 300, 1 << 22, 1 << 62)] + [rng.integers(0, 2**64 - 1, n, dtype=np.uint64), rng.random(n)]
        back = kneser_ney.unpack(kneser_ney.pack(*columns), len(columns))
        assert all((a.view(np.int64) == b).all() for a, b in zip(columns, back))


@pytest.mark.parametrize("n", [0, 1, 31, 40_000])
def test_hash_tables(n):
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
    count = rng.integers(1, 4, len(key))
    asked = np.r_[key, rng.integers(0, 2**64 - 1, 1000, dtype=np.uint64)]
    assert (kneser_ney.counts_in(kneser_ney.count_table(key, count), asked) == np.r_[count, np.zeros(1000)]).all()
    sums = np.stack([count + 1, count, count - 1, count * 300])
    sums[:, ::2] = [[1], [1], [0], [0]]
    assert (kneser_ney.sums_in(kneser_ney.sums_table(key, sums), asked) == np.c_[sums, np.zeros((4, 1000))]).all()


def test_hashes_are_looked_up_in_ascending_order(monkeypatch):
    rng = np.random.default_rng(3)
    key = rng.integers(0, 2**63, 5000, np.uint64) * np.uint64(2)
    count, asked = rng.integers(1, 4, 5000), rng.permutation(np.r_[key, key, key + np.uint64(1 << 30)])
    sums = np.stack([count, count == 1, count == 2, count > 2]).astype(np.int64)
    counts, contexts = kneser_ney.count_table(key, count), kneser_ney.sums_table(key, sums)
    real, seen = kneser_ney.found_in, []
    monkeypatch.setattr(kneser_ney, "found_in", lambda arrays, key: seen.append(key) or real(arrays, key))
    known = dict(zip(key.tolist(), count.tolist()))
    want = np.array([known.get(k, 0) for k in asked.tolist()])
    assert (kneser_ney.counts_in(counts, asked) == want).all()
    assert (kneser_ney.sums_in(contexts, asked) == np.stack([want, want == 1, want == 2, want > 2])).all()
    assert len(seen) == 4 and all((k[1:] >= k[:-1]).all() for k in seen)


@pytest.mark.parametrize("bits", [(3, 17, 17, 17), (40, 30, 20, 25, 12), (64, 1), (0, 5, 0), (63, 63, 63)])
def test_sorter_against_lexsort(bits):
    rng = np.random.default_rng(5)
    columns = [rng.integers(0, 2**b, 40, np.uint64)[rng.integers(0, 40, 3000)] if b else np.zeros(3000, np.uint64) for b in bits]
    order, want = kneser_ney.sorter(*columns), np.lexsort(columns[::-1])
    assert all((c[order] == c[want]).all() for c in columns)
    at = kneser_ney.runs(*(c[want] for c in columns))
    assert (kneser_ney.settled(order, np.diff(np.r_[at, 3000])) == want).all()
    assert len(kneser_ney.sorter(*(c[:0] for c in columns))) == 0


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 80)])
def test_jaccard_components(spark, odd, n, percent):
    rng = random.Random(7)
    rows = list(odd)
    for g in range(12):  # groups around every boundary size, with one to three words changed
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(4 + 4 * g)]
        for c in range(6):
            w = list(base)
            for _ in range(c % 4):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            if c == 5:
                w.append("more")
            rows.append((1000 + 10 * g + c, " ".join(w), "en", "s", 0))
    sets = {}
    for r in rows:
        if r[0] is not None:
            w = split(r[1])
            sets[r[0]] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), n, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id))
        if r.doc_id is not None:
            assert r.n_shingles == len(sets[r.doc_id])
    assert ngram_join.jaccard_components(spark.createDataFrame([], SCHEMA), n, percent).count() == 0


def test_segments_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 14)
        place = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        gain = [rng.choice([0.5, 1, 2]) for _ in place]
        score = [-1.0] * n
        for at, g in zip(place, gain):
            score[at] = g
        want, parts = [], [(0, n)]
        while parts:  # the best segment, then the same left and right of it
            a, b = parts.pop()
            best = max(((sum(score[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] > 0:
                want.append(best[0])
                parts += [(a, best[3]), (best[4], b)]
        assert sorted(s for _, _, s in toxicity.maximal_segments(place, gain, 1.0)) == sorted(want)


def test_toxicity(spark, odd):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(50)]
    docs = [(i, " ".join(rng.choices(words, k=40) + (rng.choices(["vile", "nasty", "foul"], k=4) if i % 5 == 0 else []))) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(None, 1, 1), (5, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.Toxicity.fit(table, labels, F.lit(True))
    got = {r.doc_id: r for r in model.score(table).collect()}
    assert all((got[i].toxicity >= 0.5) == (i % 5 == 0) for i in range(300, 400))
    assert all(got[i].passages for i in range(300, 400, 5))
    assert all(0 <= r.toxicity <= 1 for r in model.score(spark.createDataFrame(odd, SCHEMA)).collect())
    assert toxicity.Toxicity.fit(table, labels.limit(0), F.lit(True)).score(table).where("toxicity >= 0.5").count() == 0


def test_toxicity_fit_does_not_depend_on_the_order_of_copies(spark):
    """Labelled copies of a text under many ids give the same model however the rows are dealt."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(50)]
    texts = [" ".join(rng.choices(words, k=30) + (rng.choices(["vile", "nasty", "foul", "base"], k=4) if i % 4 == 0 else [])) for i in range(200)]
    docs = [(1000 * j + i, x) for i, x in enumerate(texts) for j in range(6)]
    labels = spark.createDataFrame([(i, int(i % 1000 % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    models = []
    for n, rows in ((1, docs), (7, docs[::-1]), (5, rng.sample(docs, len(docs)))):
        m = toxicity.Toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels, F.lit(True))
        models.append((m.words.tolist(), m.gains.tolist(), m.rate, m.k, m.slope, m.offset))
    assert models[0] == models[1] == models[2] and models[0][0]


def test_topk(spark):
    rng = np.random.default_rng(0)
    v = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 256]) for i in range(230)]
    v += [(230, None), (231, [None] * 6), (232, [float("nan")] * 6), (233, [1.0]), (None, v[0][1]), (7, v[7][1]), (240, [2.0**40] * 6), (250, [])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = {}
    for r in exact_topk.exact_topk(df, F.col("vec_id") % 10 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in v if i is not None and e is not None and all(x is not None and x == x for x in e)]
    for q, e in fine:
        if q % 10 == 0:
            own = sorted((-min(sum(a * b for a, b in zip(e, f)), 2**63 - 1), i) for i, f in fine if i != q and len(f) == len(e))[:5]
            assert sorted(got.get(q, [])) == [(k, i, -s) for k, (s, i) in enumerate(own, 1)]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x?q", "http://www.example.com/en/", "http://a.www.example.com/en/1#t", "http://x.net/es/", "http://net/fr/a", "http://x.net/de/", "http://ab.com", "http://example.com/en", "x://a?://b"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2 + [(None, urls[3])], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    want = sorted(map(repr, con.execute(queries.OP5_SQL.replace("FROM pages", "FROM (SELECT CAST(page_id AS BIGINT) AS page_id, url FROM pages)")).fetchall()))
    for most in (100, 0):  # broadcast and salted shuffle
        got = url_filters.judge_urls(df, rules, broadcast_rules=most).drop("matched")
        assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert url_filters.judge_urls(df, rules.limit(0)).where("rule is not null").count() == 0


def test_fingerprints(spark, odd):
    got = fingerprints.edited_fingerprints(spark.createDataFrame(odd, SCHEMA)).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert by[34].fingerprint == by[35].fingerprint != "" == by[30].fingerprint == by[32].fingerprint
    order = sorted((r for r in set(odd) if r[0] not in (None, 34)), key=lambda r: r[0])
    for a, b in zip(order, order[1:]):
        if 33 not in (a[0], b[0]) and (a[0], b[0]) != (33, 35):
            t, n = a[1] or "", b[1] or ""
            edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            assert by[a[0]].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_empty_bins_against_brute_force(spark):
    """Each bin has the low bits of its smallest shingle hash; an empty one those of the first filled bin that it tries."""
    rng = random.Random(8)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(n)) for n in (5, 6, 9, 40, 130, 400, 3000)] + ["same " * 50]
    rows = [(i, j, *t.split()[j : j + 5]) for i, t in enumerate(texts) for j in range(len(t.split()) - 4)]
    h = [F.xxhash64(c) for c in "abcde"]
    grams = spark.createDataFrame(rows, "i int, j int, a string, b string, c string, d string, e string").select("i", F.xxhash64(F.xxhash64(F.xxhash64(h[0], h[1]), F.xxhash64(h[2], h[3])), h[4]).alias("h")).collect()
    steps = [r for r in spark.range(1).select(F.explode(fingerprints.densifying()).alias("d")).select("d.*").collect()]
    got = fingerprints.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "f").collect()
    for i, _, bins in got:
        least = {}
        for g in grams:
            if g.i == i:
                u = g.h % 2**64
                b = u >> fingerprints.SHIFT
                least[b] = min(u, least.get(b, u))
        want = []
        for d in steps:
            tries = [d.bin] + [(d.step * j + d.start) % fingerprints.BINS for j in range(fingerprints.BINS)]
            want.append(least[next(b for b in tries if b in least)] % 2**fingerprints.BITS)
        assert bins == want


def test_likeness_is_unbiased(spark):
    rng = random.Random(4)
    rows, want = [], []
    for i in range(40):
        w = [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([20, 60, 2000]))]
        cut = rng.randrange(len(w))
        v = w[:cut] + [f"y{rng.randrange(10**6)}" for _ in range(len(w) - cut)]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v))
        rows.append((i, " ".join(w), " ".join(v)))
        want.append(len(a & b) / len(a | b))
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(spark.createDataFrame(rows, "i int, a string, b string"), "a", "fa"), "b", "fb")
    got = [r[0] for r in df.orderBy("i").select(fingerprints.likeness(F.col("fa"), F.col("fb"))).collect()]
    assert abs(np.mean(np.array(got) - want)) < 0.04 and np.std(np.array(got) - want) < 0.12


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", None), (4, 1, None, "x"), (None, 0, "user", "a"), (5, 0, "user", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.render_conversations(df).collect()}
    assert set(got) == {1, 4, 5} and got[1].copies == 2
    assert got[1].chat == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert chat_format.render_conversations(df.limit(0)).count() == 0


def test_mixing(spark, odd):
    docs = spark.createDataFrame(odd, SCHEMA)
    got = mixing.mix_sources(docs, keep=["doc_id", "source"]).collect()
    assert len(got) == len(odd) and sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs.repartition(3), keep=["doc_id", "source"]).collect()))
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        e = by.setdefault(r.source, [0, 0, r.target])
        e[0] += r.size
        e[1] += r.taken
    assert all(e[1] == int(e[2]) for e in by.values()) and all(e[2] <= 2 * e[0] for e in by.values())
    assert abs(sum(e[2] for e in by.values()) - 1.5 * sum(e[0] for e in by.values())) < 1e-6
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_language(spark, odd):
    rng = random.Random(5)
    letters = {"en": "thandere", "de": "schüßöei", "fr": "éèçouequ"}
    rows = [(i, " ".join("".join(rng.choices(letters[x], k=5)) for _ in range(rng.randrange(5, 200))), x) for i in range(240) for x in [("en", "de", "fr")[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(df, F.col("doc_id") < 180)
    got = language_id.predict(df, net).where("doc_id >= 180").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 57
    odd_got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(odd, SCHEMA), net).collect()}
    assert {odd_got[i].lang_pred for i in (30, 31, 32)} == {"und"} and odd_got[36].lang_pred != "und"
    assert {r.lang_pred for r in language_id.predict(df, language_id.fit(df, F.lit(False))).collect()} == {"und"}


def test_pieces(spark, odd):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r[1] for r in odd[:3] + odd[24:]] + ["  lead", "trail ", "trail   ", "a\x00b  \t c", "ｆｕｌｌ　width ﬁ", "🙂🙂 x", "<s> </s>", "line\n\n  next"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in piece_tokens.encode_pieces(df, path, with_ids=True).collect():
        ids = [sp.bos_id(), *sp.encode(texts[r.doc_id] or ""), sp.eos_id()]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert piece_tokens.encode_pieces(df.limit(0), path).count() == 0


@pytest.mark.parametrize("batch_rows", [7, 64, 10_000])
def test_long_lists_tie_what_chains_would(batch_rows):
    """Long lists connect the same sets as links between compatible neighbours do; hot n-grams connect all their sets."""
    rng = np.random.default_rng(3)
    rows = sorted({(kind, gram, cid % ngram_join.PARTS if kind == 1 else 0, 20 + cid % 9 + 60 * (cid % 2), cid) for kind, gram, n in ((0, 1, 90), (0, 2, 50), (1, 3, 200), (1, 4, 80)) for cid in map(int, rng.integers(1000 * gram, 1000 * gram + 900, n))})
    batches = [pa.record_batch([pa.array([r[0] for r in part], pa.int32()), *(pa.array([r[i] for r in part], pa.int64()) for i in (1, 3, 4)), pa.nulls(len(part), pa.binary())], names=ngram_join.NAMES) for part in (rows[i : i + batch_rows] for i in range(0, len(rows), batch_rows))]
    edges = [(u, v) for b in ngram_join.chains(80)(iter(batches)) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist())]
    want = [(a[4], b[4]) for a, b in zip(rows, rows[1:]) if a[:2] == b[:2] and (a[0] == 1 or 100 * a[3] >= 80 * b[3])]

    def parts(links):
        top = {}

        def find(x):
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        for u, v in links:
            top[find(u)] = find(v)
        found = {}
        for r in rows:
            found.setdefault(find(r[4]), set()).add(r[4])
        return sorted(map(sorted, found.values()))

    assert parts(edges) == parts(want)


@pytest.mark.parametrize("lang", [None, "en", "und"])
def test_language_stage_without_languages(spark, odd, lang):
    docs = spark.createDataFrame(odd, SCHEMA).withColumn("lang", F.lit(lang).cast("string"))
    got = corpus_pipeline.language_stage(spark, docs, "").collect()
    want = [r for r in odd if any(c.isalpha() for c in r[1] or "")]
    assert sorted((r.text, r.lang) for r in got) == sorted((r[1], lang) for r in want) if lang else sorted(r.text for r in got) == sorted(r[1] for r in want)


def test_language_stage_keeps_mixed_texts_and_chosen_languages(spark):
    """Texts half in each language have a low likelihood and stay; a list of languages keeps the predicted ones in it."""
    words = {"de": "der und nicht eine ist mit auf dem", "en": "the and not one is with on of"}
    one = lambda lang, i: " ".join(words[lang].split()[(i * j + j) % 8] for j in range(60))
    rows = [(i, one(("de", "en")[i % 2], i), ("de", "en")[i % 2], "s", 0) for i in range(120)]
    rows += [(500 + i, one("de", i) + " " + one("en", i), None, "s", 0) for i in range(10)] + [(600, "... 12 !", "en", "s", 0), (601, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_stage(spark, docs, "").collect()}
    assert set(got) == {r[0] for r in rows[:-2]} and all(got[i] == ("de", "en")[i % 2] for i in range(120))
    assert {i: x for i, x in got.items() if x == "de"} == {r.doc_id: r.lang for r in corpus_pipeline.language_stage(spark, docs, "", ["de"]).collect()}


@pytest.mark.parametrize("toxic", [1, 0, None])
def test_toxicity_stage_with_one_class(spark, odd, tmp_path, toxic):
    spark.createDataFrame([(r[0], 1, toxic) for r in odd], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.toxicity_stage(spark, spark.createDataFrame(odd, SCHEMA), str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, odd))


def test_near_duplicate_stage_with_repeated_ids(spark):
    text = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("b")), (1, text("b") + " more"), (2, text("a") + " more"), (1, text("c")), (1, text("c")), (3, text("d")), (3, text("b")), (4, "few words"), (4, "other words"), (5, "few words"), (6, None), (6, ""), (None, text("a"))]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], SCHEMA)
    got = sorted((r.doc_id or 0, r.text or "", r.text is None) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    kept = [g for g in got if g[1].startswith("b")]
    assert len(kept) == 1 and kept[0][0] == 1
    want = [(1, text("a")), (1, text("c")), (3, text("d")), (4, "few words"), (4, "other words"), (6, None), (6, ""), (None, text("a"))]
    assert [g for g in got if g not in kept] == sorted((i or 0, x or "", x is None) for i, x in want)


def test_mixing_against_brute_force(spark, odd):
    """Targets by sharing again and again; documents in the order of their keys."""
    rng = random.Random(9)
    rows = odd + [(100 + i, " ".join("w" for _ in range(rng.randrange(40))), "en", f"s{rng.choice([0, 1, 1, 1, 2, 4, 5])}", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    quality = spark.createDataFrame([(i, rng.choice([0.5, 2.0, 0.0])) for i in range(100, 300)], "doc_id long, quality double")
    keys = {}
    for r in docs.select("doc_id", "text", "source", F.xxhash64(F.lit(1), "doc_id", "text").alias("h")).collect():
        keys.setdefault((r.doc_id, r.text), r.h)
    good = {r.doc_id: r.quality for r in quality.collect() if r.quality > 0}
    names = sorted({r[3] for r in rows}, key=lambda x: (x is None, x))
    words = {x: sum(len(split(r[1])) for r in rows if r[3] == x) for x in names}
    weight = {x: (3, 1, 2)[i % 3] for i, x in enumerate(names)}
    left, target = set(names), {}
    while True:
        rest = 1.5 * sum(words.values()) - sum(target.values())
        share = {x: rest * weight[x] / sum(weight[y] for y in left) for x in left}
        over = {x for x in left if share[x] > 2 * words[x]}
        if not over:
            target |= share
            break
        target |= {x: 2.0 * words[x] for x in over}
        left -= over
    want = collections.Counter()
    for x in names:
        rounds, rest = (int(target[x] // words[x]) if words[x] else 0), 0
        rest = int(target[x]) - rounds * words[x]
        own = sorted((-math.log((((keys[r[0], r[1]] % 2**64) >> 11) + 0.5) / 2.0**53) / good.get(r[0], 1.0), keys[r[0], r[1]], i) for i, r in enumerate(rows) if r[3] == x)
        for _, _, i in own:
            size = len(split(rows[i][1]))
            fits = max(0, min(size, rest))
            rest -= fits
            want[rows[i][0], size, words[x], rounds * size + fits] += 1
    got = mixing.mix_sources(docs, quality, keep=["doc_id", "source"]).collect()
    assert all(math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9) for r in got)
    assert collections.Counter((r.doc_id, r["size"], r.source_size, r.taken) for r in got) == want


def test_network_against_a_naive_convolution(spark, odd):
    texts = ["kurz", "ä" * 400, "the quick brown fox " * 40, "x", "ich bin nicht hier und du auch nicht " * 9]
    net = language_id.ByteNet.train([t.encode() for t in texts], ["en", "de", "en", "fr", "de"], epochs=3)
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()
    for r in got:
        data = texts[r.doc_id].encode()
        line, total = data + bytes(8), np.zeros(len(net.languages))
        for a in range(0, len(data), language_id.WINDOW):
            size = min(language_id.WINDOW, len(data) - a)
            pooled = [max(sum(float(t[j][line[a + i + j], f]) for j in range(w)) for i in range(size)) for t, w in zip(net.tables, language_id.WIDTHS) for f in range(language_id.FILTERS)]
            logit = np.maximum(np.array(pooled) + net.bias, 0) @ net.weights + net.offset
            p = np.exp(logit - logit.max())
            total += size * p / p.sum()
        total /= len(data)
        assert r.lang_pred == net.languages[int(total.argmax())] and abs(r.score - total.max()) < 1e-4


def test_toxicity_numbers_against_brute_force(spark):
    """Log-odds, lambda and K from plain counts of the same texts."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([f"id{i}", *rng.choices(vocabulary, k=60), *(rng.choices(["vile", "nasty"], k=3) if i % 4 == 0 else rng.choices(["vile", "fine"], [1, 30], k=2))])) for i in range(600)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.Toxicity.fit(table, labels, F.lit(True))
    part = {r.doc_id: r.p for r in table.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)).alias("p")).collect()}
    fit = [(set(t.split()), i % 4 == 0) for i, t in docs if part[i]]
    bad, good = sum(b for _, b in fit), sum(not b for _, b in fit)
    base, gains = bad / (bad + good), {}
    for w in {w for x, _ in fit for w in x}:
        a, b = sum(w in x for x, y in fit if y), sum(w in x for x, y in fit if not y)
        pa_, pb = a + 5 * base, b + 5 * (1 - base)
        gain = math.log(pa_ / pb) - math.log(base / (1 - base)) - 1.64 * math.sqrt(1 / pa_ + 1 / pb)
        if a > 1 and gain >= 1:
            gains[w] = gain
    assert gains and len(gains) == len(model.words) and np.allclose(sorted(gains.values()), sorted(model.gains))
    harmless = [t.split() for i, t in docs if not part[i] and i % 4]
    tokens = sum(map(len, harmless))
    seen = [gains[w] for t in harmless for w in t if w in gains]
    middle = lambda g: (int(g / toxicity.STEP) + 0.5) * toxicity.STEP
    moment = lambda seen, x: sum(math.exp(x * middle(g)) for g in seen) / tokens + (1 - len(seen) / tokens) * math.exp(-x * model.drift) - 1
    assert model.rate == 1.0 and moment(seen, 1.0) < 0  # lambda is 1 at most
    often, count = seen * 16, np.zeros(toxicity.BINS)
    for g in often:
        count[int(g / toxicity.STEP)] += 1
    rate, _ = toxicity.extreme_values(count, count, tokens, model.drift)
    assert 0 < rate < 1 and abs(moment(often, rate)) < 1e-6
    scores = [x for t in harmless for _, _, x in toxicity.maximal_segments([i for i, w in enumerate(t) if w in gains], [gains[w] for w in t if w in gains], model.drift)]
    tails = [(v, sum(int(x / toxicity.STEP) >= b for x in scores)) for b, v in enumerate(np.arange(toxicity.BINS) * toxicity.STEP)]
    assert abs(model.k - np.median([n / tokens * math.exp(model.rate * v) for v, n in tails if n >= 5])) < 1e-9


def test_edited_texts_wrap_and_their_likeness(spark):
    rng = random.Random(3)
    texts = [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.choice([0, 3, 40, 400]))) + "é" * (i % 2) for i in range(30)]
    ids = rng.sample(range(10_000), 30)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    order = sorted(zip(ids, texts))

    def likeness(a, b):
        if not a or not b:
            return float(a == b)
        share = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, len(a), 2)) / (len(a) // 2)
        return max(0.0, (share - 2**-8) / (1 - 2**-8))

    for (i, t), (j, n) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert math.isclose(got[i].near_edited, likeness(got[i].fingerprint, got[i].edited_fingerprint)) and math.isclose(got[i].near_next, likeness(got[i].fingerprint, got[j].fingerprint))


def test_chat_ties_long_conversations_and_other_columns(spark):
    turns = [(1, 0, "user", t) for t in "cab"] + [(2, 0, "user", t) for t in "abc"] + [(3, i, "user", f"turn {i} " * 20) for i in range(3000)] + [(4, i, "user", f"turn {i} " * 20) for i in range(2999)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.render_conversations(df.withColumns({"n_turns": F.lit(7), "copies": F.lit("x"), "body": F.lit(1)})).collect()}
    assert set(got) == {1, 3} and got[1].copies == 2 and got[3].n_turns == 3000
    assert got[1].chat == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for t in "abc")


def test_other_columns_of_clashing_names(spark, odd):
    import public_tokenizers

    names = ["score", "lang_pred", "toxicity", "passages", "n_tokens", "ids", "size", "target", "taken", "row", "hash", "bins", "label", "cid", "text_key", "kind", "id", "q", "rule", "n"]
    docs = spark.createDataFrame(odd, SCHEMA)
    more = docs.withColumns({c: F.lit("clash") for c in names})
    letters = language_id.ByteNet.train([b"the and", "schön über".encode()] * 4, ["en", "de"] * 4, epochs=1)
    toxic = toxicity.Toxicity(np.zeros(0, np.uint64), np.zeros(0), 0.05, 1.0, 1.0, 0.0, -3.0)
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    for run, own in (
        (lambda d: ngram_join.jaccard_components(d), ["doc_id", "n_shingles", "component_id"]),
        (lambda d: toxic.score(d), ["doc_id", "toxicity"]),
        (lambda d: fingerprints.edited_fingerprints(d), ["doc_id", "fingerprint", "near_next"]),
        (lambda d: mixing.mix_sources(d), ["doc_id", "size", "target", "taken"]),
        (lambda d: language_id.predict(d, letters), ["doc_id", "lang_pred", "score"]),
        (lambda d: piece_tokens.encode_pieces(d, path, with_ids=True), ["doc_id", "n_tokens", "ids"]),
    ):
        assert sorted(map(repr, run(more).select(own).collect())) == sorted(map(repr, run(docs).select(own).collect()))
    urls = spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    assert url_filters.judge_urls(urls.withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "short", "row")}), rules).first().rule == "net/es/"
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert exact_topk.exact_topk(vectors.withColumns({c: F.lit("clash") for c in ("id", "vec", "q", "score", "rank", "dim")}), F.col("vec_id") == 0, 2).count() == 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.Toxicity.fit(docs, labels, F.lit(True)).score(docs).count() == 0
    assert language_id.predict(docs, language_id.fit(docs, F.lit(True))).count() == 0
    assert exact_topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")).count() == 0
    for stage in (corpus_pipeline.language_stage, corpus_pipeline.near_duplicate_stage):
        assert stage(spark, docs, "").count() == 0


def test_grid_of_products_grows():
    assert exact_topk.grid(0, 0)[0] >= 1
    for n, q in ((1000, 20), (10**6, 2 * 10**4), (10**9, 2 * 10**7)):
        rows, columns = exact_topk.grid(n, q)
        assert rows * columns >= max(32, n * q / (1 << 30)) and columns <= max(1, -(-q // exact_topk.BLOCK))


def test_pipeline_run(spark, odd, tmp_path):
    """All stages on the odd documents against plain Python: letters decide the language, no labels, Jaccard by sets, copies, the library's ids."""
    import public_tokenizers
    import sentencepiece

    rows = sorted(set(odd), key=repr) + [(200 + i, f"text number {i} of its own kind with some words " * 3, "en", "s3", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"lang": F.lit("en"), "label": F.lit("clash"), "size": F.lit(1)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    sets = [({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) for w in (split(r[1]) for r in kept)]
    group = list(range(len(kept)))
    for a, b in itertools.combinations(range(len(kept)), 2):
        if kept[a][0] is not None and kept[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            group = [group[a] if g == group[b] else g for g in group]
    alone = [min((kept[i] for i in range(len(kept)) if group[i] == g), key=lambda r: (r[0] is None, r[0])) for g in sorted(set(group))]
    mixed = mixing.mix_sources(spark.createDataFrame(alone, SCHEMA), keep=["doc_id"]).collect()
    copies = collections.Counter()
    for r in mixed:
        copies[r.doc_id] += math.ceil(r.taken / r["size"]) if r["size"] else 0
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = collections.Counter()
    for r in alone:
        ids = [sp.bos_id(), *sp.encode(r[1]), sp.eos_id()]
        want[r[0], hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += copies[r[0]]
    assert collections.Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == +want


def test_many_null_ids_make_many_buckets(spark):
    """Each row has a successor of its own, in one ring, whatever the bucket size."""
    rows = [(None if i % 3 == 0 else (i // 2) + (1 << 62) * (i % 2), f"t{i}") for i in range(90)]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"], rows_per_bucket=4).collect()
    assert len(got) == 90
    after = {r.text: r["__next"].text for r in got}
    ids, at, seen = dict((t, i) for i, t in rows), "t0", []
    for _ in range(90):
        seen.append(at)
        at = after[at]
    assert sorted(seen) == sorted(ids) and at == "t0"
    turned = [ids[t] for t in seen]
    first = next(i for i in range(90) if turned[i] is None and turned[i - 1] is not None)
    turned = turned[first:] + turned[:first]
    assert turned == sorted(turned, key=lambda x: -1 if x is None else x)
