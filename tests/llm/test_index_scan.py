"""Whitening, ranked lexical search and licence scans against brute force."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cindergrid.llm import common, license_scan, lexical_rank, queries, whitening

SF = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


@pytest.mark.parametrize("d,k,kind", [(30, 8, "plain"), (90, 16, "near"), (5, 16, "plain"), (40, 16, "low rank"), (70, 6, "equal"), (1, 1, "plain")])
def test_eigenpairs(d, k, kind):
    a = np.random.default_rng(d).normal(size=(d, 2 * d))
    if kind == "low rank":
        a[10:] = 0
    a = np.eye(d) + 3 * np.diag(np.arange(d) < 2) if kind == "equal" else a @ a.T + (d * 30 * np.eye(d) if kind == "near" else 0)
    passes = []
    values, vectors, errors = whitening.jacobi_davidson(lambda c: (passes.append(1), a @ c)[1], d, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    assert np.abs(values - want).max() < 1e-12 * want[0] and np.abs(a @ vectors - vectors * values).max() < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12 and (errors < 1e-12 * want[0]).all() and len(passes) < 150


def whitened_by_numpy(rows, k, scale=64.0, shift=1_000_000):
    x = {i: [math.floor(scale * float(np.float32(c))) + shift for c in v] for i, v in rows}
    fit = [list(v) for v in sorted({tuple(v) for v in x.values()})]
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    m = np.array([[n * c - s for c, s in zip(v, total)] for v in fit], float) / n
    values, axes = np.linalg.eigh(m.T @ m / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    out = {}
    for i, v in x.items():
        off = [n * c - s for c, s in zip(v, total)]
        out[i] = (sum(o * o for o in off), np.array(off) / n @ axes / np.sqrt(values))
    return n, values / np.trace(m.T @ m / n), out


def held_against_numpy(got, rows, k):
    n, share, want = whitened_by_numpy(rows, k)
    by = collections.defaultdict(dict)
    for r in got:
        assert r.n == n and r.deviation == want[r.vec_id][0] and abs(r.explained - share[r.component - 1]) < 1e-10 and r.identity_error < 1e-9
        by[r.component][r.vec_id] = r.whitened
    assert sorted(by) == list(range(1, k + 1))
    for c, found in by.items():
        ids = sorted(found)
        a, b = np.array([found[i] for i in ids]), np.array([want[i][1][c - 1] for i in ids])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def test_whitening_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TILE", 16)
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=7) * np.arange(1, 8)]) for i in range(120)]
    good += [(200 + i, good[3][1]) for i in range(60)]  # a third of the rows
    odd = [(500, None), (501, []), (502, [1.0, None] + [0.0] * 5), (503, [float("nan")] * 7), (504, [float("inf")] * 7), (505, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1.0, 3) for i, v in good + odd], "vec_id long, embedding array<float>, whitened double, n int").repartition(5)
    got = whitening.whiten(table, 4).collect()
    assert len(got) == 4 * len(good)
    held_against_numpy(got, good, 4)


def test_whitening_of_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    held_against_numpy(queries.op11_whitening(spark, SF).collect(), rows, 16)


def test_whitening_of_little(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 7.0]), (None, [2.0, 4.0, 7.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(table.limit(0)).collect() == [] == whitening.whiten(table.where("vec_id = 1")).collect()
    got = whitening.whiten(table).collect()
    assert {(r.vec_id, r.component) for r in got} == {(1, 1), (2, 1), (None, 1)} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in got)
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {2**63 - 1}
    spread = whitening.spread_out(np.array([[1 << 40, 3]]), 1 << 30, [5, 1])
    assert spread.tolist() == [[(1 << 70) - 5, (3 << 30) - 1]] and whitening.deviations(np.array([[3, -4], [0, 1]])).tolist() == [25, 1]


def ranked_by_hand(docs, items, k):
    count = [collections.Counter(terms(t)) for _, t in docs]
    n, length = sum(bool(c) for c in count), sum(sum(c.values()) for c in count)
    df = collections.Counter(t for c in count for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t}:
        found = []
        for (doc, _), c in zip(docs, count):
            m = 100 - 90 + (90 * sum(c.values()) * n) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    words = [w + str(rng.randrange(9)) for w in "the of an Idiot schön été Über x_y z-1 \x01".split() for _ in range(8)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (1 + j) for j in range(len(words))], k=rng.randrange(1, 60)))) for i in range(n)]
    rows += [(1000 + i, rows[4][1]) for i in range(n // 2)]  # a third of all are one text
    return rows + [(7, rows[7][1]), (None, rows[4][1]), (None, "the0 of1"), (2000, None), (2001, ""), (2002, " \t!?"), (2003, "lang " * 30000), (2004, "İ ÀÉ éÉ")]


def test_quadtree_holds_every_cell_and_maximum():
    rng = np.random.default_rng(2)
    z = np.unique(rng.integers(0, 4**6, 500).astype(np.uint64))
    value = rng.integers(1, 99, len(z))
    kids, level, top = lexical_rank.quadtree(z, value, 6)
    under = {i: [i] for i in range(len(z))}
    for i, (own, at, most) in enumerate(zip(kids, level, top)):
        members = sorted(p for c in own if c >= 0 for p in under[int(c)])
        under[len(z) + i] = members
        cells = {int(z[p]) >> (2 * (6 - int(at))) for p in members}
        assert (own >= 0).sum() >= 2 and len(cells) == 1 and most == max(value[members])
        assert members == [p for p in range(len(z)) if int(z[p]) >> (2 * (6 - int(at))) in cells]
        assert all(int(z[p]) >> (2 * (5 - int(at))) & 3 == q for q, c in enumerate(own) if c >= 0 for p in under[int(c)])
    assert under[len(z) + len(kids) - 1] == list(range(len(z))) and len(kids) < len(z)


@pytest.mark.parametrize("shard,block,wide", [(400, 60, 3), (1 << 23, 1 << 23, 256)])
def test_ranking_against_brute_force(spark, tmp_path, monkeypatch, shard, block, wide):
    monkeypatch.setattr(lexical_rank, "WIDE", wide)
    docs = texts(3, 80)
    items = [(1, "the0 of1 IDIOT2 schön3"), (2, "nothing here"), (3, None), (4, ""), (5, " ".join(t for _, t in docs[:3])), (5, "été1"), (6, "the1 the1"), (6, "the1 the1"), (None, "x"), (8, docs[4][1])]
    table = spark.createDataFrame([(d, t, 1, "y") for d, t in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    _, n = lexical_rank.build_index(table, f"file://{tmp_path}/index", shard_bytes=shard)
    index = spark.read.parquet(f"file://{tmp_path}/index")  # as a later job would
    got = lexical_rank.search(index, n, asked, 5, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked_by_hand(docs, items, 5)


def test_index_is_written_and_read_in_small_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_rank, "shared_dir", None)  # the index has its own folder; of what is written beside it nothing stays
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/beside")
    monkeypatch.setitem(lexical_rank.SMALL, "spark.sql.execution.arrow.maxBytesPerBatch", "4000")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "77")
    docs = texts(5, 300)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    index, n = lexical_rank.build_index(table, f"file://{tmp_path}/index", shard_bytes=4000)
    assert n == sum(bool(terms(t)) for _, t in docs) and index.agg(F.sum("docs")).first()[0] == n and not (tmp_path / "beside").exists()
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "index").glob("*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert len(groups) > 3 and all(g.num_rows == 1 for g in groups)  # a task's memory doesn't grow with its shards
    assert not any(g.column(c).has_dictionary_page or g.column(c).is_stats_set for g in groups for c in range(g.num_columns))
    held = lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches)
    with lexical_rank.small_batches(spark):
        assert {r.n for r in index.select("z").mapInArrow(held, "n long").collect()} == {1}
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "77" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")


def test_ranking_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "c")], "item_id long, text string")
    assert lexical_rank.rank_documents(docs.limit(0), items).collect() == [] == lexical_rank.rank_documents(docs, items.limit(0)).collect()
    assert lexical_rank.rank_documents(docs.where("doc_id = 2"), items).collect() == []
    assert [(r.item_id, r.rank, r.doc_id) for r in lexical_rank.rank_documents(docs, items).collect()] == [(1, 1, 1)]
    assert lexical_rank.norm(np.array([10**12]), 10**9, 10**13)[0] == 10 + 90 * 10**12 * 10**9 // 10**13


def places_by_hand(text):
    words = [w for w in terms(text)]
    found = [(i, label) for label, phrase in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    where = [i for i, _ in found]
    return len(words), len(found), min(where, default=None), max(where, default=None), ",".join(sorted({x for _, x in found}))


@pytest.mark.parametrize("chunk", [4, 4096])
def test_statistics_against_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(license_scan, "CHUNK", chunk)
    rng = random.Random(4)
    sequences = [[rng.randrange(1, 5) for _ in range(rng.randrange(1, 13))] for _ in range(9)]
    auto = license_scan.Automaton(sequences)
    runs = {tuple(s[i:j]): None for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    lines = [[rng.randrange(1, 6) for _ in range(n)] for n in (0, 40, 1, 300, 7)] + [s * 3 for s in sequences]
    first = np.cumsum([0, *map(len, lines)])
    state, length = auto.statistics(np.array([w for line in lines for w in line], np.uint64), first)
    for line, a in zip(lines, first):
        for i in range(len(line)):
            most = max((n for n in range(1, min(i + 1, 12) + 1) if tuple(line[i + 1 - n : i + 1]) in runs), default=0)
            assert length[a + i] == most
            if most:
                s = state[a + i]
                have = {(t, e) for t, q in enumerate(sequences) for e in range(most - 1, len(q)) if q[e + 1 - most : e + 1] == line[i + 1 - most : i + 1]}
                assert {tuple(p) for p in auto.places[auto.first[s] : auto.last[s]].tolist()} == have


def test_license_scan(spark):
    gpl, mit = license_scan.TEMPLATES[5][1], license_scan.TEMPLATES[8][1]
    filler = "lorem ipsum dolor sit amet " * 30
    docs = [
        (1, None, "", 0.0), (2, "", "", 0.0), (3, " \n", "", 0.0), (4, "a clean text about a license and the software of any person", "", None),
        (5, "see the GNU General  Public\tLicense", "gpl", 1.0), (6, f"{filler}{gpl} {filler}", "gpl,gpl-3.0-or-later", 1.0),
        (7, f"{filler}{mit.replace('to deal in', 'to have a good time dealing in')}{filler}", "mit", None),
        (8, "Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0", 1.0), (9, "cc by-nd mit license. MIT License, apache license", "apache,cc-by,mit", 1.0),
        (10, " ".join([mit] * 300), "mit", 1.0), (11, "license software " * 40000, "", None), (12, mit[: len(mit) // 3], "", None), (13, "mit_license", "mit", 1.0), (14, "mitlicense mit9 license gnu general public licenses", "", None),
        (5, "see the GNU General  Public\tLicense", "gpl", 1.0), (None, "apache license", "apache", 1.0),
    ]
    table = spark.createDataFrame([(d, t, "clash", 1) for d, t, _, _ in docs], "doc_id long, text string, labels string, n_words int")
    got = license_scan.scan_licenses(table).collect()
    assert len(got) == len(docs)
    key = lambda r: (r[0] or -1)
    for r, (d, text, labels, score) in zip(sorted(got, key=key), sorted(docs, key=key)):
        assert (r.doc_id, r.labels) == (d, labels) and (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == places_by_hand(text)
        assert 0 <= r.score <= 1 and (score is None or r.score == score)
    spans = {r.doc_id: r.spans for r in got}
    assert [(s.label, s.first, s.covered) for s in spans[6]] == [("gpl-3.0-or-later", 150, 1.0)] and 0.9 < spans[7][0].covered < 1 and len(spans[10]) == 300
    assert license_scan.scan_licenses(table.limit(0)).collect() == []
    assert {r.labels for r in license_scan.scan_licenses(table, templates=()).collect()} == {places_by_hand(t)[4] for _, t, _, _ in docs}


def test_license_scan_of_the_whole_table(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op13_license_scan(spark, SF).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == places_by_hand(text[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score == 1) == bool(r.n_base) or r.n_spans
