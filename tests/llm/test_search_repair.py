"""Operators 11 to 13 against brute force."""

import math

import numpy as np
import pytest
from brute_repair import repair_all
from llm_small import SMALL, odd_conversations, run, table, words

from martflow.llm import convrepair, impactsearch, lexical, neighbours
from martflow.llm.decontaminate import decontaminate
from martflow.llm.jaccard import near_duplicate_stage
from martflow.llm.mixing import mix_stage
from martflow.llm.quality import quality_stage


# ------------------------------------------------------------------ op11
@pytest.mark.parametrize("pieces", [1, 12])
def test_repair(spark, pieces):
    rows = odd_conversations(seed=pieces)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(pieces))      # conversations are cut where partitions are
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {r[0]: tuple(r[1:]) for r in convrepair.repair(spark, df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == repair_all(rows)


def test_repair_of_the_table(spark, odd):
    for where in (SMALL, odd):
        rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, where, "conversations")]
        assert {r[0]: tuple(r[1:]) for r in run(spark, "op11_conversation_repair", where)} == repair_all(rows)


def test_ranks_order_all_audits():
    rng = np.random.default_rng(3)
    code = rng.integers(0, 12, 200)
    ptr = np.array([0, 0, 1, 40, 200])
    end = np.tile(np.array(convrepair.TAIL), (4, 1))
    togo = convrepair.costs_to_go(code, ptr, end)
    target, _ = convrepair.optimal_arcs(code, ptr, togo)
    label, rank, pointers, length = convrepair.rank_paths(target)
    nodes = np.flatnonzero(togo.ravel() < convrepair.FAR)
    text, cut, _ = convrepair.audits(nodes, label, pointers, length)
    spelled = [text[a:b].tobytes() for a, b in zip(cut, cut[1:])]
    by_rank = [s for _, s in sorted(zip(rank[nodes], spelled))]
    assert by_rank == sorted(spelled)
    assert len({(r, s) for r, s in zip(rank[nodes], spelled)}) == len(set(spelled))


# ------------------------------------------------------------------ op12
def ranked(docs, items, top):
    """The contract, row by row."""
    texts = [(d, words(t)) for d, t in docs]
    texts = [(d, w) for d, w in texts if w]
    n_docs, n_all = len(texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    terms = {}
    for i, t in items:
        if i is not None:
            terms.setdefault(i, set()).update(words(t))
    out = []
    for i, want in terms.items():
        found = []
        for d, w in texts:
            m = 100 - 50 + (50 * len(w) * n_docs) // n_all
            s = 0
            for t in want & set(w):
                tf = w.count(t)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def test_ranked_search(spark, odd, monkeypatch):
    for where in (odd, SMALL):
        want = ranked([(r["doc_id"], r["text"]) for r in table(spark, where, "documents")],
                      [(r["item_id"], r["text"]) for r in table(spark, where, "benchmark")], lexical.TOP)
        assert sorted((tuple(r) for r in run(spark, "op12_lexical_search", where)), key=str) == want
    monkeypatch.setattr(lexical, "ITEM_TERMS", 40)                       # several blocks of items
    assert sorted((tuple(r) for r in run(spark, "op12_lexical_search", SMALL)), key=str) == want


def test_blocks_lose_no_document():
    """Shards of random documents, with crowds of equal ones and skewed terms."""
    rng = np.random.default_rng(9)
    for n_docs, n_terms in ((400, 60), (900, 12), (1, 3)):
        kinds = [np.unique((rng.random(rng.integers(1, 15)) ** 2 * n_terms).astype(int)) for _ in range(max(1, n_docs // 3))]
        docs = [kinds[k] for k in rng.integers(0, len(kinds), n_docs)]
        ptr = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        term = np.concatenate(docs)
        impact = (rng.integers(1, 9, len(term)) * (term + 1) * (term % 11 > 0)).astype(np.int64)
        shard = lexical.Shard(np.arange(n_docs) * 7, ptr, term, impact, n_terms)
        for t in range(n_terms):
            rows, cut, terms, most, at = shard.blocks(t) if len(shard.listed(t)) else ([], [0], [], [], [0])
            assert sorted(rows) == sorted(d for d in range(n_docs) if t in docs[d])
            assert all(0 < b - a <= 2 * lexical.BLOCK_DOCS for a, b in zip(cut, cut[1:]))
            for a, b, x, y in zip(cut, cut[1:], at, at[1:]):
                summary = dict(zip(terms[x:y], most[x:y]))
                for d in rows[a:b]:
                    assert all(summary[u] >= v for u, v in zip(term[ptr[d]:ptr[d + 1]], impact[ptr[d]:ptr[d + 1]]))
        for size in (1, 4, 9):
            ask = np.unique(rng.integers(0, n_terms, size))
            exact = np.array([impact[ptr[d]:ptr[d + 1]][np.isin(docs[d], ask)].sum() for d in range(n_docs)])
            order = np.lexsort((np.arange(n_docs), -exact))[:lexical.TOP]
            order = order[exact[order] > 0]
            for theta in (1, int(exact[order].min(initial=1)) if len(order) == lexical.TOP else 1):
                best = lexical.Best(lexical.TOP)
                shard.search(ask, theta, best)
                assert best.ids.tolist() == (order * 7).tolist()
                assert best.scores.tolist() == exact[order].tolist()


# ------------------------------------------------------------------ op13
def nearest(rows, every, top):
    least = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            least[i] = min(least.get(i, v := tuple(math.floor(256 * x) for x in v)), v)
    sizes = [len(v) for v in least.values()]
    size = min(set(sizes), key=lambda s: (-sizes.count(s), s), default=0)
    ids = sorted(i for i, v in least.items() if len(v) == size)
    out = []
    for q in ids:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(least[q], least[i])), i) for i in ids if i != q)[:top]
            out += [(q, k, i, -s) for k, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_exact_topk(spark, odd):
    for where in (odd, SMALL):
        want = nearest([(r["vec_id"], r["embedding"]) for r in table(spark, where, "embeddings")], 50, 5)
        assert sorted(tuple(r) for r in run(spark, "op13_exact_topk", where)) == want


def test_exact_topk_with_ties_and_crowds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) / 2 for x in rng.integers(-1, 2, 6)]) for i in range(900)]
    rows += [(i, rows[3][1]) for i in range(900, 1300)] + [(i, [0.0] * 6) for i in range(1300, 1340)]
    rows += [(2000 + i, [float(x) for x in rng.normal(size=6) * 10.0 ** (i % 5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    held = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = impactsearch.search(spark, df, every=20, top=7, shard_rows=100)
    assert sorted(tuple(r) for r in got.collect()) == nearest(held, 20, 7)


def test_shard_keeps_the_best():
    rng = np.random.default_rng(8)
    for n, dim, size in ((500, 16, 60), (70, 3, 2), (1, 5, 9)):
        v = rng.integers(-size, size + 1, (n, dim))
        shard = impactsearch.Shard(v, np.arange(n))
        for q in (*rng.integers(-size, size + 1, (10, dim)), np.zeros(dim, np.int64)):
            exact = v @ q
            order = np.lexsort((np.arange(n), -exact))[:6]
            assert shard.best(q, 6, -np.inf)[0].tolist() == order.tolist()
            theta = float(exact[order[-1]])
            assert shard.best(q, 6, theta)[0].tolist() == order.tolist()
            assert len(shard.best(q, 6, exact.max() + 1.0)[0]) == 0


# ------------------------------------------------------------------ op10, stages
def test_neighbours_with_equal_scores_go_by_id(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(0, 2, 12)] + [1.0]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(spark, df, reach=10**6).collect():         # every block is in reach
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.array([r[1] for r in rows])
    for q, found in got.items():
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:neighbours.TOP]
        assert sorted(found) == [(k, int(i), float(s[i])) for k, i in enumerate(order, 1)]
    assert len(got) == 75


def test_neighbours_by_small_tiles_and_few_curves(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("SPAN", 2), ("TILE", 16), ("CURVES", 3)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1200, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    seen = []
    real = neighbours.measure_reach
    monkeypatch.setattr(neighbours, "measure_reach", lambda *a: seen.append((a[-1], real(*a))) or seen[-1][1])
    got = {}
    for r in neighbours.search(spark, df, every=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    # Without structure a window covers the curve, and the curves hold the same vectors: one is searched.
    [(blocks, (curves, reach))] = seen
    assert curves == 1 and 2 * reach + 1 >= blocks > 10
    v = x.astype(np.float64)
    for q, found in got.items():
        s = (v * v[q]).sum(axis=1)
        order = [int(i) for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:neighbours.TOP]
        assert [found[k] for k in sorted(found)] == order
    assert len(got) == 240


def test_best_of_exact_order_at_any_scale(monkeypatch):
    monkeypatch.setattr(neighbours, "EXACT_ROWS", 50)
    rng = np.random.default_rng(4)
    for scale in (1e-30, 1.0, 1e30):
        v = rng.integers(0, 3, (700, 6)) * scale
        q, ids = v[:90] + 0.0, rng.permutation(700)
        got_ids, got = neighbours.best_of(q, v, ids, 9)
        for k in range(len(q)):
            s = neighbours.exact_scores(np.repeat(q[k:k + 1], 700, axis=0), v)
            order = np.lexsort((ids, -s))[:9]
            assert got_ids[k].tolist() == ids[order].tolist() and got[k].tolist() == s[order].tolist()


def test_found_rows_merge_across_batches(spark):
    rng = np.random.default_rng(6)
    rows = [(c, [int(i) for i in ids], [float(7 * i % 11) for i in ids])
            for c in range(5) for ids in (rng.choice(60, 8, replace=False) for _ in range(40))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame(rows, "cid long, ids array<long>, scores array<double>")
        got = {r["cid"]: [(p["s"], p["id"]) for p in r["best"]] for r in neighbours.merged(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for c in range(5):
        assert got[c] == sorted({(-s, i) for k, ids, ss in rows if k == c for i, s in zip(ids, ss)})[:neighbours.TOP + 1]


@pytest.mark.parametrize("stage", [quality_stage, near_duplicate_stage, decontaminate, mix_stage])
def test_stages_return_clashing_columns_unchanged(spark, odd, stage):
    names = ["qc_score", "dc_contaminated", "mx_size", "mx_source", "jk", "jk_id", "li_lang", "user_0", "a.b"]
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    marked = docs.select("doc_id", "text", "source", *[(docs["doc_id"] * 10 + k).alias(n) for k, n in enumerate(names)])
    out = stage(spark, marked, odd)
    assert out.columns == marked.columns
    kept = out.collect()
    assert kept
    for r in kept:
        assert [r[n] for n in names] == [None if r["doc_id"] is None else r["doc_id"] * 10 + k for k in range(len(names))]
