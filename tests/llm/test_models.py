"""Trained operators: held-out accuracy, gradients, and what scores must order."""

import zlib

import numpy as np

from llm_small import run, table

LARGER = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    label = {r.doc_id: r.quality for r in table(spark, LARGER, "labels")}
    rows = [r for r in run(spark, "op3_quality_classifier", LARGER)]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.predicted == label[r.doc_id] for r in rows if r.held_out and r.doc_id in label]
    assert len(held) > 50 and np.mean(held) > 0.97
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)


def test_language_held_out(spark, odd):
    lang = {r.doc_id: r.lang for r in table(spark, LARGER, "documents")}
    rows = run(spark, "op6_language_id", LARGER)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.97
    by_id = {r.doc_id: r for r in run(spark, "op6_language_id", odd)}
    assert {by_id[i].lang_pred for i in (4, 5, 6, 14)} == {"und"}


def test_lm_gradients_and_normalisation():
    from martflow.llm import lmscore as m
    model = {k: v.astype(float) for k, v in m.new_model().items()}
    rng = np.random.default_rng(1)
    context, target = rng.integers(0, 60, (9, 2 * m.SIDE)), rng.integers(1, m.WORDS, 9)
    grad = m.gradients(model, context, target)
    for name in m.SHAPES:
        at = np.unravel_index(np.argmax(np.abs(grad[name])), grad[name].shape)
        side = []
        for step in (1e-5, -2e-5):
            model[name][at] += step
            side.append(-m.log_probs(model, context, target).mean())
        model[name][at] += 1e-5
        assert abs((side[0] - side[1]) / 2e-5 - grad[name][at]) < 1e-4
    every = m.log_probs(model, np.repeat(context[:1], m.WORDS, axis=0), np.arange(m.WORDS))
    assert abs(np.exp(every).sum() - 1) < 1e-6


def test_lm_prefers_the_order_it_has_learnt(spark):
    from martflow.llm import lmscore as m
    rng = np.random.default_rng(3)
    seen = [" ".join(f"{s} {v} {o}" for s, v, o in
                     zip(rng.choice(["dogs", "cats"], 60), ["chase"] * 60, rng.choice(["balls", "mice"], 60))) for _ in range(300)]
    mixed = " ".join(rng.permutation(seen[0].split()))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*seen, mixed])], "doc_id long, text string")
    words = m.count_words(spark, docs)
    model = m.train(spark, docs.where("doc_id < 300"), words)
    got = {r.doc_id: r for r in m.score(spark, docs, words, model).collect()}
    assert got[0].n_words == got[300].n_words == 180
    assert got[0].log_prob > got[300].log_prob
    by_hand = m.word_hashes(np.frombuffer(seen[0].encode(), np.uint8), np.array([0, len(seen[0])]))
    ids, place = m.padded(words.ids(by_hand[0]), by_hand[1])
    one_by_one = sum(float(m.log_probs(model, ids[p + m.OFFSETS][None], ids[[p]])[0]) for p in place)
    assert abs(one_by_one - got[0].log_prob) < 1e-2


def _plain_log_probs(model, ids):
    """Log-probability of each word of one text given both sides, word by word."""
    out = []
    for k, word in enumerate(ids):
        x = model["b1"].astype(float).copy()
        for place, step in enumerate((-2, -1, 1, 2)):
            near = ids[k + step] if 0 <= k + step < len(ids) else 0
            x += model["win"][place][near]
        h = np.tanh(x)
        h[-1] = 1.0
        scores, inside = h @ model["wc"], h @ model["ww"][word // 64]
        out.append(scores[word // 64] - np.log(np.exp(scores).sum()) + inside[word % 64] - np.log(np.exp(inside).sum()))
    return out


def test_lm_scores_equal_plain_ones_and_shares_of_buckets(spark, monkeypatch):
    from martflow.llm import lmscore as m
    monkeypatch.setattr(m, "SHARD_WORDS", 64)
    rng = np.random.default_rng(8)
    names = [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choice(names, int(n), p=np.arange(200, 0, -1) / 20100)) for n in rng.integers(1, 60, 40)]
    rows = list(enumerate([*texts, texts[0], "", None]))
    made = []
    for parts in (2, 8):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        words = m.count_words(spark, docs, known=3)
        model = m.train(spark, docs, words)
        made.append(({r.doc_id: r for r in m.score(spark, docs, words, model).collect()}, words, model))
    (got, words, model), (again, _, other) = made
    assert all(np.allclose(model[k], other[k], atol=1e-5) for k in m.SHAPES)
    count = {w: sum(t.split().count(w) for t in [*texts, texts[0]]) for w in names}
    hashes = dict(zip(names, (int(m.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) for w in names)))
    known = {h: k + 1 for k, h in enumerate(words.sorted.tolist())}
    assert sorted(count[w] for w in names if hashes[w] in known) == sorted(count.values())[-3:]
    word_id = {w: known.get(h, 3072 + h % 1024) for w, h in hashes.items()}
    total = {}
    for w in names:
        if word_id[w] >= 3072:
            total[word_id[w]] = total.get(word_id[w], 0) + count[w]
    assert len(total) < sum(1 for w in names if word_id[w] >= 3072)                   # some share a bucket
    for k, text in rows:
        split = (text or "").split()
        want = sum(_plain_log_probs(model, [word_id[w] for w in split]))
        want += sum(np.log(count[w] / (total[word_id[w]] + 1)) for w in split if word_id[w] >= 3072)
        assert got[k].n_words == len(split) and abs(got[k].log_prob - want) < 1e-3
        assert abs(again[k].log_prob - want) < 1e-2
        assert (got[k].per_word is None) == (not split)


def test_lm_every_word_is_a_target_once(spark, monkeypatch):
    """Targets of all rounds and shards, as weights of the models that are averaged."""
    from martflow.llm import lmscore as m
    monkeypatch.setattr(m, "SHARD_WORDS", 50)
    docs = spark.createDataFrame([(k, "a b c d e f g"[:2 * (k % 7) + 1]) for k in range(100)], "doc_id long, text string")
    words, seen, plain = m.count_words(spark, docs), [], m.map_arrow

    def spy(spark_, df, fn, schema, *rest):
        out = plain(spark_, df, fn, schema, *rest)
        if schema.startswith("shard"):
            seen.append(out.where("part = 0").agg({"weight": "sum"}).first()[0])
        return out

    monkeypatch.setattr(m, "map_arrow", spy)
    m.train(spark, docs, words)
    assert sum(seen) == sum(k % 7 + 1 for k in range(100))


def test_pipeline_stages(spark):
    import corpus_pipeline
    from llm_small import SMALL, SOLID, words
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, frames = docs.columns, []
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(spark, step(spark, docs, SMALL), f"test-{name}")
        frames.append(docs)
        if name != "token_output":
            assert docs.columns == columns
    quality, one, clean, mixed, tokens = ([r for r in f.collect()] for f in frames)
    good = {r.doc_id for r in run(spark, "op3_quality_classifier", SMALL) if r.predicted == 1}
    assert {r.doc_id for r in quality} == good

    def shingles(t):
        w = words(t, SOLID)
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}

    sets = {r.doc_id: shingles(r.text) for r in quality}
    group = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                both = group[a] | group[b]
                for i in both:
                    group[i] = both
    assert {r.doc_id for r in one} == {min(g) for g in group.values()}
    hit = {r.doc_id for r in run(spark, "op1_decontamination", SMALL) if r.contaminated}
    assert {r.doc_id for r in clean} == {r.doc_id for r in one} - hit
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    total = sum(len(SOLID.findall(r.text)) for r in clean)
    assert abs(sum(len(SOLID.findall(r.text)) for r in mixed) - total) < 0.05 * total
    whole = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in run(spark, "op2_token_output", SMALL)}
    assert len(tokens) == len(mixed) and all(whole[r.doc_id] == (r.n_tokens, r.ids_crc32) for r in tokens)


def test_language_grams_of_a_long_text_rank_by_their_whole_counts():
    from martflow.llm.langid import ranked_grams
    raw = ("t " * 1_200_000 + "e " * 1_100_000).encode()
    _, _, n, rank, _ = ranked_grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert {1_200_000, 1_100_000} <= set(n.tolist())
    assert n.tolist() == sorted(n.tolist(), reverse=True) and rank.tolist() == list(range(len(n)))
