"""Operators against brute-force versions on the smallest and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_small import SMALL, SOLID, run, table, words


def docs_of(spark, sf_dir):
    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents")]


@pytest.fixture(scope="module", params=["small", "odd"])
def folder(request, odd):
    return SMALL if request.param == "small" else odd


def test_decontamination(spark, folder):
    windows = defaultdict(set)
    for r in table(spark, folder, "benchmark"):
        w = words(r.text)
        if r.item_id is not None and w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k:k + 10])].add(r.item_id)
    sizes = {len(w) for w in windows}
    want = Counter()
    for i, text in docs_of(spark, folder):
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(w[k:k + n])]
        sha = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        want[(i, len(w), len(hit), len(items), sha, bool(hit))] += 1
    assert Counter(map(tuple, run(spark, "op1_decontamination", folder))) == want


def test_longest_matches(spark, odd):
    from martflow.llm.decontaminate import longest_matches
    docs, bench = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.item_id, r.item_word): r.n_words for r in longest_matches(spark, docs, bench).collect()}
    texts = [words(t) for _, t in docs_of(spark, odd)]
    for r in table(spark, odd, "benchmark"):
        w = words(r.text)
        for k in range(len(w) if r.item_id is not None else 0):
            most = max((next((n for n in range(len(w) - k, 0, -1) if t[p:p + n] == w[k:k + n]), 0)
                        for t in texts for p in range(len(t))), default=0)
            assert got.get((r.item_id, k), 0) == most


def test_jaccard_components(spark, folder):
    docs = docs_of(spark, folder)
    sets = []
    for _, text in docs:
        w = words(text, SOLID)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(docs))
    assert Counter(map(tuple, run(spark, "op4_jaccard_join", folder))) == want


def _deduped(docs):
    """op7's rows of (doc_id, bytes)."""
    seen = Counter(b[k:k + 200] for _, b in docs for k in range(len(b) - 199))
    want = Counter()
    for i, b in docs:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k:k + 200]] > 1:
                gone[k:k + 200] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if b else 0
        want[(i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    return want


def test_suffix_dedup(spark, folder):
    want = _deduped([(i, (t or "").encode()) for i, t in docs_of(spark, folder)])
    assert Counter(map(tuple, run(spark, "op7_suffix_dedup", folder))) == want


@pytest.mark.parametrize("limit", [1500, 20_000])
def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch, limit):
    """A passage of 150 or 190 bytes in many texts, whose surroundings are shared by some: parts of few bytes."""
    from martflow.llm import substrings
    rnd = random.Random(4)

    def noise(n):
        return "".join(rnd.choice("abcdefgh ") for _ in range(n))
    before, after, texts = [noise(60) for _ in range(6)], [noise(60) for _ in range(6)], []
    for size, n in ((150, 250), (190, 100)):
        passage = noise(size)
        for _ in range(n):
            cut = rnd.randrange(61)
            left = noise(rnd.randrange(200)) + rnd.choice([noise(60), before[rnd.randrange(6)][cut:]])
            texts.append(left + passage + rnd.choice([noise(60), after[rnd.randrange(6)][:60 - cut]]) + noise(rnd.randrange(200)))
    texts += ["ab" * 300, "cab" + "ab" * 200, None, "", texts[0], texts[0]]
    rounds, halve = [], substrings._parted
    monkeypatch.setattr(substrings, "PART_BYTES", limit)
    monkeypatch.setattr(substrings, "_parted", lambda *a: rounds.append(halve(*a)) or rounds[-1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substrings.removed(spark, df).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert Counter(map(tuple, got)) == _deduped([(i, (t or "").encode()) for i, t in enumerate(texts)])
    assert len(rounds[0][1]) >= (5 if limit == 1500 else 1)           # rounds of halving


def test_token_files(spark, folder):
    from tokenizers import Tokenizer

    from martflow.llm.tokens import vocabulary_path
    tok = Tokenizer.from_file(vocabulary_path())
    ids = [(i, tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in docs_of(spark, folder)]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    rows = sorted(run(spark, "op2_token_output", folder), key=lambda r: (r.start, r.n_tokens))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)


def test_token_files_random_access(spark):
    import io

    from martflow.llm import tokens
    ids = [np.arange(n, dtype=np.uint32) % 50000 for n in (5, 200_000, 1, 70_000, 70_000, 3)]
    counts = np.array([len(x) for x in ids])
    out = io.BytesIO()
    assert tokens.write_file(out, [(np.arange(6), counts, np.concatenate(ids))]) == (6, counts.sum())
    f = tokens.TokenFile(out)
    [(row, got)] = f.documents(np.array([4]))
    assert row == 4 and (got == ids[4]).all() and f.frames_read == 1
    raw = bytearray(out.getvalue())
    raw[40] ^= 1
    with pytest.raises(Exception):
        list(tokens.TokenFile(io.BytesIO(bytes(raw))).documents())
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    path = tokens.scratch(spark, "tokens-test")
    manifest = tokens.write_tokens(spark, docs, path)
    got = {r.doc_id: r.ids for r in tokens.read_documents(spark, manifest, path, [7, 31]).collect()}
    one = tokens.PieceEncoder(tokens.vocabulary_path()).tok
    assert got == {i: one.encode(f"text number {i}").ids + [2] for i in (7, 31)}


def test_license_scan(spark, folder):
    from martflow.llm.licenses import BASE
    got = {}
    for r in run(spark, "op9_license_scan", folder):
        got.setdefault(r.doc_id, []).append(r)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    want = defaultdict(list)
    for i, text in docs_of(spark, folder):
        w = words(text)
        places = [(k, label) for p, label in BASE for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        first = [k for k, _ in places]
        want[i].append((len(w), len(places), min(first, default=None), max(first, default=None),
                        ",".join(sorted({x for _, x in places}))))
    for i, rows in got.items():
        assert Counter((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == Counter(want[i])


def test_license_changes_are_found(spark):
    from martflow.llm.licenses import find_notices
    text = "say undr the mit licence now"
    [r] = find_notices(spark, spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.label, r.exact, r.edits, r.first_word, r.end_word) == ("mit", False, 2, 1, 5)
    assert text[r.first_byte:r.end_byte] == "undr the mit licence"


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_license_spans_beside_each_other(spark):
    """Planted notices with up to two edits, close together: every one is found with its span and edits."""
    from martflow.llm.licenses import find_notices
    rnd, notice = random.Random(9), "under the mit license"

    def changed():
        text = list(notice)
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(1, len(text) - 1)
            kind = rnd.randrange(3)
            if kind == 0:
                del text[at]
            elif kind == 1:
                text.insert(at, rnd.choice("qxz"))
            elif text[at] != " ":
                text[at] = rnd.choice("qxz")
        return re.sub(" +", " ", "".join(text))
    docs, want = [], set()
    fixed = ["undr the mit license", "under the mit license"], ["undee the mitt license", "undr the mit license"]
    for i in range(300):
        text = "x"
        for v in fixed[i] if i < 2 else [changed() for _ in range(rnd.randrange(1, 6))]:
            text += " " + rnd.choice(["", "say ", "now or "]) if i >= 2 else " "
            want.add((i, len(text), len(text) + len(v), _distance(v, notice)))
            text += v
        docs.append((i, text + " y"))
    found = find_notices(spark, spark.createDataFrame(docs, "doc_id long, text string")).where("label = 'mit'").collect()
    assert len(found) == len(want)
    assert {(r.doc_id, r.first_byte, r.end_byte, r.edits) for r in found} == want


def test_mixing(spark, folder):
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, folder, "documents")]
    size = Counter()
    for _, text, source in docs:
        size[source] += len(SOLID.findall(text or ""))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * size[s] if s in capped else left * weight[s] / total for s in order}
        above = {s for s in order if target[s] > 3 * size[s] * (1 + 1e-12)}
        if not above:
            break
        capped |= above
    source = defaultdict(set)
    for i, _, s in docs:
        source[i].add(s)
    rows = run(spark, "op8_mixing_weights", folder)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(SOLID.findall(t or ""))) for i, t, _ in docs)
    taken = Counter()
    for r in rows:
        assert r.taken <= 3 * r.size
        [s] = [s for s in source[r.doc_id] if size[s] == r.source_size and abs(target[s] - r.target) < 1e-6][:1]
        taken[s] += r.taken
    for s in order:
        sizes = [n for n in (len(SOLID.findall(t or "")) for _, t, x in docs if x == s) if n]
        one = max(sizes, default=0)               # a document that is most of its source is taken whole or not
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], 2 * min(sizes, default=0),
                                                one / 2 if one > target[s] / 2 else 0)
    assert Counter(rows) == Counter(run(spark, "op8_mixing_weights", folder))


def test_nearest_neighbours(spark, odd):
    for path, least in ((SMALL, 0.9), (odd, 1.0)):
        vectors = defaultdict(set)
        for r in table(spark, path, "embeddings"):
            v = r.embedding
            if r.vec_id is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) != 2:
                vectors[r.vec_id].add(tuple(v))
        rows = defaultdict(list)
        for r in run(spark, "op10_nearest_neighbours", path):
            rows[r.query_id].append(r)
        found = total = 0
        for q in (i for i in vectors if i % 20 == 0):
            got = sorted(rows[q], key=lambda r: r.rank)
            if len(vectors[q]) > 1:
                continue                   # one id, several vectors
            [x] = vectors[q]
            want = sorted((-float(np.dot(np.float64(x), np.float64(v))), i) for i in vectors if i != q for v in vectors[i])[:20]
            assert [r.rank for r in got] == list(range(1, len(want) + 1))
            assert all(r.vec_id != q for r in got)
            found += len({r.vec_id for r in got} & {i for _, i in want})
            total += len({i for _, i in want})
        assert found >= least * total


def test_hilbert_keys_visit_neighbouring_cells():
    from martflow.llm.neighbours import hilbert_keys
    for dims, bits in ((2, 4), (3, 3), (6, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        key = hilbert_keys(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_components_of_a_long_chain_and_a_star(spark):
    from martflow.llm.components import components
    links = [(i + 1, i) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7)]
    got = {r.a: r.b for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + k: 100 for k in range(1, 60)}}


def test_jaccard_of_groups_with_small_tiles(spark, monkeypatch):
    """Groups of near copies, shared passages and every way through the runs."""
    import random

    from martflow.llm import jaccard
    for name, value in (("TILE", 3), ("LARGE", 3), ("SHORT_RUN", 4), ("STARS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts, shared = [], [word() for _ in range(30)]
    for _ in range(4):
        base = [word() for _ in range(60)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rnd.randrange(5)):
                copy[rnd.randrange(60)] = word()
            texts.append(" ".join(copy[:rnd.randrange(52, 61)]))
    texts += [" ".join([*shared, *[word() for _ in range(rnd.randrange(3, 12))]]) for _ in range(24)]
    docs = spark.createDataFrame([(1000 - k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    group = [{k} for k in range(len(texts))]
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] is not group[b]:
                both = group[a] | group[b]
                for k in both:
                    group[k] = both
    want = {frozenset(1000 - k for k in g) for g in group}
    got = defaultdict(set)
    for r in jaccard.near_duplicates(spark, docs).collect():
        got[r.comp].add(r.doc_id)
    assert {frozenset(g) for g in got.values()} == want
    assert 10 < len(want) < 70


def test_jaccard_order_tells_a_shared_passage_from_full_buckets(spark, monkeypatch):
    """Rare shingles fill every bucket with more than the passage's dozen documents; it still stands last."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from martflow.llm import jaccard
    from martflow.llm.common import text_chunks
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 12)
    own = lambda d: " ".join(f"d{d}w{k}" for k in range(300))
    passage = " ".join(f"shared{k}" for k in range(20))
    texts = [f"{own(d)} {passage}" if d < 12 else own(d) for d in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    level = jaccard._summary(spark, docs)[1]
    (_, _, buf, offs), = text_chunks(pa.array([passage, own(150)]))
    sets = jaccard.Sets(buf, offs)
    at = level[(sets.value & np.uint64(len(level) - 1)).astype(int)].astype(float)
    assert at[sets.owner == 0].mean() > at[sets.owner == 1].mean() + 1
    # Short of 16 levels, and in an empty corpus all alike.
    assert jaccard.levels(np.array([0, 0, 2**20], np.uint32)).max() <= 15
    assert not jaccard.levels(np.zeros(8, np.uint32)).any()


def test_jaccard_driver_holds_little_beside_its_counts():
    """Levels are made in parts, so the driver's memory keeps near the counts' own size."""
    import tracemalloc

    from martflow.llm import jaccard

    counts = np.random.default_rng(5).integers(0, 300, 1 << jaccard.SKETCH_BITS).astype(np.uint32)
    counts[::1000] = 10**6
    tracemalloc.start()
    got = jaccard.levels(counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * len(got)
    above = np.maximum(counts.astype(np.int64) - int(counts.mean()), 1)
    assert (got == np.minimum(np.floor(np.log2(above)), 15)).all()


def test_jaccard_links_of_one_common_partner(spark):
    """Several classes whose only partner is the same class, in one partition."""
    from pyspark.sql import functions as F

    from martflow.llm import jaccard
    texts = [f"{' '.join(f'w{i}' for i in range(60))} end{k}" for k in range(6)] * 2
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select(
        F.lit(1).cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    rows = jaccard._summary(spark, docs)[0]
    cids = sorted({r.cid for r in rows.select("cid").collect()})
    want = [(a, cids[-1]) for a in cids[:-1]]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = jaccard._links(spark, spark.createDataFrame(want, "a long, b long"), docs, rows).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert sorted(map(tuple, got)) == want


def test_added_tokens_are_encoded_as_in_the_whole_text():
    from martflow.llm.tokens import END_ID, PieceEncoder, vocabulary_path
    enc, end = PieceEncoder(vocabulary_path()), "<|endoftext|>"
    texts = [f"one {end} two", f"a{end}b", f"x\n{end}\ny", f"{end}{end} {end}", end, f"é {end}é 1{end}2 don't{end}!", "",
             "<|endof", "text|> <|endoftext| one", f"<|endoftext {end}|>", f"  {end}  two words", "<|endoftext|", "> next"]
    raw = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    ids, counts = enc.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
    at = np.concatenate(([0], np.cumsum(counts)))
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == enc.tok.encode(t, add_special_tokens=False).ids + [END_ID], t
