"""Every operator against plain Python, on awkward rows: gaps, empty and long texts, ties, repeats, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import circulant_minhash, divergence, hnsw, interpolation, line_runs, mixing, packing, queries, suffix_dedup, token_counts, url_rules
from quern.llm.common import Work
from quern.llm.components import components
from quern.llm.tokenizing import ByteBpe

VOCABULARY = queries.vocabulary()


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def no_id(docs, text="a text without an id"):
    first = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(text))
    return docs.unionByName(first)


def test_tokenizer_matches_the_library(pairs):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(VOCABULARY), ByteBpe(VOCABULARY)
    odd = ["a  b", "\n\n x", " \t y  ", "it's  we'll\r\n\r\nend  ", "　 wide", "<|endoftext|> x", "a <|endoftext|> b<|endoftext|>", "1234 5", "é" * 50, "a\u00a0\u00a0b", "\u200b\u200bz"]
    for t in odd + [t or "" for _, t in pairs]:
        assert fast.encode(t) == slow.encode(t, add_special_tokens=False).ids, repr(t[:40])


# 1


def test_token_ledger(spark, docs, pairs, empty):
    work = Work(spark, "test-ledger")
    counts = token_counts.count_tokens(docs, VOCABULARY, "v1").cache()
    ledger = token_counts.TokenLedger(spark, f"{work.path}/ledger")
    assert ledger.totals().count() == 0
    assert ledger.commit("b1", token_counts.inserts(counts))
    assert not ledger.commit("b1", token_counts.inserts(counts))  # a replay changes nothing
    bpe = ByteBpe(VOCABULARY)
    facts = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.collect()}

    def totals(keep):
        out = defaultdict(lambda: [0, 0])
        for i, t in pairs:
            if keep(i):
                out[facts[i]][0] += 1
                out[facts[i]][1] += len(bpe.encode(t or ""))
        return {k: tuple(v) for k, v in out.items()}

    got = lambda: {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
    assert got() == totals(lambda i: True)
    ledger.commit("b2", token_counts.deletes(counts.where("doc_id % 2 = 0")))
    assert got() == totals(lambda i: i % 2)
    new = counts.where("doc_id % 2 = 1").withColumn("tokenizer_version", F.lit("v2")).withColumn("n_tokens", F.lit(1).cast("long"))
    ledger.commit("b3", token_counts.revisions(counts.where("doc_id % 2 = 1"), new))
    assert {r["tokenizer_version"] for r in ledger.totals().collect()} == {"v2"}
    assert ledger.totals().agg(F.sum("n_tokens")).first()[0] == sum(1 for i, _ in pairs if i % 2)
    assert ledger.commit("b4", token_counts.inserts(token_counts.count_tokens(empty, VOCABULARY, "v1")))
    with pytest.raises(ValueError):
        ledger.commit("a/b", token_counts.inserts(counts))


# 2


def check_packing(rows, pairs, capacity):
    bpe, seen = ByteBpe(VOCABULARY), Counter()
    expected = Counter()
    for i, t in pairs:
        ids = bpe.encode(t or "") + [0]
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    bins = defaultdict(list)
    for r in rows:
        seen[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == expected
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(n for p in bins.values() for _, n in p)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, pairs, empty, capacity, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 3)  # so that ranks cross groups
    twice = no_id(docs.unionByName(docs.limit(5)))
    given = [(r["doc_id"], r["text"]) for r in twice.collect()]
    bins, total = check_packing(packing.pack_documents(twice, VOCABULARY, capacity).collect(), given, capacity)
    assert bins <= 1.02 * total / capacity + 2
    assert packing.pack_documents(empty, VOCABULARY, capacity).count() == 0
    ids = packing.pieces(docs, VOCABULARY, capacity, with_ids=True).where("size(ids) <> length").count()
    assert ids == 0


def test_fullest_is_optimal():
    r = random.Random(1)
    for _ in range(200):
        stock = {r.randint(1, 30): r.randint(1, 4) for _ in range(r.randint(1, 6))}
        room = r.randint(0, 60)
        sums = {0}
        for x, n in stock.items():
            sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
        chosen = packing.fullest(room, stock)
        assert sum(x * n for x, n in chosen.items()) == max(sums)
        assert all(n <= stock[x] for x, n in chosen.items())


# 3


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_minhash(docs, pairs, empty, size, percent, monkeypatch):
    expected = brute.near_duplicates(pairs, size, percent)
    assert len({c for _, c in expected.values()}) < len(expected) - 10

    def check():
        got = by_id(circulant_minhash.near_duplicates(docs, size, percent))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == expected
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())

    check()
    if size == 3:
        monkeypatch.setattr(circulant_minhash, "BLOCK_DOCS", 4)  # a group over several blocks
        check()
        assert circulant_minhash.near_duplicates(empty).count() == 0
        rows = no_id(docs.unionByName(docs.limit(3)))
        assert circulant_minhash.near_duplicates(rows).count() == rows.count()
        kept = circulant_minhash.keep_first(no_id(docs), size=size, percent=percent)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {None, *(i for i, (_, c) in expected.items() if i == c)}


def near_copies(n, words, changes, seed=1):
    """Copies of one text, each with its own few changes, so that most pairs are linked and some are not."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        mine = base[:]
        for k in r.sample(range(words), changes):
            mine[k] = f"x{i}-{k}"
        out.append(" ".join(mine))
    return out


def test_links_are_exact_though_copies_are_not_all_compared(monkeypatch):
    r = random.Random(3)
    for trial in range(6):
        texts = near_copies(40, 120, trial + 1, trial) + near_copies(25, 90, 4, 90 + trial) + [" ".join(r.choices("abcdefg", k=60)) for _ in range(10)]
        pairs = [(i * 3, t) for i, t in enumerate(texts)]
        sets = [circulant_minhash.shingle_set(t, 3) for t in texts]
        links = circulant_minhash.linked(np.arange(len(texts)) * 3, sets, 85)
        expected = brute.near_duplicates(pairs)
        assert brute.roots([i for i, _ in pairs], links) == {i: c for i, (_, c) in expected.items()}
    asked = []
    monkeypatch.setattr(circulant_minhash._Index, "similar", lambda self, one, percent, old=circulant_minhash._Index.similar: asked.append(1) or old(self, one, percent))
    copies = near_copies(400, 200, 2)
    assert len(circulant_minhash.linked(np.arange(400), [circulant_minhash.shingle_set(t, 3) for t in copies], 85)) == 399
    assert len(asked) < 20  # not 400


def test_minhash_of_a_group_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(circulant_minhash, "BLOCK_DOCS", 10)
    # 2 changes: copies link with the head; 5: only some do, so members outside of the largest component meet all others
    pairs = list(enumerate(near_copies(60, 150, 2) + near_copies(60, 150, 4, 5) + near_copies(40, 150, 5, 7)))
    expected = brute.near_duplicates(pairs)
    got = by_id(circulant_minhash.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"), 3, 85))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == expected


def test_minhash_of_rows_that_share_an_id(spark):
    one, two, other = near_copies(2, 80, 1) + near_copies(1, 80, 0, 9)
    rows = [(5, one), (7, two), (7, other), (9, other), (9, other), (11, "unlike all the rest of them"), (None, one)]
    got = circulant_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter({(5, 5, True): 1, (7, 5, False): 2, (9, 5, False): 2, (11, 11, True): 1, (None, None, False): 1})


def test_circulant_signatures_estimate_jaccard():
    r = np.random.default_rng(0)
    both, a, b = (r.integers(0, 2**64, n, dtype=np.uint64) for n in (600, 200, 200))
    sig = circulant_minhash.signatures([np.concatenate([both, a]), np.concatenate([both, b])], 600)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.07


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(60)]
    root = brute.roots({x for e in edges for x in e}, edges)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long"), Work(spark, "test-cc")).collect()}
    assert {n: got.get(n, n) for n in root} == root
    assert components(spark.createDataFrame([], "u long, v long"), Work(spark, "test-cc")).count() == 0


# 4


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(260):
        v = r.normal(size=16)
        if i % 3 and rows:
            base = rows[r.integers(len(rows))][1]
            v = np.array(base) + r.normal(size=16) * r.choice([0.0, 0.02, 0.2, 0.35])
        rows.append((i * 2, [float(np.float32(x)) for x in v], int(i % 2)))
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, [float("nan")] * 16, 0), (905, [float("inf")] * 16, 1)]
    rows += [(906, rows[0][1], None), (907, rows[0][1][:8], 0), (908, rows[0][1], rows[0][2])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_hnsw(vectors, shard_rows):
    df, rows = vectors
    expected = brute.near_vectors(rows)
    got = by_id(hnsw.near_vectors(df, shard_rows=shard_rows, chunk_rows=50, beam=16), "vec_id")
    assert set(got) == set(expected)
    links = sum(n for n, _ in expected.values())
    found = sum(r["n_links"] for r in got.values())
    assert 0.98 * links <= found <= links
    assert all(got[i]["n_links"] <= n for i, (n, _) in expected.items())
    assert sum(got[i]["component_id"] == c for i, (_, c) in expected.items()) >= 0.98 * len(expected)
    assert hnsw.near_vectors(df.limit(0)).count() == 0


def test_hnsw_rows_that_share_an_id(spark):
    r = np.random.default_rng(2)
    a, b = r.normal(size=(2, 16))
    rows = [(1, a, 0), (1, b, 0), (2, a * 1.5, 0), (3, b + 0.01, 0), (3, b + 0.01, 0), (None, a, 0), (4, -a, 0)]
    rows = [(i, [float(x) for x in v], label, 7) for i, v, label in rows]
    got = hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int")).collect()
    assert Counter((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in got) == Counter(
        {(1, 1, 1, True): 1, (1, 2, 1, True): 1, (2, 1, 1, False): 1, (3, 2, 1, False): 2, (None, 0, None, False): 1, (4, 0, 4, True): 1}
    )


def test_audits_are_reported(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 24))
    x[500:] = x[r.integers(0, 500, 1000)] + r.normal(size=(1000, 24)) * 0.12
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    at = f"{Work(spark, 'test-audits').path}/audits"
    hnsw.near_vectors(df, shard_rows=800, beam=16, audits_to=at)
    rows = spark.read.parquet(at).collect()
    assert rows and all(r["asked"] >= 64 and r["whole"] >= 0.98 * r["asked"] for r in rows)
    assert any(r["beam"] < r["size"] for r in rows)


def test_graph_recall():
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 24))
    x[500:] = x[r.integers(0, 500, 1000)] + r.normal(size=(1000, 24)) * 0.12
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = hnsw.Graph(x)
    width = hnsw.audited_beam(g, x[:200], 0.93, 8, 0.995)
    truth = found = 0
    for q in x[::5]:
        real = set(np.flatnonzero(x @ q >= 0.93).tolist())
        mine = set(g.within(q, 0.93, width).tolist())
        assert mine <= real
        truth, found = truth + len(real), found + len(mine)
    assert found >= 0.98 * truth


def test_audit_is_not_passed_by_a_large_group_or_by_nothing():
    r = np.random.default_rng(1)
    x = r.normal(size=(1200, 48))
    x[::3] = r.normal(size=48) + r.normal(size=(400, 48)) * 0.12  # one large group
    x[1::6] = x[2::6] + r.normal(size=(200, 48)) * 0.15  # pairs
    x /= np.linalg.norm(x, axis=1)[:, None]
    g, own = hnsw.Graph(x, 9, 32), np.arange(1200)
    width = hnsw.audited_beam(g, x[:400], 0.93, 4, 0.995, own[:400])
    truth = list(hnsw.scan(x, x, 0.93, own))
    few = [i for i in range(1200) if 0 < len(truth[i]) < 5]
    assert len(few) == 400 and sum(len(g.within(x[i], 0.93, width)) - 1 == len(truth[i]) for i in few) >= 0.99 * len(few)
    # with no link to find, or none but a query's own match, no beam has passed
    alone = np.flatnonzero([not len(t) for t in truth])
    assert hnsw.audited_beam(g, x[alone[:50]], 0.93, 4, 0.995, alone[:50]) == 1200 == hnsw.audited_beam(g, -x[:50], 0.93, 4, 0.995)


# 5


def water_level(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    rest, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing(docs, pairs, empty):
    rows = by_id(mixing.plan_mix(docs))
    texts = dict(pairs)
    for i, r in rows.items():
        assert r["_size"] == len(brute.words(texts[i]))
    facts = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = Counter()
    for i, t in pairs:
        sizes[facts[i]] += len(brute.words(t))
    target = water_level(sizes)
    for i, t in pairs:
        r, n = rows[i], len(brute.words(t))
        rate = target[facts[i]] / sizes[facts[i]] if sizes[facts[i]] else 0
        assert r["_target"] == pytest.approx(target[facts[i]])
        assert r["_copies"] in (int(rate), int(rate) + (rate > int(rate)))
        assert r["_copies"] * n <= 2 * n
    # clashing names: inputs are not read, and the mix gives them back as they are
    odd = docs.withColumns({c: F.lit(7) for c in ("_source", "_target", "_copies", "_source_size", "q_source", "q_rate", "q_row", "id")})
    assert by_id(mixing.plan_mix(odd)) == rows
    assert mixing.mix_documents(odd).columns == odd.columns and mixing.mix_documents(odd).agg(F.min("_copies"), F.max("q_rate")).first() == (7, 7)
    again = by_id(mixing.plan_mix(docs.repartition(7)))
    assert all(again[i]["_copies"] == r["_copies"] for i, r in rows.items())
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: r["_copies"] for i, r in rows.items() if r["_copies"]})
    assert mixing.plan_mix(empty).count() == 0 == mixing.mix_documents(empty).count()


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 100}, {"a": 0, "b": 7}, {"a": 1}, {"a": 5, "b": 5, "c": 5, "d": 5000}])
def test_water_level(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, (5, 2, 1), 1.5, 2.0).collect()}
    expected = water_level(sizes)
    assert got == {s: pytest.approx(expected[s]) for s in sizes}


# 6


def test_scores(docs, pairs, empty, monkeypatch):
    monkeypatch.setattr(interpolation, "BLOCK_TOKENS", 300)
    expected, got = brute.base_scores(pairs), by_id(interpolation.score_documents(docs))
    assert set(got) == set(expected)
    for i, (held, n, known, total, base) in expected.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] < 0
    trained = [r for r in got.values() if not r["held_out"]]
    assert sum(r["score"] for r in trained) > sum(r["base_score"] for r in trained)
    again = by_id(interpolation.score_documents(docs.repartition(5)))
    assert all(again[i]["score"] == pytest.approx(r["score"]) for i, r in got.items())
    assert interpolation.score_documents(empty).count() == 0
    assert interpolation.score_documents(no_id(docs)).count() == len(pairs) + 1
    alone = interpolation.score_documents(docs.where(F.expr("crc32(cast(doc_id as string)) % 10 = 0"))).collect()
    assert alone and all(r["train_tokens"] == 0 and r["score"] <= 0 for r in alone)


@pytest.mark.parametrize(("grid", "close"), [(64, 1e-4), (interpolation.GRID, 0.01)])
def test_scores_are_those_of_plain_interpolation(spark, monkeypatch, grid, close):
    r = random.Random(8)
    text = lambda: " ".join(r.choices(["the", "of", "House", "house", "river", "stone", "a", "in", "winter", "letter"], [9, 6, 1, 2, 2, 1, 5, 4, 1, 1], k=r.randint(0, 40)))
    pairs = [(i, text()) for i in range(90)]
    pairs += [(200 + i, pairs[i][1]) for i in range(5)] + [(300, None), (301, "unseen words only here")]
    monkeypatch.setattr(interpolation, "BLOCK_TOKENS", 150)
    monkeypatch.setattr(interpolation, "GRID", grid)
    expected = brute.interpolated_scores(pairs, interpolation.role)
    got = by_id(interpolation.score_documents(spark.createDataFrame(pairs, "doc_id long, text string")))
    assert {i: r["score"] for i, r in got.items()} == {i: pytest.approx(x, rel=close) for i, x in expected.items()}


def test_weights_fit_held_out_counts():
    cell = lambda b, n, *ratios: (b, n, *(n * x for x in ratios))
    w = interpolation.learn_weights([
        cell(27, 900, 5000, 1000, 4), cell(27, 80, 0, 1000, 4), cell(27, 20, 0, 0, 0), cell(3, 900, 0, 1000, 4), cell(3, 80, 0, 0, 4), cell(3, 20, 0, 0, 0), cell(0, 50, 0, 0, 2),
    ])
    assert np.allclose(w.sum(axis=1), 1) and (w[24:] > 0).all() and (w[:24, 0] == 0).all() and (w[0] > 0).tolist() == [False, False, True, True]
    assert w[27, 0] > 0.7 and w[3, 1] > 0.8 and 0.005 < w[3, 3] < 0.1


# 7


def test_quality(docs, pairs, empty):
    got = by_id(divergence.judge_quality(docs))
    for i, t in pairs:
        r = got[i]
        assert (r["_n_words"], r["_word_chars"], r["_n_symbols"], r["_n_dup_lines"], r["_n_repeat"], r["_base_failed"]) == brute.quality(t), repr((t or "")[:60])
        assert not (r["_base_failed"] and r["_kept"])
    kept = divergence.keep_good(no_id(docs))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["_kept"]}
    assert divergence.judge_quality(empty).count() == 0 == divergence.keep_good(empty).count()


def test_verdicts_are_those_of_plain_divergence(spark):
    r = random.Random(12)
    common, rare = divergence.COMMON_WORDS[:18], ["house", "river", "Stone", "garden", "winter,", "letters", "été", "x2"]
    word = lambda share: r.choice(common).capitalize() if r.random() < 0.05 else r.choice(common) if r.random() < share else r.choice(rare) + r.choice("abcdefgh")
    rows = [(i, " ".join(word(0.5) for _ in range(r.choice([60, 70, 130, 300]))), r.choice(["en", "fr"])) for i in range(220)]
    rows += [(1000 + i, " ".join(word(0.02) for _ in range(r.choice([60, 130, 300]))), "en") for i in range(12)]
    rows += [(2000 + i, " ".join("".join(r.choice("#$%09XYZ^~") for _ in range(5)) for _ in range(120)), "fr") for i in range(6)]
    rows += [(3000, None, "en"), (3001, "", None), (3002, rows[0][1], None), (3003, rows[1][1], "xx"), (3004, "a b c " * 200, "en")]
    expected = brute.divergence(rows, divergence.COMMON_WORDS)
    got = by_id(divergence.judge_quality(spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, lang string, _n_words int")))
    for i, (c, w, kept) in expected.items():
        near = lambda x: x if x is None else pytest.approx(x, abs=1e-7)
        assert (got[i]["_char_distance"], got[i]["_word_distance"], got[i]["_kept"]) == (near(c), near(w), kept), i
    assert {k for _, _, k in expected.values()} == {True, False} and sum(expected[i][2] for i in range(1000, 1012)) < 6


def test_junk_is_told_from_prose(spark):
    r = random.Random(4)
    prose = lambda: " ".join(r.choice(["the", "of", "and", "to", "house", "river", "stone", "garden", "winter", "letters"]) for _ in range(200)).capitalize() + "."
    noise = lambda: " ".join("".join(r.choice("#$%&*!?0123456789XYZ") for _ in range(6)) for _ in range(200))
    rows = [(i, prose(), "en") for i in range(60)] + [(100 + i, noise(), "en") for i in range(5)]
    got = by_id(divergence.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_repeat_percent=100))
    assert all(r["_kept"] == (i < 100) for i, r in got.items())


def test_junk_in_ordinary_letters_is_told_by_its_words(spark):
    r = random.Random(6)
    common, rare = ["the", "of", "and", "to"], ["house", "river", "stone", "garden", "winter", "letters"]
    prose = lambda n: " ".join(r.choice(common if r.random() < 0.5 else rare) for _ in range(n))
    junk = lambda n: " ".join(r.choice(rare) for _ in range(n))
    rows = [(i, prose(60 if i % 2 else 150), "en") for i in range(200)] + [(1000 + i, junk(60 if i % 2 else 150), "en") for i in range(6)]
    got = by_id(divergence.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_repeat_percent=100))
    assert all(r["_char_distance"] < 0.172 for r in got.values()) and all(r["_kept"] == (i < 1000) for i, r in got.items())


def test_js_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.4, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    expected = ((kl(p) + kl(q)) / 2) ** 0.5
    row = spark.range(1).select(
        divergence.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d"),
        divergence.js_distance_sparse(F.array(F.lit(0), F.lit(1)), F.array(F.lit(0.5), F.lit(0.5)), F.array(*map(F.lit, q))).alias("s"),
    ).first()
    assert row["d"] == pytest.approx(expected) == row["s"]


# 8


def test_suffix_dedup(docs, pairs, empty, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 700)
    expected = brute.repeats(pairs)

    def check():
        got = by_id(suffix_dedup.remove_repeats(docs))
        assert {i: (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for i, r in got.items()} == expected
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got.values())

    check()
    monkeypatch.setattr(suffix_dedup, "HOT", 5)  # anchors split into single strings
    check()
    assert suffix_dedup.remove_repeats(empty).count() == 0
    late = suffix_dedup.remove_repeats(no_id(docs, dict(pairs)[31])).where("doc_id is null").first()
    assert late["n_removed"] == late["n_bytes"] > 0


def test_column_wise_is_the_suffix_order():
    r = random.Random(6)
    strings = [bytes(r.choice(b"ab\xff\x00") for _ in range(30)) for _ in range(40)] + [b"abab" * 7 + b"ab"] * 2 + [b"\x00" * 30] * 3
    seen = set()
    for at, order, prefix in suffix_dedup.column_wise(np.array([list(s) for s in strings], np.uint8), 9):
        seen.add(at)
        expected = sorted((s[at:], f) for f, s in enumerate(strings))
        assert [f for _, f in expected] == order.tolist()
        assert prefix[0] == 0
        for k in range(1, len(expected)):
            a, b = expected[k - 1][0], expected[k][0]
            common = next((j for j, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))
            assert prefix[k] == min(common, 9)
    assert seen == set(range(30))
    assert not list(suffix_dedup.column_wise(np.empty((0, 0), np.uint8), 9))


def test_dealt_tasks_have_one_number_each(spark):
    from quern.llm.common import seat

    rows = spark.range(37).repartition(37, seat(F.col("id"), 37)).select("id", F.spark_partition_id().alias("p")).collect()
    assert all(r["id"] == r["p"] for r in rows)


# 9

RULES = [*queries.URL_RULES, ("block", "example.net/en/x"), ("block", "tie.org/a/"), ("allow", "tie.org/a/"), ("block", "bare.com")]


def test_urls(spark):
    hosts = ["a.example.net", "example.net", "EXAMPLE.com", "notexample.com", "x.y.org", "net", "tie.org", "bare.com", "s.bare.com", ""]
    tails = ["", "/", "/en/", "/en/x", "/EN/", "/de/1?q=/fr/", "?x", "#f", "/fr/#", "/a/b", "//", "/fr"]
    urls = [f"{p}{h}{t}" for h in hosts for t in tails for p in ("http://", "")] + [None, "", "://", "a://b.org/fr/://c.net/", "http://u@h.net/"]
    rows = [(i, u, "c", 1) for i, u in enumerate(urls)] + [(0, urls[0], "c", 1), (None, "http://a.net/", "c", 2)]
    got = url_rules.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule int"), url_rules.rules_table(spark, RULES)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None:
            host, path, rule, verdict = brute.url(urls[r["page_id"]], RULES)
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    assert {r["verdict"] for r in url_rules.judge_urls(pages, url_rules.rules_table(spark, RULES).limit(0)).collect()} == {"allow"}
    assert url_rules.judge_urls(pages.limit(0), url_rules.rules_table(spark, RULES)).count() == 0


def test_urls_meet_on_the_short_prefix_alone(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    judged = url_rules.judge_urls(pages, url_rules.rules_table(spark, RULES), prefix_digits=1)  # nearly all prefixes collide
    assert [r["verdict"] for r in judged.collect()] == ["block"]
    plan = judged._jdf.queryExecution().executedPlan().toString()
    join = next(x for x in plan.splitlines() if "HashJoin" in x)
    assert re.search(r"bigint\)\], \[short#\d+L\], LeftOuter", join) and "StartsWith(_digest" in join


# 10


def test_lines(docs, pairs, empty):
    got = by_id(line_runs.dedup_lines(docs))
    expected = brute.lines(pairs)
    assert {i: (r["_n_lines"], r["_n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for i, r in got.items()} == expected
    assert any(n for _, n, _ in expected.values())
    assert line_runs.dedup_lines(empty).count() == 0
    rows = no_id(docs.unionByName(docs.limit(4)))
    assert line_runs.dedup_lines(rows).count() == rows.count()
    assert line_runs.dedup_lines(docs).drop("_n_lines", "_n_dropped").columns == docs.columns


def made_lines(spark, ids):
    return line_runs.keyed_lines(spark.createDataFrame([(i, f"line number {i % 5} of the text") for i in ids], "doc_id long, text string"), "doc_id", "text", 5)


def run_keys(lines):
    return lines.groupBy("h1", "h2").agg(F.max("doc").alias("last_doc"))


def test_runs_compact_and_a_later_batch_goes_on_from_them(spark):
    path = Work(spark, "test-runs").path
    runs = line_runs.LineRuns(spark, path, fan_out=2)
    for k in range(5):
        runs.add(made_lines(spark, range(10 * k, 10 * k + 4)))
        if k == 2:
            runs.close()
            runs = line_runs.LineRuns(spark, path)  # opened again, by its manifest
            assert [len(x) for x in runs.levels] == [1, 1]
    assert len(runs.levels) == 3 and [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted((r["n_docs"], r["last_doc"]) for r in runs.merged().collect()) == [(5, 40), (5, 41), (5, 42), (5, 43)]
    # a merge needs no shuffle
    merge = runs._merged([n for level in runs.levels for n in level])
    assert "Exchange" not in merge._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["n_docs"], r["last_doc"]) for r in merge.collect()) == [(5, 40), (5, 41), (5, 42), (5, 43)]
    runs.close()


def test_each_batch_adds_only_keys_that_are_not_settled(spark):
    runs = line_runs.LineRuns(spark, Work(spark, "test-runs").path, fan_out=9, enough=2)
    runs.add(made_lines(spark, [100, 105, 101]))  # key 0 in two documents, key 1 in one
    batch = made_lines(spark, [50, 51, 52])
    assert sorted(r["last_doc"] for r in runs.unseen(run_keys(batch)).collect()) == [51, 52]
    runs.add(batch)
    assert sorted((r["n_docs"], r["last_doc"]) for r in runs.merged().collect()) == [(1, 52), (2, 101), (2, 105)]
    # a larger id is not left out, whatever the order of batches
    runs.add(made_lines(spark, [200]))
    assert sorted((r["n_docs"], r["last_doc"]) for r in runs.merged().collect()) == [(1, 52), (2, 101), (3, 200)]
    runs.close()


@pytest.mark.parametrize("batches", [1, 5])
def test_lines_in_any_number_of_batches(docs, pairs, batches):
    got = by_id(line_runs.dedup_lines(docs, batches=batches))
    assert {i: (r["_n_lines"], r["_n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for i, r in got.items()} == brute.lines(pairs)


def test_lines_of_text_ids_and_clashing_names(spark):
    rows = [(k, "a line that all documents hold\nown line of " + k, 1, 2) for k in "abcd"]
    got = line_runs.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string, _n_lines int, pos int"))
    assert got.columns == ["doc_id", "text", "pos", "_n_lines", "_n_dropped"]
    assert {r["doc_id"]: r["_n_dropped"] for r in got.collect()} == {"a": 1, "b": 1, "c": 1, "d": 0}


# pipeline


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    at, seen = docs.select(*corpus_pipeline.COLUMNS), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, str(tmp_path)).collect(), at.schema)
        assert at.columns == corpus_pipeline.COLUMNS, name
        seen.append(at)
    pairs = [(r["doc_id"], r["text"]) for r in seen[0].collect()]
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in seen[1].collect()} == {i: h for i, (_, _, h) in brute.lines(pairs).items()}
    near = brute.near_duplicates([(r["doc_id"], r["text"]) for r in seen[1].collect()], 5, 80)
    assert {r["doc_id"] for r in seen[2].collect()} == {i for i, (_, c) in near.items() if i == c}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in seen[3].collect()], 2048)


def test_pipeline_stages_stand_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _gone int, batch int, q_row int, node int, doc int"
    good = "The house of the river and the garden in winter was of stone, and it is not that which he had for the year. "
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, good * 1 + " ".join(f"word{k} of" for k in range(60)), "en", "a")]
    rows += [rows[-1], (None, rows[-1][1], "en", None), (5, "x " * 30000, "fr", "b")]
    for given in ([], [(*r, 0, 1, 2, 3, 4, 5) for r in rows]):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert name == "pack" or out.columns == corpus_pipeline.COLUMNS
            assert bool(n) == bool(given), name
            if given:
                assert {"quality_rules": n == 3, "line_dedup": n == 6, "near_dedup": n == 6, "mix": n >= 5, "pack": n >= 6}[name], (name, n)
