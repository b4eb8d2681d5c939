"""The training-data operators against brute force, round trips and held-out labels, with odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same
from pyspark.sql import functions as F

from tracelake.llm import ann, attention, chat, fingerprints, fixity, lm, mixing, near_dedup, packing, quality, queries, token_counts
from tracelake.llm.tokenizers_cache import byte_bpe, piece_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, size long, key long, id long"
ODD = [None, "", " \t\n", "One", "One two", "one  TWO\nthree", "naïve café <|endoftext|> ▁x  y ", "a " * 3000, "日本語 テキスト" * 50, "x" * 5000]


def docs(spark, texts, sources=("a", "b", None)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or ""), 1, 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(n=60, seed=1):
    r = random.Random(seed)
    words = [f"w{r.randrange(40)}" for _ in range(200)]
    out = [" ".join(r.choice(words) for _ in range(r.randrange(3, 60))) for _ in range(n)]
    return out + out[:5] + [f"{t} end" for t in out[5:12]] + ODD + ODD[:4]


def words_of(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("run", [lm.lm_scores, mixing.mix_sizes, mixing.mix_documents, token_counts.token_counts, fingerprints.fingerprints, packing.pack_documents, near_dedup.near_duplicates, near_dedup.keep_one], ids=lambda f: f.__name__)
def test_empty_tables_and_null_ids(spark, run):
    empty = docs(spark, ["x"]).limit(0)
    assert run(empty).count() == 0
    rows = docs(spark, ODD).withColumn("doc_id", F.when(F.col("doc_id") < 5, F.col("doc_id")))
    assert run(rows.unionByName(rows)).count() >= 1


def test_lm_scores(spark):
    rows = docs(spark, corpus())
    have = {r.doc_id: r for r in lm.lm_scores(rows).collect()}
    texts = {r.doc_id: r.text for r in rows.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, t in texts.items() if not out[i] for w in [*words_of(t), None])
    n, kinds = sum(count.values()), len(count)
    assert len(have) == len(texts)
    for i, t in texts.items():
        tokens = [*words_of(t), None]
        assert (have[i].held_out, have[i].n_tokens, have[i].train_tokens) == (out[i], len(tokens), n)
        assert have[i].n_known == sum(count[w] > 0 for w in tokens)
        assert math.isclose(have[i].base_score, sum(math.log10((count[w] + 1) / (n + kinds + 1)) for w in tokens), rel_tol=1e-9)
        assert have[i].score < 0
    few = {r.doc_id: r.score for r in lm.lm_scores(rows).collect()}
    assert all(math.isclose(few[i], have[i].score, rel_tol=1e-9) for i in few)


def naive_probabilities(model, ids):
    """The probability of every id after ``ids``, by loops over one window, in double precision."""
    x = model.embed[ids].astype(float) + model.place[: len(ids)]
    q, k, v = np.split(x @ model.qkv.astype(float), 3, axis=1)
    a = np.array([math.exp(float(np.clip(q[-1] @ k[j], -attention.BOUND, attention.BOUND))) for j in range(len(ids))])
    h = np.append(np.clip(x[-1] + (a[:, None] * v).sum(axis=0) / a.sum(), -model.most(), model.most()), 1.0)
    groups = np.exp(h @ model.to_group)
    members = np.exp(h @ model.to_class)
    each = groups[:, None] / groups.sum() * members / members.sum(axis=1, keepdims=True)
    return each[model.of_group, model.of_class] * np.exp(model.within.astype(float))


@pytest.fixture(scope="module")
def trained():
    """A model after a little training, and the word table it belongs to."""
    texts = [words_of(t) for t in corpus()]
    hot = lm.WordTable.of({w: n for w, n in Counter(w for t in texts for w in t).most_common(30)}, len(texts))
    ids = hot.look_up([w for t in texts for w in (*t, None)])[2]
    model = attention.untrained(np.bincount(ids, minlength=lm.VOCABULARY_SIZE), lm.word_starts())
    attention.improve(model, [np.append(lm.END, ids)] * 3, lm.END)
    return model, hot


def test_attention_gives_probabilities(trained):
    model, _ = trained
    r = np.random.default_rng(3)
    windows = r.integers(0, lm.VOCABULARY_SIZE, (2, 9))
    for row in windows:
        want = naive_probabilities(model, row)
        assert math.isclose(want.sum(), 1, rel_tol=1e-5)
        targets = np.array([0, 5, 200, 3000, 50_000, lm.END])
        ids = np.repeat(row[None], len(targets), axis=0)
        logs, border = model.log_prob(ids, np.repeat(targets[:, None], 9, axis=1))
        assert np.allclose(np.exp(logs[:, -1]), want[targets], rtol=1e-3)
        assert np.allclose(np.exp(border[:, -1]), want[lm.word_starts()].sum(), rtol=1e-4)


def test_gradients_are_those_of_the_loss(trained):
    model = trained[0].of_rows(trained[0].rows())
    r = np.random.default_rng(4)
    ids, targets = r.integers(0, 2000, (3, 7)), r.integers(0, 2000, (3, 7))
    real = r.random((3, 7)) < 0.8
    found = model.gradients(ids, targets, real)
    rows, g = found["embed"]
    dense = {w: found[w] for w in ("place", "qkv", "to_group", "to_class")} | {"embed": np.zeros_like(model.embed)}
    dense["embed"][rows] = g
    loss = lambda: -model.log_prob(ids, targets)[0][real].astype(float).mean()
    for name, gradient in dense.items():
        weights = getattr(model, name)
        for at in np.argsort(-np.abs(gradient), axis=None)[:5].tolist():
            kept, step = weights.flat[at], np.float32(2e-2)
            weights.flat[at] = kept + step
            up = loss()
            weights.flat[at] = kept - step
            down = loss()
            weights.flat[at] = kept
            assert math.isclose((up - down) / (2 * float(step)), gradient.flat[at], rel_tol=0.03, abs_tol=2e-4), name


def test_states_are_bounded_where_they_have_to_be(trained):
    model, ids = trained[0].of_rows(trained[0].rows()), np.random.default_rng(5).integers(0, 2000, (3, 7))
    assert model.states(ids)[-2] is None
    model.embed *= 100 * float(model.most()) / np.abs(model.embed[ids]).max()
    *_, free, h = model.states(ids)
    assert np.array_equal(free, np.abs(h[:, : attention.WIDTH]) < model.most()) and 0 < free.sum() < free.size and np.abs(h[:, : attention.WIDTH]).max() == model.most()
    found = model.gradients(ids, np.roll(ids, -1, axis=1), np.ones(ids.shape, bool))
    assert all(np.isfinite(g).all() for name, g in found.items() if name != "embed") and np.isfinite(found["embed"][1]).all()


def test_a_score_is_the_logarithm_of_a_probability(trained):
    model, hot = trained
    total = int(hot.counts.sum())
    scorer = lm.Scorer(model, hot, total, len(hot.counts), 0.3)
    texts = ["w1 w2 w7", None, "unseen words here", "w3 " * 40 + "naïve", "日本"]
    found = list(scorer.table(texts))
    starts = lm.word_starts()
    for text, row in zip(texts, found, strict=True):
        tokens = [*words_of(text), None]
        ids = [lm.END]
        logs = []
        for token in tokens:
            parts = [lm.END] if token is None else lm.subwords([token])[0].tolist()
            p = 1.0
            for i, part in enumerate(parts):
                # Only what one window holds can be seen.
                at = len(ids) - 1
                fresh = attention.WINDOW - attention.CONTEXT
                begin = 0 if at < attention.WINDOW else ((at - attention.CONTEXT) // fresh) * fresh
                each = naive_probabilities(model, np.array(ids[begin:]))
                p *= each[part] / (each[starts].sum() if i == 0 else 1)
                ids.append(part)
            if token is not None:
                at = len(ids) - 1
                begin = 0 if at < attention.WINDOW else ((at - attention.CONTEXT) // fresh) * fresh
                p *= naive_probabilities(model, np.array(ids[begin:]))[starts].sum()
            logs.append((p, hot.counts[hot.place[token]] if token in hot.place else None))
        known = [(p, n) for p, n in logs if n is not None]
        assert row[0] == len(tokens) and row[1] == len(known)
        assert math.isclose(row[3], sum(math.log10(0.3 * n / total + 0.7 * p) for p, n in known), rel_tol=1e-3)
        assert np.allclose(row[5], [math.log(p) for p, n in logs if n is None], rtol=1e-3)
    # Over one-subword words, and all else that a beginning can go on to, probabilities sum to one.
    each = naive_probabilities(model, np.array([lm.END]))
    first = each[starts] / each[starts].sum()
    assert math.isclose(first.sum(), 1, rel_tol=1e-6)


def test_lm_beats_its_base_on_held_out_texts(spark):
    row = queries.op1_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def test_how_models_mix_is_set_on_every_training_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 20)
    rows = docs(spark, corpus(60))
    learnt = rows.where(~lm.held_out(F.col("doc_id"))).persist()
    counted = token_counts.frequencies(learnt, lm.words).persist()
    given, plain = [], lm.best_share
    monkeypatch.setattr(lm, "best_share", lambda texts, *rest: given.append(texts.count()) or plain(texts, *rest))
    scorer = lm.fit(rows, counted, learnt.count())
    assert given == [learnt.count()]
    texts = [words_of(r.text) for r in learnt.collect()]
    count = Counter(w for t in texts for w in [*t, None])
    hot, logs, _ = scorer.by_parts(texts)
    left = np.array([count[w] - 1 for t in texts for w in [*t, None]]) / (scorer.total - 1)
    assert 0 < (hot < 0).sum() < len(hot) and scorer.total == len(hot)
    want = [np.where(left > 0, np.log(s * np.maximum(left, 1e-9) + (1 - s) * np.exp(logs)), math.log1p(-s) + logs).sum() for s in lm.SHARES]
    assert scorer.share == lm.SHARES[int(np.argmax(want))]
    monkeypatch.setattr(lm, "SHARES", [scorer.share])
    assert lm.best_share(learnt, counted, scorer) == scorer.share and lm.best_share(learnt.limit(0), counted, scorer) == 0.5


def test_lm_windows_score_each_subword_once():
    r = np.random.default_rng(1)
    model = attention.untrained(r.integers(0, 9, lm.VOCABULARY_SIZE), lm.word_starts())
    lengths = [1, 31, 32, 33, 100]
    flat = np.concatenate([np.append(r.integers(0, 1000, n - 1), lm.END) for n in lengths])
    ends = np.cumsum(lengths)
    have, border = attention.log_probs(model, flat, ends, lm.END)
    for begin, end in zip([0, *ends[:-1]], ends, strict=True):
        ids = flat[begin:end]
        before = np.append(lm.END, ids[:-1])
        for i in range(len(ids)):
            # The window that scores position i begins at a multiple of what is fresh in a window.
            fresh = attention.WINDOW - attention.CONTEXT
            start = 0 if i < attention.WINDOW else ((i - attention.CONTEXT) // fresh) * fresh
            want, ended = model.log_prob(before[None, start : i + 1], ids[None, start : i + 1])
            assert math.isclose(have[begin + i], want[0, -1], rel_tol=1e-4, abs_tol=1e-4)
            assert math.isclose(border[begin + i], ended[0, -1], rel_tol=1e-4, abs_tol=1e-4)


def test_context_is_not_predicted_again(monkeypatch):
    r = np.random.default_rng(1)
    model = attention.untrained(r.integers(0, 9, lm.VOCABULARY_SIZE), lm.word_starts())
    rows, plain = [], attention.Attention._heads
    monkeypatch.setattr(attention.Attention, "_heads", lambda self, h, *rest: rows.append(len(h)) or plain(self, h, *rest))
    attention.log_probs(model, r.integers(0, 1000, 100), np.array([100]), lm.END)
    fresh = attention.WINDOW - attention.CONTEXT
    assert sum(rows) == attention.WINDOW + fresh * -(-(100 - attention.WINDOW) // fresh)


def test_log_sums_are_those_of_single_words():
    r = np.random.default_rng(2)
    sizes = np.array([1, 16, 0, 17, 300])
    known, likely = r.random(sizes.sum()) * 1e-9 + 1e-12, np.exp(-40 * r.random(sizes.sum()))
    have = lm.log_sums(known, likely, sizes, lm.SHARES)
    for row, begin, end in zip(have, np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
        want = [np.log(s * known[begin:end] + (1 - s) * likely[begin:end]).sum() for s in lm.SHARES]
        assert np.allclose(row, want, rtol=1e-12, atol=1e-9)


def test_texts_are_attended_to_once(spark):
    rows = docs(spark, corpus(60))
    # The attention's logarithms were written when the share was set: what is left are joins and sums of them.
    assert "MapInArrow" not in lm.lm_scores(rows)._jdf.queryExecution().toString()
    learnt = rows.where(~lm.held_out(F.col("doc_id")))
    counted = token_counts.frequencies(learnt, lm.words).persist()
    scorer, found, rare = lm.fit_and_attend(rows, counted, learnt.count())
    assert found.count() == rows.count()
    assert scorer.share == lm.best_share(learnt, counted, scorer) == lm.best_share(found.where("learnt"), counted, scorer, rare)


def test_attention_learns_from_every_training_text(spark):
    rows = docs(spark, corpus()).withColumn("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("doc_id")))
    rows = rows.unionByName(rows.limit(7)).repartition(5).select("text")
    texts = [r.text for r in rows.collect()]
    hot = lm.WordTable.of(dict(Counter(w for t in texts for w in words_of(t)).most_common(9)), len(texts))
    table = lm.encoded(rows, hot, 3).persist()
    assert {r["round"] for r in table.select("round").collect()} == {0, 1, 2}
    have = np.concatenate([np.frombuffer(r.ids, "<u2") for r in table.collect()])
    have = Counter(tuple(x.tolist()) for x in np.split(have, np.flatnonzero(have == lm.END) + 1)[:-1])
    assert have == Counter(tuple([*lm.subwords(words_of(t))[0].tolist(), lm.END]) for t in texts)
    counts = lm.id_counts(table)
    assert counts.tolist() == np.bincount([i for t, n in have.items() for i in t * n], minlength=lm.VOCABULARY_SIZE).tolist()
    before = attention.untrained(counts, lm.word_starts())
    assert all(np.array_equal(getattr(before.of_rows(before.rows()), w), getattr(before, w)) for w in before.WEIGHTS)
    after = lm.learn(table, before, 3, 2)
    # Each id that stands before another was learnt from, and no other.
    changed = (after.embed != before.embed).any(axis=1)
    assert np.array_equal(np.flatnonzero(changed), np.flatnonzero(counts))
    flat, ends = np.array([i for t in have for i in t]), np.cumsum([len(t) for t in have])
    told = [attention.log_probs(m, flat, ends, lm.END)[0].mean() for m in (before, after)]
    assert told[1] > told[0]
    assert np.array_equal(lm.learn(table.limit(0), before, 2).rows(), before.rows())


@pytest.mark.parametrize("n", [2, 20, 33, 34, 100])
def test_training_learns_the_end_of_a_run(n):
    ids = np.random.default_rng(n).integers(0, 1000, n).astype(np.int32)
    model = attention.untrained(np.bincount(ids, minlength=lm.VOCABULARY_SIZE), lm.word_starts())
    before = model.of_rows(model.rows())
    seen, windows = attention.improve(model, iter([ids]), lm.END)
    assert np.array_equal(seen, np.bincount(ids[:-1], minlength=lm.VOCABULARY_SIZE)) and windows == -(-(n - 1) // attention.WINDOW)
    changed = (model.embed != before.embed).any(axis=1)
    assert set(np.flatnonzero(changed)) <= set(ids[:-1].tolist()) and changed[ids[-2]]


def test_word_table_gives_what_encoding_gives():
    text = words_of(corpus()[-5] + " odd space 日本 naïve " + " ".join(corpus()[:5]))
    hot = {w: k + 1 for k, w in enumerate(sorted(set(text))[::2])}
    counts, sizes, ids = lm.WordTable.of(hot, 7).look_up([*text, None])
    want = [lm.subwords([w])[0].tolist() for w in text] + [[lm.END]]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, []) and counts.tolist() == [*(hot.get(w, -1) for w in text), 7]


def brute_neighbours(rows, queries_, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {q: [int(ids[j]) for j in sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(float(unit[j] @ unit[i]), 12), ids[j]))[:k]] for i, q in enumerate(ids.tolist()) if q in queries_}


def test_search_reaches_the_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding) and any(r.embedding)]
    want = brute_neighbours(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    have = {}
    for r in queries.op2_inverted_multi_index(spark, sf_dir).orderBy("query_id", "rank").collect():
        have.setdefault(r.query_id, []).append(r.vec_id)
    assert have.keys() == want.keys() and all(len(v) == 5 for v in have.values())
    assert sum(len(set(have[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_search_visiting_all_is_exact(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(6)]) for i in range(200)]
    rows = [(i, v if any(v) else [1.0] * 6) for i, v in rows] + [(200 + i, rows[0][1]) for i in range(20)]
    odd = [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, [1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    vectors = ann.valid_vectors(df, "vec_id", "embedding")
    found = ann.search(vectors, F.col("id") % 50 == 0, 5, visits=10**6, k_centroids=4).orderBy("query_id", "rank").collect()
    have = {}
    for x in found:
        have.setdefault(x.query_id, []).append(x.vec_id)
    assert have == brute_neighbours(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    assert ann.search(vectors.limit(0), F.col("id") % 50 == 0).count() == 0
    assert ann.search(vectors.where("id < 3"), F.col("id") == 0, 5).count() == 2


def test_of_equal_vectors_only_the_least_rows_are_entries(spark):
    same = [1.0, 2.0, -3.0]
    rows = [(i, same) for i in range(40)] * 2 + [(3, [0.0, 1.0, 0.0])] * 9 + [(4, [0.0, 1.0, -0.0]), (50, [0.5, 1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    held = Counter((r.id, *(x + 0.0 for x in r.vector)) for r in ann.least_rows(vectors, 2).collect())
    assert held == Counter({(0, *same): 2, (1, *same): 2, (2, *same): 2, (3, 0.0, 1.0, 0.0): 2, (4, 0.0, 1.0, 0.0): 1, (50, 0.5, 1.0, 0.0): 1})
    have = {}
    for x in ann.search(vectors, F.col("id").isin(0, 1, 39, 50), 2, visits=10**6, k_centroids=2).select("query_id", "rank", "vec_id").distinct().orderBy("query_id", "rank").collect():
        have.setdefault(x.query_id, []).append(x.vec_id)
    # A query that stands twice is one here; of its own id nothing is found, of others a row for each copy.
    assert have == {0: [1, 1], 1: [0, 0], 39: [0, 0], 50: [3, 3]}


def test_recall_holds_where_half_of_the_vectors_are_equal(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 16))
    x = centres[r.integers(0, 40, 3000)] + 0.4 * r.normal(size=(3000, 16))
    x[r.permutation(3000)[:1500]] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").persist()
    assert ann.least_rows(vectors, 5).count() == 3000 - 1501 + 6 - (1500 - int((x == x[0]).all(axis=1).sum()) + 1)
    want = brute_neighbours(rows, set(range(0, 3000, 20)), 5)
    have = {}
    for f in ann.search(vectors, F.col("id") % 20 == 0, 5).collect():
        have.setdefault(f.query_id, set()).add(f.vec_id)
    assert sum(len(have[q] & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_heap_visits_cells_in_order_of_distance():
    r = np.random.default_rng(2)
    near, far = r.random(7), r.random(5)
    cells = ann.traverse(near, far, np.ones(35, np.int64), 35)
    sums = [near[c // 5] + far[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums)


def test_mix_meets_its_targets(spark):
    rows = docs(spark, corpus(), ("x",) * 9 + ("y", None))
    out = mixing.mix_sizes(rows).collect()
    assert sorted(tuple(r) for r in mixing.mix_sizes(rows.repartition(5)).collect()) == sorted(tuple(r) for r in out)
    texts = {r.doc_id: r for r in rows.collect()}
    sums, targets = Counter(), {}
    for r in out:
        assert r.taken <= 3 * r.size == 3 * len(words_of(texts[r.doc_id].text))
        sums[texts[r.doc_id].source] += r.taken
        targets[texts[r.doc_id].source] = r.target
    assert all(abs(sums[s] - t) < 10 for s, t in targets.items())


def test_audit_finds_what_differs(spark):
    pages = spark.createDataFrame([(i % 700, f"u{i}", "h" * (i % 90)) for i in range(1500)] + [(None, None, None)] * 2, "page_id long, url string, html string")
    records = fixity.manifest(pages).persist()
    assert records.count() == 1501
    lengths = {(r.archive, r.offset): r.length for r in records.collect()}
    assert len(lengths) == 1501 and all((a, o + n) in lengths or not any(b == a and p > o for b, p in lengths) for (a, o), n in list(lengths.items())[:50])
    assert fixity.audit(records, records).count() == 0 and fixity.audit(records.limit(0), records.limit(0)).count() == 0
    other = records.where("record_id <> 44 or record_id is null").withColumn("digest", F.when(F.col("record_id") == 7, "x").otherwise(F.col("digest")))
    status = Counter((r.record_id, r.status) for r in fixity.audit(records, other).collect())
    assert status == Counter({(7, "changed"): 3, (44, "missing"): 3} if records.where("record_id = 7").count() == 3 else {(7, "changed"): 2, (44, "missing"): 2})
    assert {r.status for r in fixity.audit(other, records).where("record_id = 44").collect()} == {"extra"}


def test_token_counts(spark):
    texts = corpus()
    sp = piece_model(token_counts.MODEL)
    have = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs(spark, texts), hot=20).collect()}
    want = {i: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in enumerate(texts)}
    assert have == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from([*"ab A▁.\n\té日'<|>s1 \u00a0\u3000\u2028\u0085\x00\ufeff\u200d\u0301\x1c\x1f\r👩"]), max_size=30), st.sampled_from(["", "<|endoftext|>", "  "]))
def test_tokenizers_agree(text, more):
    text = text + more + text[::-1]
    import public_tokenizers
    from tokenizers import Tokenizer

    sp = piece_model(token_counts.MODEL)
    tokens = token_counts.pre_tokens(text)
    assert sum(len(sp.encode(t)) if t else 1 for t in tokens) == len(sp.encode(text))
    global _json
    _json = globals().get("_json") or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert byte_bpe("byte_bpe_50k")(text).tolist() == _json.encode(text, add_special_tokens=False).ids


def test_preference_pairs(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 0, None, None), (None, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    other = spark.createDataFrame([(1, 0, "user", "q"), (1, 5, "assistant", "b"), (2, 0, "user", ""), (3, 0, "user", "only here")], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.preference_pairs(turns, other).collect()}
    assert set(rows) == {1, 2} and rows[1].n_common == 1 and rows[1].prompt == "<|user|>\nq<|end|>\n"
    assert [tuple(p) for p in rows[1].rejected] == [("<|assistant|>\n", False), ("b<|end|>\n", True)]
    assert rows[2].n_common == 1 and rows[2].chosen == [] and rows[2].rejected == []
    assert chat.preference_pairs(turns.limit(0), other).count() == 0


def test_fingerprints(spark):
    texts = corpus()
    have = {r.doc_id: r for r in fingerprints.fingerprints(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        new = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = have[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        both = lambda a, b: (Counter(fingerprints.paragraphs(a).tolist()), Counter(fingerprints.paragraphs(b).tolist()))
        for other, near in ((new, r.near_edited), (after, r.near_next)):
            a, b = both(t, other)
            shared, total = (a & b).total(), (a | b).total()
            assert math.isclose(near, shared / total if total else 1.0)
    same = {}
    assert all(same.setdefault(t or "", have[i].fingerprint) == have[i].fingerprint for i, t in enumerate(texts))


def test_peeling_recovers_differences_and_retries_larger():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 3, 40, 900)]
    for a, b in zip(sets, [sets[0], sets[1][1:], np.append(sets[2][5:], sets[1]), sets[1]], strict=True):
        only = fingerprints.differences([a], [b])[0]
        assert set(only[0].tolist()) == set(a.tolist()) - set(b.tolist()) and set(only[1].tolist()) == set(b.tolist()) - set(a.tolist())


def test_ranges_spread_documents(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    sizes = [r["count"] for r in fingerprints.successive(rows, 20_000).groupBy("range").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 600


def test_quality_of_held_out_documents(spark):
    path = "/root/testdata/sf0.1"
    scored = quality.quality_scores(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality")
    right = scored.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.9
    rows, none = docs(spark, ODD), labels.limit(0)
    assert {r.score for r in quality.quality_scores(rows, none).collect()} == {0.5} and quality.quality_scores(rows.limit(0), none).count() == 0


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    texts = corpus()
    rows = packing.pack_documents(docs(spark, texts)).collect()
    ids = {i: [*encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    used = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.length <= 1024
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, all_ids in ids.items():
        mine = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == i)
        assert [p for p, _, _ in mine] == list(range(len(mine))) and sum(n for _, _, n in mine) == len(all_ids) and all(n == 1024 for _, _, n in mine[1:])
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(used) <= sum(map(len, ids.values())) / 1024 + 1.5


def test_best_fit_takes_the_tightest_sequence():
    r = np.random.default_rng(0)
    lengths = r.integers(1, 101, 300)
    at, offset = packing.best_fit(lengths, 100)
    room: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        able = [c for c in room.values() if c >= need]
        assert (100 - offset[i]) == (min(able) if able else 100)
        room[int(at[i])] = 100 - int(offset[i]) - need


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    r = random.Random(7)
    base = [f"v{r.randrange(500)}" for _ in range(60)]
    texts = corpus(40)
    for k in range(40):  # a chain of near copies
        base[r.randrange(60)] = f"n{k}"
        texts.append(" ".join(base))
    rows = docs(spark, texts)
    have = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(rows, size=size).collect()}
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    assert have == {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}


@pytest.mark.parametrize("ids", [True, False])
def test_a_class_has_one_set_however_often_its_rows_occur(spark, ids):
    texts = [(k if ids else None, f"text {k}") for k in range(12)] * 2
    rows = near_dedup.numbered(spark.createDataFrame(texts, "doc_id long, text string"))
    first = {r.text: r._row for r in rows.orderBy(F.desc("_row")).collect()}
    wanted = spark.createDataFrame([(k, first[f"text {k}"]) for k in range(12)], "cid long, rep long")
    assert sorted(r.cid for r in near_dedup.class_sets(rows, wanted, 1).collect()) == list(range(12))


def test_repeated_rows_of_a_large_bucket_are_linked(spark, monkeypatch):
    r = random.Random(5)
    # Neighbours are similar enough, others are not; in one bucket, whose stars reach only some of them.
    words = [f"u{r.random()}" for _ in range(300)]
    texts = [" ".join(words[10 * k : 10 * k + 100]) for k in range(12)]
    monkeypatch.setattr(near_dedup, "BANDS", 1)
    monkeypatch.setattr(near_dedup, "signature", lambda hashes: np.ones(near_dedup.ROWS, np.uint64))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "doc_id long, text string")
    out = near_dedup.near_duplicates(rows, size=1).collect()
    assert len(out) == 24 and {x.component_id for x in out} == {0} and sum(x.kept for x in out) == 1


def test_no_join_on_a_bucket_or_shingle_has_an_aggregate_on_it(spark, monkeypatch):
    """Such a side has one partition a key, which adaptive execution can't split where the key is hot."""
    plans, write = [], near_dedup.materialise

    def watched(df, name, by=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString().splitlines())
        return write(df, name, by)

    monkeypatch.setattr(near_dedup, "materialise", watched)
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = docs(spark, corpus(60))
        near_dedup.near_duplicates(rows, size=2).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joined = 0
    for plan in plans:
        for above, line, below in zip(plan, plan[1:], plan[2:], strict=False):
            if re.search(r"Sort \[(bucket|shingle)#\d+L? ASC", line) and "SortAggregate" not in above:
                joined += 1
                assert "Exchange hashpartitioning" in below, "\n".join(plan)
    assert joined >= 8


def test_keep_one_keeps_one_row_of_each_component(spark):
    def group(g):
        words = [f"{g}{i}" for i in range(200)]
        return " ".join(words[:100]), " ".join([*words[:99], "z"]), " ".join(words[100:])

    (a, near_a, _), (b, near_b, _), (c, near_c, _), (d, near_d, other) = map(group, "abcd")
    rows = [(1, a)] * 3 + [(2, near_a)] * 2 + [(None, b), (None, near_b), (None, b)] + [(None, c), (7, near_c), (None, c)] + [(11, d), (12, near_d), (12, other)] + [(20, "")] * 2 + [(None, None)]
    kept = Counter((x.doc_id, x.text) for x in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept.pop((None, b), 0) + kept.pop((None, near_b), 0) == 1
    assert kept == Counter({(1, a): 1, (7, near_c): 1, (11, d): 1, (12, other): 1, (20, ""): 2, (None, None): 1})
