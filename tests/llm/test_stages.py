"""Columns of any name, missing and repeated ids, held-out recall, the additive model by hand, and the whole pipeline in plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_neighbours, corpus, docs, words_of

import corpus_pipeline
from tracelake.llm import ann, fingerprints, fixity, mixing, near_dedup, packing, quality, token_counts
from tracelake.llm.tokenizers_cache import byte_bpe, piece_model

CLASHES = ["size", "_size", "key", "plan", "take", "epochs", "cut_key", "cut_words", "target", "row", "_row", "gone", "_gone", "_score", "score", "group", "_group", "component_id", "a.b", "kept", "part"]


def plain(rows):
    return Counter(tuple(r.values()) for r in rows)


@pytest.mark.parametrize("run", [mixing.mix_documents, near_dedup.keep_one, lambda d: quality.accepted(d, d.select("doc_id", F.lit(1).alias("quality")).limit(3))], ids=["mix_documents", "keep_one", "accepted"])
def test_columns_of_any_name_pass_through(spark, run):
    rows = docs(spark, corpus(20)).select("doc_id", "text", "source", *[(F.col("doc_id") * 7 + i).alias(c) for i, c in enumerate(CLASHES)])
    rows = rows.unionByName(rows.limit(3)).unionByName(rows.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    given = {tuple(r) for r in rows.collect()}
    out = run(rows)
    assert out.columns == rows.columns
    found = [tuple(r) for r in out.collect()]
    assert found and set(found) <= given


def test_mix_is_of_whole_documents(spark):
    rows = docs(spark, corpus(), ("x",) * 9 + ("y", None))
    texts = {r.doc_id: r for r in rows.collect()}
    out = mixing.mix_sizes(rows).collect()
    whole = [r.asDict() for r in mixing.mix_documents(rows).collect()]
    assert all(w == texts[w["doc_id"]].asDict() for w in whole)
    used = Counter(w["doc_id"] for w in whole)
    # Only the document at a source's cut may differ, by half of it at most.
    differ = [r for r in out if used[r.doc_id] * r.size != r.taken]
    assert all(abs(used[r.doc_id] * r.size - r.taken) <= r.size / 2 and used[r.doc_id] <= 3 for r in differ)
    assert len({texts[r.doc_id].source for r in differ}) == len(differ)


def test_pieces_keep_columns_of_any_name(spark):
    pieces = packing.token_pieces(docs(spark, corpus(10)), keep_ids=False).select("*", *[F.lit(i).alias(c) for i, c in enumerate(("group", "_group", "a.b"))])
    out = packing.pack(pieces)
    assert out.columns == [*pieces.columns, "sequence_id", "offset"] and all((r["group"], r["_group"], r["a.b"]) == (0, 1, 2) for r in out.collect())


def test_sequences_are_filled(spark):
    texts = corpus(30)
    rows = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    encode = byte_bpe("byte_bpe_50k")
    have = packing.packed_sequences(rows, length=64).collect()
    pieces = [tuple(r.ids[a:b]) for r in have for a, b in zip(r.starts, [*r.starts[1:], len(r.ids)], strict=True)]
    want = []
    for t in texts:
        ids = [*encode(t or "").tolist(), 2]
        first = len(ids) % 64 or 64
        want += [tuple(ids[:first])] + [tuple(ids[i : i + 64]) for i in range(first, len(ids), 64)]
    assert Counter(pieces) == Counter(want) and all(len(r.ids) <= 64 for r in have)


def test_equal_rows_are_dealt_to_several_groups(spark):
    rows = spark.range(900).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(5).cast("long").alias("length"), F.lit(9).cast("long").alias("ids_crc32"))
    out = packing.pack(rows, 64, group_pieces=300).collect()
    assert len({r.sequence_id % 3 for r in out}) == 3 and len(out) == 900


def test_search_reaches_the_recall_on_queries_that_did_not_calibrate(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = r.standard_normal((60, 32))[r.integers(0, 60, 6000)] + r.standard_normal((6000, 32)) * 0.6
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "cell": F.lit(2), "block": F.lit(3), "chunk": F.lit(4)})
    vectors = ann.valid_vectors(df, "vec_id", "embedding").persist()
    drawn, used = ann.drawn, []

    def watched(some, n, sample):
        used.append(drawn(some, n, min(sample, 4000)).persist())
        return used[-1]

    monkeypatch.setattr(ann, "drawn", watched)
    for name, value in (("BLOCK_ROWS", 700), ("CELL_ROWS", 200), ("CHUNK_QUERIES", 50)):
        monkeypatch.setattr(ann, name, value)
    have = {}
    for f in ann.search(vectors, F.col("id") % 10 == 0, 5).collect():
        have.setdefault(f.query_id, set()).add(f.vec_id)
    fresh = {i for i in range(0, 6000, 10)} - {row.id for row in used[1].collect()}
    want = brute_neighbours(rows, fresh, 5)
    recall = sum(len(have[q] & set(want[q])) for q in fresh) / (5 * len(fresh))
    print("recall of held-out queries", recall)
    assert len(fresh) >= 200 and recall >= 0.9


def test_cells_grow_with_the_square_root_of_the_entries():
    assert [ann.centroids_for(n) for n in (10, 50_000, 800_000, 50_000 * 10**4)] == [64, 64, 128, 640]
    splits, starts, block = ann.blocks_of(np.array([10, 0, 9000, 30_000, 5]))
    assert splits.tolist() == [1, 1, 3, 8, 1] and starts.tolist() == [0, 1, 2, 5, 13] and block.tolist() == sorted(block.tolist()) and block[-1] == 2


def edited(text, after):
    return hashlib.sha256((text[: len(text) - len(text) // 4] + after[: len(text) // 4]).encode()).hexdigest()


@pytest.mark.parametrize("size", [400, 3000, 10**6])
def test_ranges_cut_equal_and_missing_ids(spark, monkeypatch, size):
    r = random.Random(2)
    rows = [(i, f"text {i} " + "x" * r.randrange(300)) for i in range(40)] + [(7, f"seven {i} " * r.randrange(1, 9)) for i in range(120)] + [(None, f"none {i} " * r.randrange(1, 9)) for i in range(120)] + [(9, "same")] * 20
    rows += [(2**62 + i, f"large {i} " * r.randrange(1, 9)) for i in range(60)] + [(-(2**62) - i, f"low {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = {x.text: x.h for x in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    rows.sort(key=lambda x: (x[0] is None, x[0] or 0, key[x[1]]))
    want = Counter((i, edited(t, rows[(k + 1) % len(rows)][1])) for k, (i, t) in enumerate(rows))
    successive = fingerprints.successive
    parts = successive(df, size).groupBy("range").count().collect()
    assert len(parts) >= min(20, sum(len(t) for _, t in rows) // size // 2)
    monkeypatch.setattr(fingerprints, "successive", lambda d: successive(d, size))
    assert Counter((x.doc_id, x.edited_sha256) for x in fingerprints.fingerprints(df).collect()) == want


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(6)
    x = r.random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    model = quality.fit(x, y)
    for row, have in zip(x[:30], model.score(x[:30]), strict=True):
        at = [sum(row[k] >= e for e in model.edges[k]) for k in range(5)]
        total = model.constant + sum(model.tables[k][at[k]] for k in range(5)) + sum(t[at[i], at[j]] for i, j, t in model.pairs)
        assert math.isclose(have, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    # Only the pair tells the classes apart.
    assert ((model.score(x) > 0.5) == y).mean() > 0.95 and (0, 1) in {(i, j) for i, j, _ in model.pairs}


def test_a_step_is_the_best_small_tree():
    r = np.random.default_rng(7)
    gain = lambda g, h: g * g / (h + quality.SMOOTH)
    for _ in range(20):
        g, h = r.standard_normal(7), r.random(7) + 0.1
        cuts = {k: gain(g[:k].sum(), h[:k].sum()) + gain(g[k:].sum(), h[k:].sum()) for k in range(1, 7)}
        best = max(cuts, key=cuts.get)
        want = np.full(7, g.sum() / (h.sum() + quality.SMOOTH))
        if cuts[best] > gain(g.sum(), h.sum()) + 1e-9:
            want = np.concatenate([np.full(len(p), p.sum() / (q.sum() + quality.SMOOTH)) for p, q in ((g[:best], h[:best]), (g[best:], h[best:]))])
        assert np.allclose(quality._tree(g, h, 1), want)
        g, h = r.standard_normal((4, 5)), r.random((4, 5)) + 0.1
        parts = lambda v, i, j: (v[:i, :j].sum(), v[:i, j:].sum(), v[i:, :j].sum(), v[i:, j:].sum())
        best = max(((i, j) for i in range(1, 4) for j in range(1, 5)), key=lambda c: sum(gain(a, b) for a, b in zip(parts(g, *c), parts(h, *c), strict=True)))
        step = quality._cross(g, h)[1]
        assert np.allclose([step[0, 0], step[0, -1], step[-1, 0], step[-1, -1]], [a / (b + quality.SMOOTH) for a, b in zip(parts(g, *best), parts(h, *best), strict=True)])


def test_one_text_stands_for_a_labelled_id(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "good text here")] * 50 + [(1, "other text")] * 50 + [(2, "@@ ## $$")] * 3 + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 40 + [(2, 0), (2, 1), (3, 1), (None, 1), (1, None), (1, 7)], "doc_id long, quality int")
    fit, seen = quality.fit, []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(sorted(y.tolist())) or fit(x, y))
    out = quality.quality_scores(rows, labels)
    known = [float(q) for i, q in ((1, 1), (2, 0), (2, 1)) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert out.count() == 104 and seen == [sorted(known)]


def test_quality_ranks_held_out_documents(spark):
    path = "/root/testdata/sf0.1"
    scored = quality.quality_scores(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality")
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "quality").toPandas()
    ranks, ones = rows["score"].rank(), rows["quality"] == 1
    area = (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    print("area under the curve", area)
    assert area > 0.9


def test_a_text_without_blanks_is_one_token(spark):
    text = "日本語のテキスト。" * 3000
    row = token_counts.token_counts(docs(spark, [text, "a b"])).where("doc_id = 0").first()
    assert row.n_tokens == len(piece_model(token_counts.MODEL).encode(text)) and token_counts.pre_tokens(text) == [text]


def test_signatures_of_similar_sets_share_a_band():
    """How many of 4,000 pairs at a similarity of 0.8 share no band, for small sets too, whose bins are mostly borrowed."""
    r = np.random.default_rng(9)
    for n in (9, 45, 450):
        missed = 0
        for _ in range(4000 if n < 100 else 1000):
            both = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(both[: n - n // 9]), np.unique(both[n // 9 :])
            assert len(np.intersect1d(a, b)) >= 0.75 * len(np.union1d(a, b))
            same = (near_dedup.signature(a) == near_dedup.signature(b))[: near_dedup.BANDS * near_dedup.ROWS]
            missed += not same.reshape(-1, near_dedup.ROWS).all(axis=1).any()
        print("missed", n, missed)
        assert missed <= 3


def shingles_of(text, size):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def test_pipeline_in_plain_python(spark, sf_dir, tmp_path):
    """The whole pipeline over a small table with nulls and repeated rows."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = given.limit(4).withColumn("doc_id", F.lit(None).cast("long"))
    empty = given.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6)
    folder = str(tmp_path)
    given.unionByName(given.limit(6)).unionByName(odd).unionByName(empty).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = [r.asDict() for r in table.collect()]

    model = quality.learn(table, labels)
    good = [r for r, score in zip(rows, model.score(quality.table_of([r["text"] for r in rows])), strict=True) if score >= 0.5]
    have = [r.asDict() for r in corpus_pipeline.good_quality(spark, table, folder).collect()]
    assert plain(have) == plain(good) and 0 < len(good) < len(rows)

    sets, top = [shingles_of(r["text"], 5) for r in good], list(range(len(good)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(good)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, r in enumerate(good):
        groups.setdefault(root(i) if sets[i] else ("none", i), []).append(r)
    once = corpus_pipeline.one_of_each(spark, spark.createDataFrame(have, table.schema), folder).persist()
    left = [r.asDict() for r in once.collect()]
    kept = plain(left)
    assert sum(kept.values()) == len(groups)
    for members in groups.values():
        # One row of each group, with the least doc_id of it.
        least = min((r["doc_id"] for r in members if r["doc_id"] is not None), default=None)
        assert any(kept[tuple(r.values())] for r in members if r["doc_id"] == least)

    taken = Counter()
    for r in mixing.mix_sizes(once).collect():
        taken[r.doc_id, r.size] += r.taken
    mixed = [r.asDict() for r in corpus_pipeline.mixed(spark, once, folder).collect()]
    used = Counter()
    for r in mixed:
        n = len(words_of(r["text"]))
        used[r["doc_id"], n] += n
    assert set(plain(mixed)) <= set(kept) and max(plain(mixed).values()) <= 3 * max(kept.values())
    assert all(abs(used[k] - taken[k]) <= k[1] for k in taken) and sum(used[k] != taken[k] for k in taken) <= len({r["source"] for r in left})

    encode, want = byte_bpe("byte_bpe_50k"), Counter()
    for r in mixed:
        ids = np.append(encode(r["text"] or ""), 2).astype("<u4")
        for k, stop in enumerate(range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)):
            start = stop - 1024 if k else 0
            want[r["doc_id"], k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
    end = corpus_pipeline.run(spark, folder).collect()
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in end) == want
    sequences = {}
    for p in end:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in sequences.values():
        lengths = [n for _, n in sorted(places)]
        assert sum(lengths) <= 1024 and [o for o, _ in sorted(places)] == np.cumsum([0, *lengths])[:-1].tolist()
    # As many sequences as best-fit decreasing over all pieces needs.
    room: list[int] = []
    for n in sorted((k[3] for k, times in want.items() for _ in range(times)), reverse=True):
        able = [c for c in room if c >= n]
        if able:
            room.remove(min(able))
        room.append((min(able) if able else 1024) - n)
    assert len(sequences) == len(room)


def test_audit_of_a_replica_in_which_records_moved(spark):
    """A replica's manifest of its own records: a missing record shifts what follows in its archive."""
    pages = spark.createDataFrame([(i, f"u{i}", "h" * (i % 90)) for i in range(700)], "page_id long, url string, html string")
    left, right = fixity.manifest(pages), fixity.manifest(pages.where("page_id <> 100").withColumn("html", F.when(F.col("page_id") == 300, "other").otherwise(F.col("html"))))
    found = {(r.record_id, r.status) for r in fixity.audit(left, right).collect()}
    assert found == {(100, "missing"), (300, "changed")}
