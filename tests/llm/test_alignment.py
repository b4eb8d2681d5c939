"""Alignment against a sweep by hand over both libraries' own tokens."""

import functools
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from test_llm import ODD, corpus, docs

from tracelake.llm import alignment, queries

MORE = ["<s> </s> <unk> <0x41> <|endoftext|>", "  two  blanks ", "tab\tand\nline\n\n", "a▁b", "▁", " ", "  ", "naïve 😀 漢字 مرحبا", "\x00\x01", "x" * 700 + " " + "y" * 900, "é ‍ zero width", "the cat the cat the cat"]


@functools.cache
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # Byte-level letters: printable bytes stand for themselves, the others for letters from 256 on, in order.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    return a, b, letters


def tokens(text):
    """Ids and bytes of both sides; none where they don't give the text back."""
    a, b, letters = libraries()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
    whole = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if text and b"".join(bytes_a) == whole == b"".join(bytes_b) else ([], [], [], [])


def expected(texts):
    groups, links = [], []
    for text in texts:
        ids_a, bytes_a, ids_b, bytes_b = tokens(text or "")
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        out, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
            out.append((ids_a[i:k], ids_b[j:m]))
            i, j = k, m
        groups.append((len(ids_a), len(ids_b), out))
        links.append([(x[-1], y[-1]) for x, y in out])
    count = Counter(pair for each in links for pair in each)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    rows = []
    for (n_a, n_b, out), mine in zip(groups, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in out)
        best = sum(count[p] == most[p[1]] for p in mine)
        rows.append((n_a, n_b, len(out), len(mine), best, sum(count[p] for p in mine), hashlib.sha256(text.encode()).hexdigest() if out else ""))
    return rows


def numbers(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


@pytest.mark.parametrize("hot, window, fed, links", [(500_000, 1 << 16, 1 << 18, 1 << 18), (3, 16, 1, 2), (0, 7, 40, 1 << 18)])
def test_alignment_equals_a_sweep_by_hand(spark, monkeypatch, hot, window, fed, links):
    texts = [*corpus(25), *MORE, *MORE[:3], *ODD]
    monkeypatch.setattr(alignment, "FED", fed)
    monkeypatch.setattr(alignment, "LINKS", links)
    rows = alignment.align(docs(spark, texts).repartition(3), hot=hot, window=window).collect()
    want = expected(texts)
    assert len(rows) == len(texts) and sum(w[0] > 0 for w in want) > 30 and sum(w[0] == 0 for w in want) >= 5
    assert {r.doc_id: numbers(r) for r in rows} == dict(enumerate(want))


def test_random_texts_in_any_feeds():
    r = random.Random(4)
    lengths = (np.array([1, 2, 3, 5]), np.array([1, 2, 4]))

    def cut(size, of):
        out, at = [], 0
        while at < size:
            fits = [i for i, n in enumerate(of) if n <= size - at]
            out.append(r.choice(fits))
            at += int(of[out[-1]])
        return out

    for _ in range(40):
        texts = [(n := r.randrange(0, 60), cut(n, lengths[0]), cut(n, lengths[1])) for _ in range(r.randrange(1, 8))]
        rows = []
        for d, (size, a, b) in enumerate(texts):
            for window in range(0, max(size, 1), 8):
                for side, ids in enumerate((a, b)):
                    ends = np.cumsum(lengths[side][ids]) if ids else np.zeros(0)
                    rows.append((d, d, side, np.array([i for i, e in zip(ids, ends, strict=True) if window < e <= window + 8], np.uint16)))
        whole = alignment.Sweep(lengths)
        want = whole.feed(rows) + whole.finish()
        machine, have = alignment.Sweep(lengths), []
        while rows:
            n = r.randrange(1, 5)
            have += machine.feed(rows[:n])
            rows = rows[n:]
        have += machine.finish()
        plain = lambda out: [(*row[:7], row[7].tolist(), row[8].tolist()) for row in out]
        assert plain(have) == plain(want) and [h[2:4] for h in have] == [(len(a), len(b)) for _, a, b in texts]
        for row, (_, a, b) in zip(have, texts, strict=True):
            ends = [set(np.cumsum(lengths[s][x]).tolist()) if x else set() for s, x in ((0, a), (1, b))]
            assert row[4] == len(ends[0] & ends[1])


def test_empty_tables_null_ids_repeated_rows(spark):
    rows = docs(spark, ODD)
    assert alignment.align(rows.limit(0)).count() == 0
    many = rows.selectExpr("if(doc_id > 4, null, doc_id) as doc_id", "text", "1 as row", "2 as pair", "3 as n").unionByName(rows.selectExpr("doc_id", "text", "1 as row", "2 as pair", "3 as n"))
    have = Counter(numbers(r) for r in alignment.align(many).collect())
    assert have == Counter(expected([*ODD, *ODD]))


def test_query_equals_a_sweep_by_hand(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    have = {r.doc_id: numbers(r) for r in queries.QUERIES["op12_alignment"](spark, sf_dir).collect()}
    assert have == dict(zip((r.doc_id for r in table), expected([r.text for r in table]), strict=True))
