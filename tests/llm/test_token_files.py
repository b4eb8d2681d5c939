"""Packed token files: bits, blocks, round trips, places in the whole, odd inputs."""

import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_llm import ODD, corpus, docs

from tracelake.llm import queries, token_files
from tracelake.llm.common import shared_dir


@functools.cache
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300), st.randoms())
def test_bits_round_trip(width, values, r):
    ids = np.array(values, np.uint64) & np.uint64((1 << width) - 1)
    packed = token_files.pack_bits(ids.astype(np.uint32), width)
    assert len(packed) == (len(ids) * width + 7) // 8
    at = np.array([r.randrange(len(ids)) for _ in range(20)] if len(ids) else [], np.int64)
    data = np.frombuffer(packed, np.uint8)
    assert (token_files.take_bits(data, width, np.arange(len(ids))) == ids).all() and (token_files.take_bits(data, width, at) == ids[at]).all()


def test_bits_of_a_vocabulary():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("width", [5, 16, 17])
def test_a_file_gives_any_ids(width):
    r = np.random.default_rng(width)
    each = [r.integers(0, 1 << width, n).astype(np.uint32) for n in (3, 1, 100_000, 0, 4096, 7000)]
    packer = token_files._Packer(width)
    for i, ids in enumerate(each):
        packer.add(None if i == 1 else -i, ids)
    file = token_files.TokenFile(packer.file(4, 5) + b"\n")
    whole = np.concatenate(each)
    assert (file.part, file.seq, file.n_docs, file.n_ids) == (4, 5, 6, len(whole)) and len(file.blocks) == -(-len(whole) // token_files.BLOCK_IDS) + 1
    assert all((file.document(i) == ids).all() for i, ids in enumerate(each)) and file.has_id.tolist() == [1, 0, 1, 1, 1, 1]
    for first, n in ((0, 1), (4095, 2), (50_000, 9000), (len(whole) - 1, 1), (7, 0)):
        assert (file.ids(first, n) == whole[first : first + n]).all()
    at = r.integers(0, len(whole), 500)
    assert (file.at(at) == whole[at]).all()
    with pytest.raises(ValueError):
        token_files.TokenFile(b"?" * 100)


@pytest.mark.parametrize("file_ids, range_bytes", [(1 << 22, 64 << 20), (500, 4000)])
def test_files_round_trip(spark, file_ids, range_bytes):
    texts = corpus()
    rows = docs(spark, texts).repartition(3)
    folder = f"{shared_dir(spark)}/tokens-{file_ids}"
    token_files.write_token_files(rows, folder, file_ids=file_ids, range_bytes=range_bytes)
    have = {r.doc_id: r for r in token_files.read_token_files(spark, folder).collect()}
    whole = []
    for i, t in enumerate(texts):
        ids = library_ids(t)
        assert (have[i].start, have[i].n_tokens, have[i].ids_crc32) == (len(whole), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        whole += ids
    index = token_files.token_index(spark, folder)
    assert index.count() > 1 or file_ids > 1000
    for first, n in ((0, 10), (len(whole) // 2, 2000), (len(whole) - 3, 50), (len(whole), 5)):
        found = sorted((r.at, r.ids) for r in token_files.read_ids(spark, index, first, n).collect())
        assert [i for _, ids in found for i in ids] == whole[first : first + n]


def test_odd_rows(spark):
    rows = docs(spark, ODD).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.lit(7).cast("long")))
    rows = rows.unionByName(rows).select("*", F.lit(1).alias("part"), F.lit(2).alias("seq"), F.lit(3).alias("row"))
    folder = f"{shared_dir(spark)}/tokens-odd"
    token_files.write_token_files(rows, folder, file_ids=100, range_bytes=3000)
    have = sorted((r.start, r.n_tokens, r.doc_id) for r in token_files.read_token_files(spark, folder).collect())
    assert len(have) == 2 * len(ODD) and all(a[0] + a[1] == b[0] for a, b in zip(have, have[1:], strict=False)) and have[0][0] == 0
    missing = [d is None for _, _, d in have]
    assert missing == sorted(missing, reverse=True) and sorted(n for _, n, _ in have) == sorted(2 * [len(library_ids(t)) for t in ODD])
    # Rows equal in everything may still be cut apart, and their order doesn't show.
    again = f"{shared_dir(spark)}/tokens-again"
    token_files.write_token_files(rows.repartition(5), again, file_ids=100, range_bytes=3000)
    assert sorted((r.start, r.n_tokens, r.doc_id) for r in token_files.read_token_files(spark, again).collect()) == have


def test_empty_table(spark):
    folder = f"{shared_dir(spark)}/tokens-empty"
    token_files.write_token_files(docs(spark, ["x"]).limit(0), folder)
    assert token_files.read_token_files(spark, folder).count() == 0 and token_files.token_index(spark, folder).count() == 0


def test_query_gives_what_the_library_gives(spark, sf_dir):
    have = {r.doc_id: r for r in queries.QUERIES["op11_token_files"](spark, sf_dir).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = library_ids(r.text)
        assert (have[r.doc_id].start, have[r.doc_id].n_tokens, have[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
