"""Compiled tokenizers, packing and token files against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import finite_state, near_dedup, packing, token_counts, token_files
from touchline.llm.storage import prepare
from touchline.llm.words import word_hashes
from touchline.session import fresh_dir

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = ["'", "s", "re", "'ve", "'ll", "'r", "a", "É", "1", "½", " ", "  ", "\n", "\t", " ", "!", "…", "漢", "🙂", "é",
         "Σ", "İ", "\x1c", "​", "\x85", "<|endoftext|>", "word", "͸"]


def machine(name):
    return finite_state.compiled(public_tokenizers.path(name))


def library_ids(name, texts):
    return [e.ids for e in machine(name).library.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_odd_texts(name):
    random.seed(5)
    texts = ["".join(random.choices(PARTS, k=random.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "'r", "a" * 5000, "\n" * 3000, "'" * 700, "ab 'll " * 3000]
    expected = library_ids(name, texts)
    assert [x.tolist() for x in machine(name).encode(texts)] == expected
    assert machine(name).counts(texts).tolist() == [len(x) for x in expected]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_any_text(texts):
    for name in FILES:
        assert [x.tolist() for x in machine(name).encode(texts)] == library_ids(name, texts)


@pytest.mark.parametrize("name", FILES)
def test_texts_longer_than_a_segment(name, monkeypatch):
    monkeypatch.setattr(finite_state, "SEGMENT", 50)
    texts = ["We're here;  it's  fine.\n\nNo 'tis not " * 40, "x" * 500]
    assert [x.tolist() for x in machine(name).encode(texts)] == library_ids(name, texts)


def test_counts_query(spark, sf, query):
    rows = query["op10_token_counts"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in rows:
        n = len(library_ids(FILES[0], [texts[r.doc_id]])[0])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
    assert len(rows) == len(texts)


def test_counts_of_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (2, "a b"), (None, "x")], "n_tokens")
    found = token_counts.token_counts(docs, public_tokenizers.path(FILES[0]), limit=1).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == [
        (0, 1, 1, False), (1, 0, 0, False), (2, 0, 0, False), (2, 3, 2, True)]
    assert token_counts.token_counts(docs.limit(0), public_tokenizers.path(FILES[0])).count() == 0


def test_piece_lengths():
    assert packing.piece_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    assert packing.piece_lengths(1) == [1] and packing.piece_lengths(2048) == [2048]


def test_packing_query(spark, sf, query):
    rows = query["op8_packing"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.offset == 0 and r.length <= 2048 and r.length & (r.length - 1) == 0
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by_number = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert by_number == sorted(by_number)
    for doc_id, text in texts.items():
        ids, at = np.array([*library_ids(FILES[0], [text])[0], 1], "<u4"), 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_packing_odd_rows(spark, docs_of):
    prepare(spark)
    docs = docs_of([(1, None), (2, ""), (2, "")], "length", "part")
    found = packing.packed(docs, public_tokenizers.path(FILES[0])).collect()
    assert sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in found) == [(1, 0, 1, 1), (2, 0, 1, 1), (2, 0, 1, 1)]
    assert packing.packed(docs.limit(0), public_tokenizers.path(FILES[0])).count() == 0


@pytest.mark.parametrize("counts", [[5], [1, 1], [3, 0, 0, 2, 9], [2 ** i for i in range(40)], list(range(1, 500))])
def test_codes(counts):
    counts = np.array(counts, np.int64)
    lengths = token_files.code_lengths(counts, 12)
    used = counts > 0
    assert (lengths[used] > 0).all() and (lengths[~used] == 0).all() and lengths.max() <= 12
    assert sum(2.0 ** -int(x) for x in lengths[used]) <= 1
    ids = np.random.default_rng(1).choice(np.flatnonzero(used), 5000)
    bits, checkpoints = token_files.encode_ids(ids, lengths, token_files.canonical_codes(lengths))
    entries = token_files.decoding_table(lengths)
    assert (token_files.decode_ids(bits, checkpoints, len(ids), entries) == ids).all()
    block = token_files.decode_ids(bits, checkpoints[2:3], token_files.BLOCK, entries)      # one block alone
    assert (block == ids[2 * token_files.BLOCK:3 * token_files.BLOCK]).all()


def test_lengths_are_optimal_without_a_limit():
    import heapq
    counts = np.random.default_rng(2).integers(1, 1000, 60)
    heap = [(int(c), i, [i]) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost, n = 0, len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], n, []))
        n += 1
    assert int((token_files.code_lengths(counts, 30) * counts).sum()) == cost


def test_token_files_query(spark, sf, query):
    rows = {r.doc_id: r for r in query["op6_token_files"](spark, sf).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*library_ids(FILES[1], [r.text])[0], 2], "<u4")
        got = rows[r.doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_round_trip(spark, docs_of, monkeypatch):
    prepare(spark)
    path = fresh_dir(spark, "test-files")
    docs = docs_of([(3, "b b"), (None, "n"), (1, None), (3, "b b"), (2, "")], "ids", "width")
    token_files.write_token_files(docs, public_tokenizers.path(FILES[1]), path)
    found = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 1, 2, 3, 3]
    word = library_ids(FILES[1], ["b", "n"])
    assert [r.ids for r in found] == [[*word[1], 2], [2], [2], [*word[0] * 2, 2], [*word[0] * 2, 2]]
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    empty = fresh_dir(spark, "test-files")
    token_files.write_token_files(docs.where(F.lit(False)), public_tokenizers.path(FILES[1]), empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_one_polynomial_hash(file):
    """Sums of powers modulo 2**64 cannot tell these pairs of words apart."""
    path = public_tokenizers.path(file)
    library = Tokenizer.from_file(path)
    for n in (1024, 2048, 4096):
        texts = [thue_morse(n, "ab"), thue_morse(n, "ba"), "some " + thue_morse(n, "ba") + " other"]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        machine = finite_state.CompiledTokenizer(path)
        assert [x.tolist() for x in machine.encode(texts)] == want
        assert machine.counts(texts[::-1]).tolist() == [len(w) for w in want[::-1]]


def test_word_hashes_of_one_polynomial_hash():
    for n in (1024, 2048, 4096):
        a, b = word_hashes([thue_morse(n, "ab"), thue_morse(n, "ba")])
        assert len(a) == len(b) == 1 and a[0] != b[0]


def test_near_dedup_keeps_both_words_of_one_polynomial_hash(spark, docs_of):
    prepare(spark)
    rows = near_dedup.near_groups(docs_of([(1, thue_morse(1024, "ab")), (2, thue_morse(1024, "ba"))])).collect()
    assert all(r.kept for r in rows)
