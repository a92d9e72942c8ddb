import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nearfield.llm import idfiles, pieces, queries
from nearfield.llm.common import PairTable

MODEL, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
SP, TK = sentencepiece.SentencePieceProcessor(model_file=MODEL), Tokenizer.from_file(BYTES)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aeinst ▁.\n\tÉß日👍0-")) | st.characters(codec="utf-8"), max_size=60), max_size=4))
def test_pieces_match_the_library(texts):
    tool = pieces.tokenizer(MODEL)
    ids, starts = tool.encode(texts)
    for i, t in enumerate(texts):
        own = ids[starts[i] : starts[i + 1]]
        assert own.tolist() == SP.encode(t)
        assert tool.decode(own) == SP.decode(own.tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 260), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert pieces.tokenizer(MODEL).decode(np.array(ids, np.int64)) == SP.decode(ids)


def test_long_runs():
    tool = pieces.tokenizer(MODEL)
    for t in (" " * 2000 + "the end", "ab" * 3000, "a" * 5001, "=" * 999, " " * 333):
        assert tool.encode([t])[0].tolist() == SP.encode(t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab's \n\t\r\x0b\x1c\u00a0\u3000é日1.")) | st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_word_store_matches_the_library(texts):
    ids, starts = idfiles.tokenizer(BYTES).encode(texts)
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == TK.encode(t, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**20), max_size=400))
def test_id_coding_round_trip(ids):
    ids = np.array(ids, np.int64)
    assert (idfiles.unpack_ids(*idfiles.pack_ids(ids), len(ids)) == ids).all()


def test_many_distinct_ids_need_more_bytes():
    ids = np.arange(70_000)
    header, control, data = idfiles.pack_ids(ids)
    assert len(data) == 256 + 2 * (65_536 - 256) + 3 * (70_000 - 65_536)
    assert (idfiles.unpack_ids(header, control, data, len(ids)) == ids).all()
    with pytest.raises(ValueError):
        idfiles.unpack_ids(header, control, data[:-1], len(ids))


def test_pair_table():
    keys = np.unique(np.random.default_rng(0).integers(0, 10**12, 5000))
    table = PairTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + 10**13) == -1).all()


def test_op1_on_whole_table(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.op1_pieces(spark, sf).collect()}
    for doc in documents.collect():
        ids = SP.encode(doc["text"] or "")
        r = got.pop(doc["doc_id"])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
    assert not got


def test_op1_odd_texts(odd):
    got = queries.tokenized(odd, MODEL).collect()
    assert len(got) == odd.count()
    for r, d in zip(got, odd.collect()):
        assert r["ids"] == SP.encode(d["text"] or "") and r["decoded"] == SP.decode(r["ids"])
    assert queries.tokenized(odd.limit(0), MODEL).count() == 0


def check_files(df):
    encode = lambda texts: idfiles.tokenizer(BYTES).encode(texts)
    blocks = idfiles.write_ids(df, encode, end_id=2)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["value"]) for r in idfiles.read_ids(blocks, per_document=idfiles.crc_of_ids).collect())
    start, want = 0, []
    for r in sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = TK.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((start, r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    full = idfiles.read_ids(blocks).collect()
    assert sum(len(r["ids"]) for r in full) == start


def test_op8_files(documents, odd):
    check_files(documents)
    check_files(odd)
    assert idfiles.read_ids(idfiles.write_ids(odd.limit(0), None)).count() == 0


def test_blocks_are_cut(monkeypatch, documents):
    encode = lambda texts: idfiles.tokenizer(BYTES).encode(texts)
    monkeypatch.setattr(idfiles, "BLOCK_IDS", 1000)
    assert idfiles.write_ids(documents.coalesce(1), encode).count() >= 1
