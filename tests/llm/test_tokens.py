"""Counts, pieces and token files against the libraries themselves."""

import os
import struct
import zlib

import public_tokenizers
import pyarrow.fs as pafs
import pytest
import sentencepiece
from brute import sha256
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillrank.llm import sentence_pieces, token_counts, token_files

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
os.environ["TOKENIZERS_PARALLELISM"] = "false"
LIBRARY, PIECE_LIBRARY = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_counts(docs):
    rows, frame = docs
    got = {r[0]: tuple(r)[1:] for r in token_counts.count_tokens(frame, BYTE_BPE).collect()}
    want = {i: len(ids_of(t or "")) for i, t in rows}
    assert got == {i: (len((t or "").encode()), want[i], want[i] > 1024) for i, t in rows}


def test_pieces(docs):
    rows, frame = docs
    got = {r.doc_id: r for r in sentence_pieces.encode_pieces(frame, PIECES, ids=True).collect()}
    for i, text in rows:
        ids = PIECE_LIBRARY.encode(text or "")
        assert got[i].ids == ids and got[i].decoded == PIECE_LIBRARY.decode(ids)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()))
        assert got[i].decoded_sha256 == sha256(got[i].decoded.encode())


def test_token_files_give_back_what_was_written(docs):
    rows, frame = docs
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_rows(frame, BYTE_BPE).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = [*ids_of(text or ""), 2]
        assert got[i] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_repeated_rows_and_empty_tables(spark, no_docs):
    twice = spark.createDataFrame([(5, "b c"), (5, "b c"), (5, None), (None, "x")], "doc_id long, text string")
    assert token_counts.count_tokens(twice, BYTE_BPE).count() == 4
    assert sentence_pieces.encode_pieces(twice, PIECES).count() == 4
    rows = token_files.token_rows(twice, BYTE_BPE).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 5, 5, 5] and [r.n_tokens for r in rows] == [2, 1, 3, 3]
    for made in (token_counts.count_tokens(no_docs, BYTE_BPE), sentence_pieces.encode_pieces(no_docs, PIECES),
                 token_files.token_rows(no_docs, BYTE_BPE)):
        assert made.count() == 0


def test_single_frames_and_damage(tmp_path):
    path = tmp_path / "f.zst"
    parts = [bytes([k]) * 300_000 for k in range(5)]
    with path.open("wb") as sink:
        writer = token_files.FrameWriter(sink)
        places = [writer.add(p) for p in parts]
        writer.close()
    assert places == [(k, 0) for k in range(5)]
    system = pafs.LocalFileSystem()
    assert token_files.FrameReader(system.open_input_file(str(path))).frame(3) == parts[3]
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True) as whole:
        assert whole.read() == b"".join(parts)
    raw = bytearray(path.read_bytes())
    raw[-9 - 4 - 12] ^= 1  # the checksum of the frame before the last
    path.write_bytes(raw)
    reader = token_files.FrameReader(system.open_input_file(str(path)))
    assert reader.frame(4) == parts[4]
    with pytest.raises(ValueError, match="damaged"):
        reader.frame(3)


COUNTER, CODEC, ENCODER = token_counts.TokenCounter(BYTE_BPE), sentence_pieces.PieceCodec(PIECES), token_files.Encoder(BYTE_BPE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t'abstheré1.,<|>▁🙂\x1c　", max_size=40))
def test_any_text(text):
    ids = ids_of(text)
    assert COUNTER([text]) == [len(ids)]
    assert ENCODER([text]) == [struct.pack(f"<{len(ids)}I", *ids)]
    pieces = PIECE_LIBRARY.encode(text)
    assert CODEC.encode(text) == pieces and CODEC.decode(pieces) == PIECE_LIBRARY.decode(pieces)
