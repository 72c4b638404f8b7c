"""Token operators against the tokenizers library and exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palisade.llm import blocks, bpe, classes, packing, piecemodel, wordtokens
from palisade.llm.registry import queries

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["ab", "A", "İ", "'s", "'LL", " ", "  ", "\t", "\n", "\r", "\x1c", "\x85", " ", "　", "é", "é", "中", "😀", "1", "२", "-", "_", "<|endoftext|>", "<|startoftext|>", "Σ", "ς", "가", "​", "̈́", "The", " the"]
texts = st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=5)), max_size=30).map("".join)
ROWS = [(1, "Some text, isn't it?"), (2, None), (3, ""), (None, "no id"), (3, "repeated id"), (3, "repeated id"), (4, "x" * 50_000), (5, "word " * 20_000), (6, "a <|endoftext|> b  <|startoftext|>")]


def table(spark):
    return spark.createDataFrame([(k, t, 7, "y", 1) for k, t in ROWS], "doc_id long, text string, ids int, start string, id int").repartition(3)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_byte_ids_like_the_library(text):
    own, lib = bpe.vocabulary(BYTES), Tokenizer.from_file(BYTES) if not hasattr(test_byte_ids_like_the_library, "lib") else test_byte_ids_like_the_library.lib
    test_byte_ids_like_the_library.lib = lib
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == ids
    assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_word_ids_like_the_library(text):
    lib = Tokenizer.from_file(WORDS) if not hasattr(test_word_ids_like_the_library, "lib") else test_word_ids_like_the_library.lib
    test_word_ids_like_the_library.lib = lib
    assert np.frombuffer(wordtokens.word_encoder(WORDS).encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_cuts_lie_in_no_token():
    own = bpe.vocabulary(BYTES)
    for value in own.bytes_of.values():
        if value not in (s.encode() for s in own.special):
            assert own.cuts(value) == []
    long = bytes(range(256)) * 2
    assert own.cuts(long) and own.cuts(long[:60]) == [c for c in own.cuts(long) if c < 60]


def test_encode_and_decode_tables(spark, library):
    back = bpe.decode(bpe.encode(table(spark), BYTES), BYTES).collect()
    wanted = sorted((str(k), library[0].encode(t or "", add_special_tokens=False).ids, t or "") for k, t in ROWS)
    assert sorted((str(r["id"]), r["ids"], r["text"]) for r in back) == wanted
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0


def test_bpe_query(spark, small, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries()["op4_forced_boundary_bpe"](spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library[0].encode(docs[r["doc_id"]], add_special_tokens=False).ids
        text = library[0].decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=300), st.sampled_from([0, 50, 90, 100]))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    assert np.array_equal(blocks.unpack_block(b"xx" + blocks.pack_block(ids, percentile), 2), ids)


def test_outliers_become_exceptions():
    ids = np.array([5] * 95 + [70_000] * 5, np.uint32)
    count, low, width, exceptions = blocks.HEAD.unpack_from(blocks.pack_block(ids))
    assert (count, low, width, exceptions) == (100, 5, 0, 5)


def test_file_spans(tmp_path):
    rng = np.random.default_rng(2)
    docs = [(k, rng.integers(0, 50_000, n).astype("<u4")) for k, n in ((4, 10), (None, 0), (6, 9000), (7, 1), (8, 300_000))]
    writer = blocks.BlockWriter(str(tmp_path / "t"))
    for key, ids in docs:
        writer.add(key, ids.tobytes())
    writer.close()
    reader = blocks.BlockReader(str(tmp_path / "t"))
    everything = np.concatenate([ids for _, ids in docs])
    for start, count in ((0, 5), (4090, 20), (8, 0), (300_000, 9011)):
        assert np.array_equal(reader.read(start, count), everything[start : start + count])
    at = 0
    for (key, ids), (read_key, start, read) in zip(docs, reader.documents(span=2), strict=True):
        assert (read_key, start) == (key, at) and np.array_equal(read, ids)
        at += len(ids)
    (tmp_path / "bad").write_bytes(b"0" * 100)
    with pytest.raises(ValueError):
        blocks.BlockReader(str(tmp_path / "bad"))


def test_token_files_keep_rows_and_order(spark, tmp_path, library):
    manifest = blocks.write_tokens(table(spark), str(tmp_path / "out"), WORDS, 1)
    rows = sorted(blocks.read_tokens(manifest).collect(), key=lambda r: r["start"])
    keys = [r["id"] for r in rows]
    assert keys == [None, *sorted(k for k, _ in ROWS if k is not None)]
    assert [r["start"] for r in rows] == np.cumsum([0, *(len(r["ids"]) // 4 for r in rows)]).tolist()[:-1]
    wanted = sorted((str(k), np.array([*library[1].encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for k, t in ROWS)
    assert sorted((str(r["id"]), bytes(r["ids"])) for r in rows) == wanted
    empty = blocks.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), WORDS, 1)
    assert blocks.read_tokens(empty).count() == 0


def test_token_query(spark, small, library):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    found = sorted(map(tuple, queries()["op6_patched_token_blocks"](spark, small).collect()))
    start = 0
    for (key, text), row in zip(docs, found, strict=True):
        ids = np.array([*library[1].encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert row == (key, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def check_packing(sequences, lengths, tiers):
    taken = {}
    for sequence in sequences:
        size = sum(p.length for p in sequence)
        assert size & (size - 1) == 0 and 0 < size <= tiers[-1]
        for p in sequence:
            assert p.length > 0
            taken.setdefault(p.doc, []).append((p.start, p.length))
    for doc, length in enumerate(lengths):
        at = 0
        for start, size in sorted(taken.get(doc, [])):
            assert start == at
            at += size
        assert at == length


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60))
def test_packing_covers_every_id_once(lengths):
    check_packing(packing.pack(lengths, (8, 16, 64)), lengths, (8, 16, 64))


def test_packing_prefers_whole_documents():
    r = random.Random(1)
    lengths = [int(r.lognormvariate(6, 1)) + 1 for _ in range(2000)]
    sequences = packing.pack(lengths)
    check_packing(sequences, lengths, packing.TIERS)
    assert sum(map(len, sequences)) < 1.4 * len(lengths)
    sizes = [sum(p.length for p in s) for s in sequences]
    groups = packing.step_groups(sizes)
    totals = np.bincount(groups, sizes)
    assert (totals[:-1] == packing.STEP_TOKENS).all() and totals[-1] <= packing.STEP_TOKENS


def check_pieces(rows, docs, library):
    """Pieces against the documents: every id once, gapless sequences that need no padding."""
    wanted = sorted(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in docs)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["context"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length, context in sorted(pieces):
            assert offset == at
            at += length
        assert at == context and at & (at - 1) == 0 and at <= 4096
    assert sum(r["length"] for r in rows) == sum(len(w) // 4 for w in wanted)
    return wanted


def test_packed_table(spark, library):
    rows = packing.pack_documents(table(spark), WORDS, 2, buffer_tokens=30_000).collect()
    wanted = check_pieces(rows, [(k, t or "") for k, t in ROWS], library[1])
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    assert b"".join(sorted(wanted)).__len__() == sum(len(i) for v in by_doc.values() for _, i in v)
    whole = sorted(b"".join(i for _, i in sorted(by_doc[k, n])) for k, n in by_doc if (k, n) != (3, by_doc and 3))
    assert set(whole) <= set(wanted) | {w * 2 for w in wanted}
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORDS, 2).count() == 0


def test_packing_query(spark, small, library):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = queries()["op7_hierarchical_packing"](spark, small).collect()
    check_pieces(rows, docs, library[1])
    ids = {k: np.array([*library[1].encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in docs}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())


# --- characters and words that two libraries may see otherwise

CHARACTERS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


def in_context():
    """Every character between spaces; those whose class is disputed, and many others, beside letters, digits and marks too."""
    rows = [" ".join(CHARACTERS[i : i + 256]) for i in range(0, len(CHARACTERS), 256)]
    chosen = sorted(set(classes.class_changes()) | set(range(0x3400)) | {ord(c) for c in CHARACTERS[0x3400::61]})
    rows += [f"{c}B.. a{c}b 1{c}:{c} {c}, {c}{c}!?x a{c}'s" for c in map(chr, chosen)]
    for start in range(0, len(rows), 4096):
        yield rows[start : start + 4096]


def test_every_character_like_the_libraries(library):
    byte_library, word_library = library
    bytes_of, words = bpe.vocabulary(BYTES), wordtokens.word_encoder(WORDS)
    for texts in in_context():
        for text, found in zip(texts, byte_library.encode_batch(texts, add_special_tokens=False)):
            assert bytes_of.encode(text).tolist() == found.ids, ascii(text)
        for text, found in zip(texts, word_library.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(words.encode(text), "<u4").tolist() == found.ids, ascii(text)


def column_ids(found):
    return [np.frombuffer(ids, "<u4").tolist() for ids in found]


def test_columns_like_the_library(library):
    own, lib = wordtokens.word_encoder(WORDS), library[1]
    odd = [t for _, t in ROWS] + ["", ".", "a.", "a..", ".a", "İ. I\u0307 J\u030c", "ΑΣ Σ.", "x<|endoftext|>Y. <|startoftext|>", "É, é; Ñ\n\n中。 \t1२"]
    for rows in ([], [None], [""], odd, odd * 3, *in_context()):
        wanted = [[*found.ids, 1] for found in lib.encode_batch([t or "" for t in rows], add_special_tokens=False)]
        assert column_ids(own.encode_all(pa.array(rows, pa.string()), 1)) == wanted
    assert column_ids(own.encode_all(pa.array(["cut", *odd])[1:], 1)) == column_ids(own.encode_all(pa.array(odd), 1))


def test_slices_and_full_tables_change_no_ids(monkeypatch):
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}." for j in range(26)) for i in range(60)]
    wanted = column_ids(wordtokens.WordEncoder(WORDS).encode_all(pa.array(texts), 1))
    monkeypatch.setattr(wordtokens, "SLICE", 50)
    monkeypatch.setattr(wordtokens, "KEPT", 7)
    monkeypatch.setattr(wordtokens, "MERGED", 3)
    small = wordtokens.WordEncoder(WORDS)
    assert column_ids(small.encode_all(pa.array(texts), 1)) == wanted
    assert max(len(t) for g in (small.words, small.chunks) for t in (g.newer, g.older)) <= 7


def test_distinct_words_of_a_column_are_merged_once(monkeypatch):
    """However small the tables of known words: a word in capitals, with a mark behind it or in another text is no other word."""
    monkeypatch.setattr(wordtokens, "KEPT", 4)
    own = wordtokens.WordEncoder(WORDS)
    merged = []
    merge, own.merge = own.merge, lambda word: merged.append(word) or merge(word)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    texts = [" ".join(words), " ".join(w.upper() for w in words), " ".join(w.title() + "," for w in words)] * 3
    found = column_ids(own.encode_all(pa.array(texts), 1))
    assert found[0] == found[1] == found[3] and len(merged) == len(words)


def test_words_of_newer_unicode_versions_by_name():
    lib = Tokenizer.from_file(WORDS)
    for text in (":\u0558", "\u0558\u058b\u058c", "x\u208f\u209d\u209e\u209f", "\ua7dd1", ":\U00018d80", "\u0558 \u0558:"):
        assert np.frombuffer(wordtokens.word_encoder(WORDS).encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


# --- byte-level BPE by a serialised sentencepiece model

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pieces():
    ranks = piecemodel.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return piecemodel.piece_model(RANKS, public_tokenizers.PATTERN), library


def test_piece_model_like_the_library(pieces):
    model, library = pieces

    @settings(max_examples=400, deadline=None)
    @given(texts)
    def check(text):
        ids = library.encode_ordinary(text)
        assert model.encode(text).tolist() == ids
        assert model.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0] == text.encode()

    check()
    for batch in in_context():
        for text in batch:
            assert model.encode(text).tolist() == library.encode_ordinary(text), ascii(text)
    for token in piecemodel.read_ranks(RANKS):
        text = token.decode("utf-8", "ignore")
        assert model.encode(text).tolist() == library.encode_ordinary(text)


def test_serialised_model_is_the_vocabulary(pieces):
    model, _ = pieces
    ranks = piecemodel.read_ranks(RANKS)
    assert model.model.get_piece_size() == len(ranks) + 1 and model.model.unk_id() == len(ranks)
    assert {v: k for k, v in model.bytes_of.items()} == ranks
    assert all(model.model.get_score(i) == -i for i in range(0, len(ranks), 997))


def test_piece_model_of_scattered_ranks(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"cab"]  # "cab" can't be merged from its parts: only a whole match
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i * 3 + 5}\n" for i, t in enumerate(tokens)))
    ranks = piecemodel.read_ranks(str(path))
    library = tiktoken.Encoding("few", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    model = piecemodel.PieceModel(str(path), public_tokenizers.PATTERN)
    for text in ("abc", "cab", "xcab", "abcabcab bc", "aabbcc", "", "é"):
        assert model.encode(text).tolist() == library.encode_ordinary(text)
    assert model.decode_all(np.array([-1, 5 + 3 * 97, 999_999]), np.array([0, 3])) == [b"a"]


def test_piece_model_tables(spark, pieces):
    _, library = pieces
    back = piecemodel.decode(piecemodel.encode(table(spark), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    wanted = sorted(((k, library.encode_ordinary(t or ""), (t or "").encode()) for k, t in ROWS), key=str)
    assert sorted(((r["id"], r["ids"], bytes(r["data"])) for r in back), key=str) == wanted
    nothing = piecemodel.encode(spark.createDataFrame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN)
    assert piecemodel.decode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    lost = spark.createDataFrame([(1, None)], "id long, ids array<int>")
    assert [tuple(r) for r in piecemodel.decode(lost, RANKS, public_tokenizers.PATTERN).collect()] == [(1, None, b"")]


def test_piece_model_query(spark, small, pieces):
    _, library = pieces
    wanted = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        wanted[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    found = {r["doc_id"]: tuple(r)[1:4] for r in queries()["op13_piece_model_bpe"](spark, small).collect()}
    assert found == wanted
