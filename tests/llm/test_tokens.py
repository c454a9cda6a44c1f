import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe_codec, packing
from tidemark.llm.token_prefix import PrefixCounter, count_tokens

PARTS = ["a", "B", "'s", "ing", " ", "  ", "\n", "é", "É", "ß", "日本", "😀", "\t", "12", "²", "ª", "<|endoftext|>", "<|startoftext|>", "<s>", "<0x0A>", "▁", "Σ", "İ", "ж", "tion", "\0", "\r\n", " ", " ", "́", "_", "-", "Ⅷ", "\x1c", "\x85", "a" * 70, "<|", "n't"]
BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def texts(n=600, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(PIECE)


def test_every_prefix(counter):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for t in texts():
        assert counter.prefixes(t).tolist() == [len(library.encode(t[:k])) for k in range(len(t) + 1)]
    long = "word " * 3000 + "x" * 3000 + " " * 500
    assert counter.prefixes(long)[-1] == len(library.encode(long))
    for budget in (0, 1, 7, 100):
        k = counter.truncate(long, budget)
        assert len(library.encode(long[:k])) <= budget < len(library.encode(long[: k + 1]))


def test_token_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "one two", None), (3, "one two", None)], "doc_id bigint, text string, n_tokens string")
    got = sorted(tuple(r)[:5] for r in count_tokens(df, PIECE, limit=1, keep_prefixes=True).collect())
    assert got == [(1, 0, 0, False, 0), (2, 0, 0, False, 0), (3, 7, 2, True, 3), (3, 7, 2, True, 3)]
    assert count_tokens(df.limit(0), PIECE).count() == 0


def test_codec_equals_library():
    library, codec = Tokenizer.from_file(BYTE), bpe_codec.Codec(BYTE)
    words = {w.encode(): codec.bpe.merge(w.encode()) for w in (" the", "tion", "a", "ab", "abc", " thentioning", "é")}
    codec.lexicon = bpe_codec.Lexicon(bpe_codec.compile_lexicon(words))
    for w, ids in words.items():
        assert np.frombuffer(codec.lexicon.get(w), "<u4").tolist() == ids
    assert codec.lexicon.get(b"") is None and codec.lexicon.get(b"th") is None and codec.lexicon.get(b"abcd") is None
    for t in texts():
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert codec.decode(codec.encode(t)) == library.decode(ids, skip_special_tokens=False)
    w = "thentionabc" * 300
    assert codec.bpe.merge(w.encode()) == library.encode(w, add_special_tokens=False).ids


def test_automaton_shares_suffixes():
    words = {f"{a}{b}ation".encode(): [1] for a in "abcdef" for b in "xyz"}
    lexicon = bpe_codec.Lexicon(bpe_codec.compile_lexicon(words))
    assert len(lexicon.final) == 8  # a root, one state after the first letter, one after the second, and the shared ending


def test_codec_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the the  the<|endoftext|>"), (4, "the cat")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in bpe_codec.encode_decode(df, BYTE, digests=True).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    ids = Tokenizer.from_file(BYTE).encode("the the  the<|endoftext|>", add_special_tokens=False).ids
    assert got[3].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    plain = {r.doc_id: r.decoded for r in bpe_codec.encode_decode(df, BYTE).collect()}
    assert plain[4] == "the cat" and plain[1] == ""


def test_word_encoder_equals_library():
    library, encoder, own = Tokenizer.from_file(WORD), packing.WordEncoder(WORD, 2), texts(3000, 9)
    got = [x for k in range(0, len(own), 100) for x in encoder(own[k : k + 100])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids + [2] for e in library.encode_batch(own, add_special_tokens=False)]


def test_word_pieces_of_any_size_and_odd_letters(monkeypatch):
    import random

    r = random.Random(3)
    odd = [*" \t\n\r\x0b\x0c\x85\xa0\u3000\u0301\u030caeijIJéÉßİΣς×÷'st.,!7٣<|>)\"你𝒳", "<|endoftext|>", "'ll", "  ", "Word", " a"]
    own = ["".join(r.choices(odd, k=r.randint(0, 40))) for _ in range(3000)] + ["", " ", "\n"]
    library = Tokenizer.from_file(WORD)
    library.no_truncation()
    want = [e.ids + [2] for e in library.encode_batch(own, add_special_tokens=False)]
    for size in (packing.PIECE_BYTES, 100, 7):
        monkeypatch.setattr(packing, "PIECE_BYTES", size)
        got = packing.WordEncoder(WORD, 2)(own)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    monkeypatch.setattr(packing, "MEMO_ENTRIES", 50)  # nothing is remembered for long
    encoder = packing.WordEncoder(WORD, 2)
    assert [np.frombuffer(x, "<u4").tolist() for k in range(0, len(own), 5) for x in encoder(own[k : k + 5])] == want
    assert encoder([None, ""]) == [(2).to_bytes(4, "little")] * 2 and encoder([]) == []


def test_whole_table_equals_libraries(spark):
    """op4, op6 and op9 over all documents against the libraries themselves."""
    import pyarrow.parquet as pq
    import sentencepiece

    from tidemark.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    piece, byte, word = sentencepiece.SentencePieceProcessor(model_file=PIECE), Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for t in (byte, word):
        t.no_truncation()
        t.no_padding()
    counts = {r.doc_id: r for r in queries.op4_token_counts(spark, sf).collect()}
    assert {k: (r.n_bytes, r.n_tokens, r.over_limit) for k, r in counts.items()} == {k: (len(t.encode()), n := len(piece.encode(t)), n > 4096) for k, t in rows.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {k: byte.encode(t, add_special_tokens=False).ids for k, t in rows.items()}
    want = {k: (len(x), sha(np.array(x, "<u4").tobytes()), sha(byte.decode(x, skip_special_tokens=False).encode())) for k, x in ids.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe_codec(spark, sf).collect()} == want
    ids = {k: word.encode(t, add_special_tokens=False).ids + [2] for k, t in rows.items()}
    seen = dict.fromkeys(rows, 0)
    for r in sorted(queries.op9_packing(spark, sf).collect(), key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
    assert seen == {k: len(x) for k, x in ids.items()}


@pytest.mark.parametrize("seed", range(5))
def test_packer(seed):
    rng = random.Random(seed)
    docs = [np.arange(rng.choice([1, 3, 300, 513, 4096, 4097, 9000, rng.randint(1, 6000)]), dtype="<u4").tobytes() for _ in range(60)]
    packer = packing.Packer(7)
    for k, ids in enumerate(docs):
        packer.add(k, ids)
    packer.finish()
    sequences, pieces = {}, {}
    for key, start, length, ids, n, sequence, offset, _ in packer.rows:
        assert len(ids) == 4 * length > 0 and 4 * n == len(docs[key])
        sequences.setdefault(sequence, []).append((offset, length))
        pieces.setdefault(key, []).append((start, ids))
    assert {k: b"".join(i for _, i in sorted(p)) for k, p in pieces.items()} == dict(enumerate(docs))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # no padding at all


def test_pack_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two three " * 2000), (3, "again")], "doc_id bigint, text string").repartition(2)
    rows = packing.pack(df, lambda: packing.WordEncoder(WORD, 2), digests=True).collect()
    assert sum(r.length for r in rows) == 1 + 1 + 6001 + 2
    one = next(r for r in rows if r.doc_id == 1)
    assert (one.length, one.ids_crc32, one.doc_tokens) == (1, zlib.crc32(b"\x02\0\0\0"), 1)
    assert packing.pack(df.limit(0), lambda: packing.WordEncoder(WORD, 2)).count() == 0


def test_step_groups_have_equal_token_counts(spark):
    rng = random.Random(3)
    texts = [(k, " ".join(["a"] * rng.choice([100, 400, 700, 1500, 3000, 6000]))) for k in range(1600)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(2)
    rows = packing.pack(df, lambda: lambda part: [b"\1\0\0\0" * (len(x) // 2 + 1) for x in part]).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.sequence_id >> 36, r.sequence_length), {}).setdefault(r.step_group, []).append(r.length)
    tokens = [[sum(g[k]) for k in sorted(g)] for g in groups.values()]
    assert all(n == packing.STEP_TOKENS for t in tokens for n in t[:-1]) and all(0 < t[-1] <= packing.STEP_TOKENS for t in tokens)
    assert len({k for g in groups.values() for k in g}) == sum(map(len, tokens)) and sum(len(t) > 2 for t in tokens) >= 4
