"""BPE encoding and token counts against the libraries they stand for."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from mensura.llm import bpe, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "abcdeth \n\t'sS.,0123é漢字😀́\xa0 \x1c\x85　ﬁ▁<>\r\x00"


def texts():
    rng = random.Random(5)
    odd = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    odd += [" ".join(rng.choice(words) for _ in range(50)) for _ in range(100)]
    return [*odd, "", " ", "   ", "a<|endoftext|>  b", "<|endoftext|>", "   <|endoftext|> x", "x" * 20_000, "ab" * 9_000, " " * 700, "▁", "<s></s>", "don't  we'll"]


def test_trie_encoding_is_the_librarys():
    from tokenizers import Tokenizer

    library, own, given = Tokenizer.from_file(BPE), bpe.TrieEncoder(BPE), texts()
    ids = [e.ids for e in library.encode_batch(given, add_special_tokens=False)]
    got = own.encode_batch(given)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == ids
    assert [own.decode(x).decode() for x in got] == [library.decode(i, skip_special_tokens=False) for i in ids]


def test_every_letter_splits_as_in_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BPE), bpe.TrieEncoder(BPE)
    given = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(1, 0x3000, 3) if not 0xD800 <= c < 0xE000]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(given)] == [e.ids for e in library.encode_batch(given, add_special_tokens=False)]


def test_ids_of_broken_letters_decode_as_in_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BPE), bpe.TrieEncoder(BPE)
    ids = [own.vocab[b"\xe6"], own.vocab[b"a"], own.vocab[b"\xff"]]
    assert own.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)


def test_encode_and_digests_over_a_table(spark):
    rows = [(1, "Hello world", "x"), (2, None, None), (2, None, None), (None, "", "y"), (4, "The the\nthe", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode(docs, BPE).collect()
    assert len(out) == 5 and {r["doc_id"]: r["decoded"] for r in out} == {1: "Hello world", 2: "", None: "", 4: "The the\nthe"}
    assert [len(r["ids"]) for r in out if r["doc_id"] == 2] == [0, 0]
    d = {r["doc_id"]: r for r in bpe.digests(docs, BPE).collect()}
    assert d[2]["n_tokens"] == 0 and d[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert d[4]["decoded_sha256"] == hashlib.sha256(b"The the\nthe").hexdigest()
    assert bpe.digests(docs.limit(0), BPE).count() == 0


def test_piece_counts_are_the_librarys():
    import sentencepiece

    library, given = sentencepiece.SentencePieceProcessor(model_file=PIECES), texts()
    assert token_counts.PieceCounter(PIECES).count(given) == [len(x) for x in library.encode(given, num_threads=1)]


def test_counts_over_a_table(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (3, ""), (5, "é " * 5000)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, PIECES).collect())
    assert got[:4] == [(1, 11, 2, False), (2, 0, 0, False), (3, 0, 0, False), (3, 0, 0, False)] and got[4][1] == 15000 and got[4][3]
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


def test_caches_begin_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 3)
    own, counter, given = bpe.TrieEncoder(BPE), token_counts.PieceCounter(PIECES), [f"word{i} more{i} text" for i in range(50)]
    assert [own.encode_batch([t])[0] for t in given] == bpe.TrieEncoder(BPE).encode_batch(given)
    assert [counter.count([t])[0] for t in given] == token_counts.PieceCounter(PIECES).count(given)


@pytest.mark.parametrize("a,b", [("the", "re"), ("in", "g"), ("x", "y")])
def test_pairs_that_stay_apart(a, b):
    own = bpe.TrieEncoder(BPE)
    i, j = own.vocab[a.encode()], own.vocab[b.encode()]
    merged = np.frombuffer(own.encode_words([a + b])[a + b], "<u4").tolist()
    assert own.beside(i, j) == (merged == [i, j])


def test_other_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "one two", "x", "y")], "doc_id long, text string, __text string, own_text string")
    assert bpe.digests(docs, BPE).columns[:3] == ["doc_id", "__text", "own_text"] and bpe.digests(docs, BPE).count() == 1
    assert token_counts.count_tokens(docs, PIECES).first()["own_text"] == "y"


def test_unknown_vocabularies_are_refused():
    import json

    with open(BPE, encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": None}, {"model": spec["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError):
            bpe.check(spec | change)
