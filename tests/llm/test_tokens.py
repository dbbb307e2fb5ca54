import hashlib
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe, tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "   ", "a", "don't we'll\n\n 'tis 's ''s x!'s", "'ll'lla 're've'", "a<|endoftext|>b <|endoftext|>", "  x　　y 12½ ３４ á 日本語 \U0001f469‍\U0001f469 \r\n\t end  ",
    "x" * 5000, "ab" * 3000, "<|endoftext|>", "aaaa aaa aa " * 5, "I'M I'm can'T O'Really o'really '", "\x1c\x1d \x85z", "1234567890" * 30, " lead", "trail \n", "a b c d", "Ᲊᲊ ꟍ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def lexicon():
    words = [b"the", b" the", b" of", b" and", b"don", b" end", b" a", b"x", b" aaaa", "日本語".encode()]
    return bpe.Lexicon, bpe.Lexicon.compile(words, bpe.vocabulary(PATH)), words


def check(texts, library, lex=None):
    vocab = bpe.vocabulary(PATH)
    ids, bounds = bpe.encode(texts, vocab, lex)
    for i, text in enumerate(texts):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids[bounds[i] : bounds[i + 1]].tolist() == expected, text
        assert vocab.decode(np.array(expected, np.int64)).decode() == library.decode(expected, skip_special_tokens=False)


def test_odd_texts(library):
    check(ODD, library)
    encoder = tokenfile.LibraryEncoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(ODD)] == [library.encode(t, add_special_tokens=False).ids for t in ODD]


def morse(n):
    """The Thue-Morse word of n letters and its complement: polynomials modulo 2^64 have one value for both."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 8192])
def test_words_that_share_a_polynomial(library, n):
    check([*morse(n), " ".join(morse(n))], library)


def test_words_that_share_a_hash(library, monkeypatch):
    """Whatever the hash, words are told apart by their bytes."""
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    check(ODD, library)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(string.printable + "éßя日'  \n"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_any_texts(texts):
    library = Tokenizer.from_file(PATH)
    check(texts, library)
    encoder = tokenfile.encoder_of(PATH)
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_lexicon_file(library, lexicon, folder):
    kind, raw, words = lexicon
    with open(f"{folder}/lex", "wb") as f:
        f.write(raw)
    lex = kind.load(f"file://{folder}/lex")
    check(ODD, library, lex)
    data = b"".join(sorted(words)) + b"none"
    bounds = np.cumsum([0, *[len(w) for w in sorted(words)], 4])
    assert lex.find(np.frombuffer(data, np.uint8), bounds).tolist() == [*range(len(words)), -1]


def test_automaton_shares_suffixes():
    words = sorted(a + b"tion" for a in (b"na", b"mo", b"ra", b"sta"))
    assert len(bpe.minimal_automaton(words)["final"]) < sum(map(len, words)) / 2


def test_codec_over_edge_cases(spark, edge, empty, library):
    rows = bpe.code_documents(edge, PATH).collect()
    texts = {r.doc_id: r.text or "" for r in edge.collect()}
    assert len(rows) == edge.count() and bpe.code_documents(empty, PATH).count() == 0
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(edge, PATH), PATH).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((k or -1, texts[k]) for r in edge.select("doc_id").collect() for k in [r.doc_id])


def test_token_files(spark, edge, empty, library, folder):
    rows = sorted(tokenfile.token_files(edge, PATH).collect(), key=lambda r: r.start)
    order = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in edge.collect())
    start = 0
    for r, (key, text) in zip(rows, order, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) == (key[1], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.token_files(empty, PATH).count() == 0
    tokenfile.write_tokens(edge, PATH, f"file://{folder}/t", 3)
    assert tokenfile.lookup(spark, f"file://{folder}/t", 7) == [*library.encode("x", add_special_tokens=False).ids, 0]
    assert tokenfile.lookup(spark, f"file://{folder}/t", 2, 1) is not None and tokenfile.lookup(spark, f"file://{folder}/t", 2, 2) is None
    assert tokenfile.lookup(spark, f"file://{folder}/t", 77) is None


def test_perfect_hash_is_minimal():
    keys = tokenfile.mix(np.arange(20_000, dtype=np.uint64))
    slots = tokenfile.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
