import hashlib
import random
from array import array

import pytest

from sitegauge.llm import bpe
from sitegauge.llm.queries import op1_bpe_tokens, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(tokenizer_path())
    found.no_padding()
    found.no_truncation()
    return found


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.compile_automaton(tokenizer_path()))


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_query_agrees_with_the_library(spark, folder, library, texts):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op1_bpe_tokens(spark, folder).collect()}
    assert got == {i: expected(library, t) for i, t in texts}


@pytest.mark.parametrize("text", [
    "", "aaaa aaa aaaaaaaaaaa", "ababababab bababa", "don't WE'LL i've 12345 ½²", "<|endoftext|>x<|startoftext|> <|endoftext|>",
    "ΑΣ ΣΑΣ İstanbul ẞ", "e\u0301 \u00e9 \u212b", "a\x1cb\x85c\u200bd \x00", "\U0001f600\U0001f600!!??..", "x" * 3000,
])
def test_single_texts(text, library, encoder):
    assert list(array("I", encoder.ids(text))) == library.encode(text, add_special_tokens=False).ids


def test_random_words(library, encoder):
    draw = random.Random(3)
    for alphabet in ("ab", "theinoras", "aeiou'!", "äöüéßñ"):
        text = " ".join("".join(draw.choice(alphabet) for _ in range(draw.randint(1, 90))) for _ in range(300))
        assert list(array("I", encoder.ids(text))) == library.encode(text, add_special_tokens=False).ids


def test_every_encoding_is_a_path_of_arcs(encoder):
    automaton = encoder.automaton
    for word in ("hello", "internationalization", "zzzzqqqq", "thththth"):
        ids = array("I", automaton.encode_word(word))
        assert all(automaton.arc(s, t) for s, t in zip(ids, ids[1:]))
        assert "".join(automaton.labels[i] for i in ids) == word + bpe.WORD_END


def test_odd_rows(odd, empty, library):
    path = tokenizer_path()
    got = bpe.encode(odd, path)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    key = lambda x: (str(x[0]), *x[1:])
    mine = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()), key=key)
    assert mine == sorted(((r.doc_id, *expected(library, r.text)) for r in odd.collect()), key=key)
    assert bpe.encode(empty, path).count() == 0


def test_decode(spark, library):
    path = tokenizer_path()
    rows = [(1, library.encode("Hello, <|endoftext|> world").ids), (2, []), (3, None)]
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"), path).collect()}
    assert got == {1: library.decode(rows[0][1], skip_special_tokens=False), 2: "", 3: None}
