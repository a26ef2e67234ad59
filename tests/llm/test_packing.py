import random
from array import array
from zlib import crc32

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitegauge.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def content():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def check(docs, content, length=1024, **options):
    library = Tokenizer.from_str(content)
    rows = packing.pack(docs, content, length=length, **options).collect()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)] if len(ids) > length else [0, len(ids)]
        want += [(r.doc_id, n, a, b - a, crc32(array("I", ids[a:b]).tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    filled = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == filled.get(r.sequence_id, 0)  # gapless from 0
        filled[r.sequence_id] = r.offset + r.length
    assert all(n <= length for n in filled.values())
    return len(filled), -(-sum(filled.values()) // length)


def test_given_documents(spark, folder, content):
    sequences, least = check(spark.read.parquet(f"{folder}/documents.parquet"), content)
    assert sequences <= 1.02 * least + 2


@pytest.mark.parametrize("length", [1, 16, 1024])
def test_odd_rows(odd, empty, content, length):
    clash = odd.withColumns({n: F.lit(1) for n in ("number", "piece", "start", "length", "place", "first", "sequence_id", "done")})
    check(clash, content, length=length)
    assert packing.pack(empty, content, length=length).count() == 0


def test_texts_encode_as_the_library_does(content):
    library, ids_of = Tokenizer.from_str(content), packing.encoder(content)
    texts = ["", "  a  b\n\n c\t", "it's we'll 'S don''t", "<|endoftext|> x<|endoftext|>", "\x1c\x1d a\x85b\xa0c d　", "a\x0b\x0cb",
             "naïve façade 12½ ²³ Ⅷ ٣ x", "日本語 テスト 한국어", "\U0001f600 emoji", "ꟑ new letters", "é marks", " \n x \n\n", "9 99 a9b"]
    rng = random.Random(1)
    letters = "ab '\n\t.é9sdtßñЯ語, ’ＡA\x1f\xad"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert all(ids_of(t) == array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts)


def test_known_words_have_a_bound(content, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 2)
    library, ids_of = Tokenizer.from_str(content), packing.encoder(content)
    text = "a few more words than are kept, a few"
    assert ids_of(text) == array("I", library.encode(text).ids).tobytes()


def test_best_fit_takes_the_fullest_bin():
    assert [sorted(b) for b in packing.best_fit([6, 5, 4, 3, 2], 10)] == [[0, 2], [1, 3, 4]]
    assert packing.best_fit([], 10) == []
    rng = random.Random(3)
    sizes = [rng.randrange(1, 60) for _ in range(2000)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(2000)) and len(bins) <= -(-sum(sizes) // 100) + 3


@pytest.mark.parametrize("group", [3, 40, 600, 3000])
def test_rounds_up_the_tree(spark, group):
    """Every item is placed once at any group size, and rounds come near the packing of all items at once."""
    rng = random.Random(5)
    sizes = [rng.choice([rng.randrange(1, 30), rng.randrange(1, 1024)]) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "number bigint, length bigint").repartition(7)
    rows = packing.packed(items, group=group).collect()
    assert sorted(r.number for r in rows) == list(range(3000))
    filled = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + sizes[r.number]
    assert max(filled.values()) <= 1024
    if group >= 600:  # a share of the items that stands for all
        assert len(filled) <= 1.03 * len(packing.best_fit(sizes, 1024))
    again = packing.packed(items.repartition(3), group=group).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_sequences_hold_the_ids(spark, folder, content):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    library = Tokenizer.from_str(content)
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids + [2] for r in docs.collect()}
    starts = {(r.doc_id, r.piece): r.start for r in packing.pack(docs, content).collect()}
    seen = 0
    for r in packing.sequences(docs, content).collect():
        for p in r.pieces:
            start = starts[p.id, p.piece]
            assert r.ids[p.offset : p.offset + p.length] == ids[p.id][start : start + p.length]
            seen += p.length
        assert len(r.ids) == sum(p.length for p in r.pieces) <= 1024
    assert seen == sum(map(len, ids.values()))
