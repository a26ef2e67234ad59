import random
import re

from sitegauge.llm import licenses


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()]
              for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def check(docs):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted(((r.doc_id, *base(r.text)) for r in docs.collect()), key=str)


def test_whole_test_table(spark, folder):
    check(spark.read.parquet(f"{folder}/documents.parquet"))


def test_odd_rows(odd, empty):
    check(odd)
    assert licenses.scan(empty).count() == 0


def test_random_phrases(make):
    draw = random.Random(6)
    pieces = "gnu general public license apache MIT cc by BY é x , . -".split()
    check(make([(i, " ".join(draw.choice(pieces) for _ in range(draw.randint(0, 40)))) for i in range(300)]))


def test_passages_with_words_added_and_left_out(make):
    text, label = licenses.PASSAGES[3]
    words = text.split()
    changed = words[:5] + ["also"] + words[5:12] + words[13:]
    docs = make([(1, "Intro. " + " ".join(changed).capitalize() + " Rest."), (2, " ".join(words[:6])), (3, " ".join(reversed(words)))])
    got = {r.doc_id: (r.labels, r.base_labels, r.score) for r in licenses.scan(docs).collect()}
    assert got[1][:2] == (label, "") and 0.6 <= got[1][2] < 1
    assert got[2] == got[3] == ("", "", 0.0)


def test_verbatim_passages(make):
    docs = make([(i, f"{t}.") for i, (t, _) in enumerate(licenses.PASSAGES)])
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert all(label in got[i][0].split(",") and got[i][1] == 1.0 for i, (_, label) in enumerate(licenses.PASSAGES))


def test_scrambled_passages_get_no_label(make):
    """The passage's word pairs in reverse order, or its words shuffled in threes, hold most of its grams and are no copy."""
    texts = []
    for t, _ in licenses.PASSAGES:
        words = t.split()
        texts.append(" ".join(w for i in reversed(range(len(words) - 1)) for w in words[i : i + 2]))
        parts = [words[i : i + 3] for i in range(0, len(words), 3)]
        random.Random(4).shuffle(parts)
        texts.append(" ".join(w for p in parts for w in p))
    base_labels = {i: base(t)[4] for i, t in enumerate(texts)}
    got = {r.doc_id: r.labels for r in licenses.scan(make(list(enumerate(texts)))).collect()}
    assert got == base_labels


def test_changed_passages_are_found_at_their_place(make, spark):
    known = licenses.templates(spark)
    for n, (text, label) in enumerate(licenses.PASSAGES):
        words = text.split()
        changed = ["before"] * (n * 7) + words[:4] + ["really"] + words[4:9] + words[10:] + ["after"] * 30
        docs = make([(1, " ".join(changed)), (2, " ".join(changed * 3))])
        found = licenses.spans(licenses.hits(docs, known, "doc_id", "text"), known).where("NOT phrase").collect()
        own = [r for r in found if r.label == label and r.key.startswith("1:")]
        assert [(r.start, r.end) for r in own] == [(n * 7, n * 7 + len(words))] and own[0].share < 1
        assert label in {r.label for r in found if r.key.startswith("2:")}
