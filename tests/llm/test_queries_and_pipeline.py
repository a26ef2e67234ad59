"""The registered queries against their SQL, and the pipeline stage by stage."""

import math

import pytest

import corpus_pipeline
from sitegauge.llm import queries

CONTRACT = {
    1: "doc_id n_tokens ids_sha256 decoded_sha256", 2: "doc_id n_assign n_access n_hex base_sha256 spans",
    3: "query_id rank vec_id score", 4: "page_id host path rule verdict", 5: "doc_id held_out score predicted",
    6: "doc_id fingerprint component_id", 7: "doc_id n_words n_base first_word last_word base_labels labels score",
    8: "doc_id held_out n_tokens n_known train_tokens base_score score",
    9: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    10: "doc_id size source_size target taken", 11: "doc_id n_features weight score rank", 12: "item_id rank doc_id score",
    13: "doc_id piece start length ids_crc32 sequence_id offset",
}


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, folder, duck):
    df = queries.QUERIES[name](spark, folder)
    assert set(CONTRACT[int(name.split("_")[0][2:])].split()) <= set(df.columns)
    if name not in queries.SQL:
        return
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(queries.SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def test_pipeline(spark, folder):
    """Each stage does to its input what its operator says."""
    from sitegauge.llm import bpe, mixing, secrets, simhash, toxicity
    from sitegauge.session import stage

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, step in corpus_pipeline.STAGES:
        kept.append(stage(step(spark, kept[-1], folder), "test-stage"))
    clean, single, safe, mix, encoded = kept[1:]
    assert all(x.columns == columns for x in kept[:5])
    ids = [sorted(r.doc_id for r in x.select("doc_id").collect()) for x in kept]

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, labels).collect() if r.predicted}
    assert set(ids[1]) == set(ids[0]) - toxic
    groups = simhash.near_copies(clean).collect()
    assert ids[2] == sorted({r.component_id for r in groups})
    assert ids[3] == ids[2]
    assert secrets.scan(safe).where("n_assign + n_access + n_hex > 0").count() <= secrets.scan(single).where(
        "n_assign + n_access + n_hex > 0").count() // 10
    assert safe.where("n_chars <> length(text)").count() == 0
    taken = mixing.mix(safe).collect()
    times = {r.doc_id: math.floor(r.taken / max(1, r["size"]) + 0.5) for r in taken}
    assert ids[4] == sorted(i for i, n in times.items() for _ in range(n))
    assert encoded.count() == mix.count()
    assert {"doc_id", "n_tokens", "ids"} <= set(encoded.columns)
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in mix.collect()}
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in encoded.collect())


def test_pipeline_on_odd_and_empty_tables(odd, empty, spark, folder):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(columns), empty.select(columns)):
        for name, step in corpus_pipeline.STAGES[:4]:
            docs = step(spark, docs, folder)
            assert docs.columns == columns
        docs.count()
