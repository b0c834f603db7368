"""The stages one after the other against plain versions on the smallest tables."""

import public_tokenizers
import pytest
import sentencepiece
from brute import components, cut_repeats, sha256
from compare import difference

import corpus_pipeline
from quillrank.llm import queries
from quillrank.session import pin


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.schema.names
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(pin(stage(spark, tables[-1], sf), name))
    assert all(t.schema.names == before for t in tables[:-1])
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    # Toxicity: clean labelled documents stay, most toxic ones of this small table go.
    gone = set(rows[0]) - set(rows[1])
    assert all(labels.get(i, 1) for i in gone)
    # Alike documents: the smallest id of each group stays.
    found = components([(i, r.text) for i, r in rows[1].items()])
    assert set(rows[2]) == {i for i, (_, c) in found.items() if i == c}
    # Repeated strings.
    cut = cut_repeats([(i, r.text) for i, r in rows[2].items()])
    want = {i: kept.decode("utf-8", "ignore") for i, (n, gone, _, kept) in cut.items() if not gone or kept.decode("utf-8", "ignore")}
    assert {i: r.text for i, r in rows[3].items()} == want
    assert all(r.n_chars == len(r.text) for r in rows[3].values())
    # Mixing only leaves documents out.
    assert set(rows[4]) <= set(rows[3]) and all(rows[4][i] == rows[3][i] for i in rows[4])
    assert len(rows[4]) > len(rows[3]) / 2
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in rows[4].items():
        ids = library.encode(r.text)
        assert rows[5][i].ids_sha256 == sha256(",".join(map(str, ids)).encode()) and rows[5][i].n_tokens == len(ids)
    assert set(rows[5]) == set(rows[4])
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, rows[5].values()))


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{n}" for n in range(40)) for x in "abc")
    rows = [(2, a, "x"), (2, b, "x"), (3, b, "x"), (4, a + " more", "x"), (2, a, "y"), (None, c, "x"), (None, c, "z"), (9, c, "x"), (5, None, "x"), (6, "", "x"), (6, "", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_alike(spark, frame, "").collect()), key=str)
    assert kept == sorted([(2, a), (2, b), (None, c), (5, None), (6, ""), (6, "")], key=str)
    whole = frame.where("doc_id >= 3 AND doc_id <> 6")
    kept = corpus_pipeline.one_of_alike(spark, whole, "")
    assert kept.columns == whole.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 9]
    assert corpus_pipeline.one_of_alike(spark, frame.limit(0), "").count() == 0


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_same_rows_as_sql(spark, sf, name):
    assert difference(queries.QUERIES[name](spark, sf), queries.CHECKS[name], sf) == ""
