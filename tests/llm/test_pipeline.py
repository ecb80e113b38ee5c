import re

import sentencepiece
from cases import SMALL, documents, edge_rows, empty, texts
from test_exact import brute as exact_brute
from test_minhash import brute as near_brute
from test_mixture import brute_targets, count

import __spark_entry__ as entry
import corpus_pipeline
from patronly.llm.queries import PIECE_MODEL

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_over_small_corpus(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, alive = docs.columns, texts(spark, SMALL)

    docs = STAGES["language_id"](spark, docs, SMALL)
    alive = {i: t for i, t in alive.items() if re.search(r"[^\W\d_]", t or "")}
    assert docs.columns == columns and {r[0] for r in docs.select("doc_id").collect()} == alive.keys()

    docs = STAGES["exact_dedup"](spark, docs, SMALL)
    alive = {i: alive[i] for i in {b[1] for b in exact_brute(alive.items())}}
    assert docs.columns == columns and sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(alive)

    docs = STAGES["minhash_near_dedup"](spark, docs, SMALL)
    alive = {b[0]: alive[b[0]] for b in near_brute(list(alive.items())) if b[2]}
    assert docs.columns == columns and sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(alive)

    sizes, got, source = {}, {}, {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    for i, t in alive.items():
        sizes[source[i]] = sizes.get(source[i], 0) + count(t)
    docs = STAGES["mixture"](spark, docs, SMALL)
    assert docs.columns == columns
    mixed = docs.collect()
    for r in mixed:
        got[r["source"]] = got.get(r["source"], 0) + count(r["text"])
    for s, target in brute_targets(sizes).items():
        assert abs(got[s] - target) <= 0.5

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    done = STAGES["sentencepiece"](spark, docs, SMALL).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in done) == sorted((r["doc_id"], library.encode(r["text"])) for r in mixed)
    assert all(r["parity"] and r["round_trip"] for r in done)


def test_edges_pass_through_all_stages(spark):
    for docs in (documents(spark, edge_rows()), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            last = name == "sentencepiece"
            done = stage(spark, docs, SMALL)
            if not last:
                assert done.columns == docs.columns
            docs = spark.createDataFrame(done.collect(), done.schema)
    assert docs.count() == 0


def test_statements_equal_queries(spark):
    from compare import compare, duck

    connection = duck(SMALL)
    for name in ("op3_exact_dedup", "op8_chat_format", "op12_prefix_trie", "op13_hilbert_shards"):
        assert compare(spark, connection, SMALL, name, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_every_operator_has_its_query():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
