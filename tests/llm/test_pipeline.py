import brute
import corpus_pipeline
from palimpsest.llm import pii, queries, tokens

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.dtypes == docs.dtypes, name
            docs = spark.createDataFrame(made.collect(), made.schema)
            kept[name] = docs.collect()
    good = kept["quality rules"]
    assert good and not any(brute.quality_base(r.text)[-1] for r in good)
    found = brute.ngram_components([(r.doc_id, r.text) for r in good], 5, 80)
    assert sorted(r.doc_id for r in kept["n-gram Jaccard join"]) == sorted({c for _, _, c in found})
    assert not any(brute.pii_spans(r.text) for r in kept["PII"])
    assert made.count() > 0


def test_run_packs_everything(spark):
    pieces = corpus_pipeline.run(spark, SF)
    filled = [r["sum(length)"] for r in pieces.groupBy("sequence_id").sum("length").collect()]
    assert all(n <= 4096 and (n == 4096 or n & (n - 1) == 0) for n in filled)


def test_every_query_is_registered():
    assert sorted(int(x[2:].split("_")[0]) for x in queries.QUERIES) == list(range(1, 14))
    assert pii.BASE_KINDS == tuple(brute.PII) and tokens.TOKENIZER == "word_bpe_49k.json"
