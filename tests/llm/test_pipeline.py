from collections import Counter

import corpus_pipeline as C
import pyarrow as pa
from pyspark.sql import functions as F

from chronostrata.llm import mixing, pii, probminhash, toxicity
from chronostrata.llm.sentencepiece_codec import MODEL


def test_run_against_a_plain_program(spark, sf, documents, labels):
    import sentencepiece

    from .test_mixing import brute
    from .test_probminhash import components

    rows = [r.asDict() for r in documents.collect()]
    model = toxicity.train(documents, labels)
    score = toxicity.Scorer(model)
    rows = [r for r in rows if score(pa.array([r["text"]]))[0] <= model[3]]
    sets = probminhash.weighted(pa.array([r["text"] for r in rows]))
    pairs = [(rows[i]["doc_id"], rows[j]["doc_id"]) for i in range(len(rows)) for j in range(i) if probminhash.probability_jaccard(sets[i], sets[j]) >= probminhash.THRESHOLD]
    root = components(pairs)
    rows = [r for r in rows if root.get(r["doc_id"], r["doc_id"]) == r["doc_id"]]
    for r in rows:
        r["text"] = pii.replaced(r["text"], pii.spans(r["text"]))
    drawn = brute([(r["doc_id"], r["source"], r["text"]) for r in rows], mixing.MAX_REPEAT)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = {r["doc_id"]: tuple(library.encode(r["text"])) for r in rows}
    want = Counter((i, ids[i]) for (i, *_), n in drawn.items() for _ in range(n))
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in C.run(spark, sf).collect())
    # banding may miss a pair near the threshold; here it misses none
    assert got == want


def test_stages_keep_the_columns(spark, sf, odd, none):
    for docs in (odd, none):
        df = docs
        for name, stage in C.STAGES[:-1]:
            df = stage(spark, df, sf)
            assert df.columns == odd.columns, name
        assert C.STAGES[-1][1](spark, df, sf).count() == df.count()


def test_a_run_leaves_the_last_table_alone(spark, sf):
    import os

    from chronostrata.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = C.run(spark, sf)
    left = [x for x in os.listdir(folder) if x not in before]
    assert len(left) == 1 and left[0].startswith("mixing") and out.count() > 100


def test_ids_of_text_pass_through_all_stages(spark, sf, documents, labels):
    docs = documents.withColumn("doc_id", F.format_string("n%06d", "doc_id")).unionByName(documents.limit(3).withColumn("doc_id", F.lit("n000000")))
    df = docs
    for name, stage in C.STAGES:
        df = stage(spark, df, sf)
        if name != "tokens":
            assert df.schema["doc_id"].dataType.typeName() == "string" and df.columns == documents.columns
    assert df.select("doc_id").distinct().count() > 100
    # labels of other ids: none is used, nothing is rejected
    assert toxicity.keep_clean(docs, labels).count() == docs.count()
