"""Every stage of the pipeline against a plain version of its decision, on its own input."""

import collections

import corpus_pipeline
from chatframe.llm import mixing, toxicity
from chatframe.llm.common import stored, table

from . import plain

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    benchmark = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        after = stored(stage(spark, docs, FOLDER), name)
        got = collections.Counter(r["doc_id"] for r in after.collect())
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, FOLDER, "labels"))
            want = collections.Counter(i for i, t in before if model.score(t)[0] < 0.5)
        elif name == "near_duplicates":
            _, of = plain.simhash(before)
            want = collections.Counter(min(before[a][0] for a in range(len(before)) if of[a] == c) for c in set(of))
        elif name == "decontamination":
            want = collections.Counter(r[0] for r in plain.benchmark_hits(before, benchmark) if not r[5])
        elif name == "mixing":
            want = collections.Counter({r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs).collect() if r["copies"]})
        else:
            want = collections.Counter(i for i, _ in before)
            assert [r["doc_id"] for r in after.orderBy("start").collect()] == sorted(i for i, _ in before)
        assert got == want, name
        if name != "token_ids":
            assert after.columns == columns
        docs = after


def test_odd_documents(spark, tmp_path):
    """Null ids and texts, equal rows and a column with a name from inside go through all stages."""
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, None, None), (2, "", "y"), (None, "a b c d e", "x")]
    for name in ("labels", "benchmark"):
        table(spark, FOLDER, name).write.parquet(f"{tmp_path}/{name}.parquet")
    for some in (rows, []):
        docs = spark.createDataFrame(some, "doc_id long, text string, source string").selectExpr("*", "'en' as lang", "1 as _hits", "2 as doc")
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() <= 2 * len(some)
