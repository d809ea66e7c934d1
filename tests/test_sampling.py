import math

import pytest
from pyspark.sql import functions as F

from chatframe.operators.sampling import assign_folds, ranked, split_train_test
from chatframe.operators.topn import top_rows
from chatframe.operators.training import training_sample


@pytest.fixture(scope="module")
def rows(spark):
    # one label holds most of the rows
    return spark.range(3000).selectExpr(
        "'c' as chat_id", "id as msg_seq", "if(id % 10 < 7, 'Neutral', if(id % 10 < 9, 'Positive', 'Negative')) as sentiment_label"
    )


def test_ranks_are_the_global_hash_order(rows):
    got = ranked(rows, "sentiment_label", "p").collect()
    by_label = {}
    for r in rows.withColumn("h", F.expr("md5(concat('p|42|', chat_id, '|', msg_seq))")).collect():
        by_label.setdefault(r["sentiment_label"], []).append((r["h"], r["msg_seq"]))
    for r in got:
        order = sorted(by_label[r["sentiment_label"]])
        assert order[r["rank"] - 1][1] == r["msg_seq"]
        assert r["class_size"] == len(order)


def test_layout_does_not_matter(rows):
    one = ranked(rows.coalesce(1), "sentiment_label", "p", limit=50)
    many = ranked(rows.repartition(9), "sentiment_label", "p", limit=50)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert one.count() == 150


def test_split_and_folds(rows):
    few = rows.filter("msg_seq < 233")
    parts = split_train_test(few).groupBy("part").count().collect()
    assert dict(map(tuple, parts))["test"] == math.ceil(233 * 0.2)
    sizes = assign_folds(few).groupBy("sentiment_label", "fold").count().collect()
    for label in {r[0] for r in sizes}:
        counts = [r[2] for r in sizes if r[0] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_tiers(spark):
    def scored(n_high, n_medium, n_low):
        cells = []
        for tier, n in (("High", n_high), ("Medium", n_medium), ("Low", n_low)):
            cells += [(tier, "Positive" if i % 3 else "Negative") for i in range(n)]
        data = [("c", i, "word", label, tier, False, False) for i, (tier, label) in enumerate(cells)]
        return spark.createDataFrame(
            data, "chat_id string, msg_seq long, cleaned_message string, sentiment_label string,"
            " sentiment_confidence string, is_media boolean, is_deleted boolean",
        )

    def sizes(df, n=300):
        return dict(map(tuple, training_sample(df, n).groupBy("sentiment_label").count().collect()))

    assert sizes(scored(60, 30, 30)) == {"Positive": 20, "Negative": 20}
    assert sizes(scored(60, 30, 30), 7) == {"Positive": 7, "Negative": 7}
    assert sizes(scored(15, 21, 30)) == {"Positive": 12, "Negative": 12}
    assert sizes(scored(3, 3, 30)) == {"Positive": 12, "Negative": 12}


def test_top_rows_in_parts(spark):
    df = spark.range(6000).selectExpr("id % 2 as g", "cast(id as string) as t", "pmod(hash(id), 500) as n")
    order = [F.desc("n"), F.col("t")]
    got = top_rows(df, ["g"], order, 1500, key="t")
    want = {}
    for r in df.collect():
        want.setdefault(r["g"], []).append((-r["n"], r["t"]))
    rows = got.collect()
    assert len(rows) == 3000
    for r in rows:
        assert sorted(want[r["g"]])[r["rank"] - 1] == (-r["n"], r["t"])
