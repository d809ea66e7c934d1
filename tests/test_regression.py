"""Logistic regression has no SQL form: its fit must be the optimum of the objective."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatframe.operators import training as tr

WORDS = {
    "Positive": ["love", "great", "happy", "fun"],
    "Negative": ["hate", "awful", "sad", "mess"],
    "Neutral": ["meet", "train", "clock", "table"],
}


def sample(spark, labels):
    rows = []
    for i in range(60):
        label = labels[i % len(labels)] if i % 7 else labels[0]
        own, other = WORDS[label], WORDS[labels[(i + 1) % len(labels)]]
        text = f"{own[i % 4]} {own[(i // 4) % 4]} {other[i % 4]} filler{i % 3}x"
        rows.append(("c", i, text, label))
    return spark.createDataFrame(
        rows, "chat_id string, msg_seq long, cleaned_message string, sentiment_label string"
    )


@pytest.mark.parametrize("labels", [["Negative", "Positive"], ["Negative", "Neutral", "Positive"]])
def test_gradient_is_zero(spark, labels):
    s = sample(spark, labels)
    runs = tr.runs_of(s).filter("run = 0").cache()
    counts = tr.term_counts(s)
    vocab = tr.vocabulary(counts, runs)
    train = tr.regression_rows(tr.features(counts, runs, vocab), runs).filter(F.col("part") == "train").cache()
    model = tr.fit_regression(train, labels)
    rows = train.collect()
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([labels.index(r["sentiment_label"]) for r in rows])
    weight = np.array([len(y) / (len(labels) * np.sum(y == c)) for c in y])
    coefficients, intercept = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    margins = x @ coefficients.T + intercept
    if len(labels) == 2:
        p = 1 / (1 + np.exp(-margins[:, 0]))
        error = (weight * (p - (y == 1)))[:, None]
    else:
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        error = weight[:, None] * (p - np.eye(len(labels))[y])
    gradient = tr.REGRESSION_C * error.T @ x + coefficients
    assert np.abs(gradient).max() < 2e-2
    assert np.abs(error.sum(axis=0)).max() < 2e-2
    length = np.linalg.norm(x, axis=1)
    assert np.allclose(length[length > 0], 1)


def test_too_little_data(spark):
    with pytest.raises(ValueError, match="training rows"):
        tr.train_classifier(sample(spark, ["Negative", "Positive"]).limit(10))
    with pytest.raises(ValueError, match="two labels"):
        tr.train_classifier(sample(spark, ["Negative", "Positive"]).filter("sentiment_label = 'Negative'"))
