"""The decision does not depend on how much of each class the bounded sample holds."""

import random

from tidewright.llm import toxicity


def test_bounded_sample_keeps_the_class_balance(spark):
    rng, rows, marks = random.Random(4), [], []
    for k in range(1500):
        bad = k % 10 == 0
        w = [f"w{rng.randrange(50)}" for _ in range(20)]
        if bad or rng.random() < 0.2:  # in all toxic rows and a fifth of the others: toxic in 36 of 100 cases
            w.insert(rng.randrange(len(w)), "grumblefex")
        rows.append((k, " ".join(w)))
        marks.append((k, int(bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "w1 w2 grumblefex w3")], "doc_id long, text string")
    whole, part = (toxicity.severity(probe, toxicity.fit(df, labels, max_each=n)).first() for n in (4000, 90))
    assert not whole["toxic"] and not part["toxic"]
    assert abs(whole["p_toxic"] - part["p_toxic"]) < 0.2
