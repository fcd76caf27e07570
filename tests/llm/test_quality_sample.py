import random

import numpy as np
from callatlas.llm import quality as Q
from test_quality import bad, good


def test_copies_leave_the_sample_full(spark, monkeypatch):
    rng = random.Random(4)
    rows = [good(rng) for _ in range(4000)] + [bad(rng) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in rows + [rows[-1]] * 1500], "text string")
    seen = []
    monkeypatch.setattr(Q, "logistic", lambda x, y, balance: seen.append(y) or (np.zeros(Q.WIDTH), 0.0))
    Q.train_quality(docs, sample=20)
    assert (seen[0] <= 0.5).sum() == 20
