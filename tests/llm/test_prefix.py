"""The second comparison of near-duplicates holds every pair that agrees."""

import random

from corpusloom.llm import neardup
from pyspark.sql import functions as F


def test_prefix_pairs_leave_no_link_out(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(100000)}"
    texts = []
    for family in range(4):
        base, common = [word() for _ in range(60 + 40 * family)], [word() for _ in range(50)]
        for k in range(14):
            w = list(base)
            for _ in range(k % 6):
                w[rng.randrange(len(w))] = word()
            texts.append(w + common if family % 2 else w)
            # A passage that many share, with words of its own: alike in parts, but no copies.
            texts.append(common + [word() for _ in range(30 + 3 * k)])
    texts = sorted({" ".join(w) for w in texts})
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    true = {(b, a) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = neardup.sketch(docs)
    of = own.select(F.col("id").alias("node"), F.col("id").alias("rep"), "k1", "k2")
    members = own.select(F.col("id").alias("node"), "n", F.col("id").alias("comp"))
    found = [(r.a, r.b) for r in neardup.prefix_pairs(members, docs, of).collect()]
    assert len(true) > 50 and true <= set(found)
    assert len(found) == len(set(found))
