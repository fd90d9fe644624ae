import random

from manifold_spark.llm import quality_rules as Q


def test_one_text_holding_most_of_a_language_rejects_no_others(spark):
    rng = random.Random(5)
    words = "anin there the of heon stand erthe long river mountain under seven".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(150, 400))), "de") for i in range(200)]
    copied = "quick brown foxes jump over lazy dogs while vexed wizards pack my box with jugs of liquor " + " ".join(f"{a}{b}" for a in "kwxz" for b in "bcdfg")
    docs = spark.createDataFrame(rows + [(1000 + i, copied, "de") for i in range(700)], "doc_id long, text string, lang string").repartition(3)
    alone = {r.doc_id: r.log_perplexity for r in Q.judge(spark.createDataFrame([*rows, (1000, copied, "de")], docs.schema)).collect()}
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    assert sum(got[i].kept for i, *_ in rows) >= 0.98 * sum(not got[i].base_failed for i, *_ in rows) > 0
    assert all(abs(got[i].log_perplexity - x) < 1e-6 for i, x in alone.items())
