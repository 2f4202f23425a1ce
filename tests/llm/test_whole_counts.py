"""The quality model is counted over all trusted documents of its half, however many there are."""

from pyspark.sql import functions as F

from hourgrain.llm import quality


def test_counts_come_from_all_trusted_documents(spark, monkeypatch):
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), F.lit("en").alias("lang"))
    seen, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda texts: seen.append(texts.count()) or train(texts))
    judged = quality.classify(docs, docs.select("doc_id"))
    half = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).count()
    assert half > 800 and seen == [half] and judged.count() == 2500


def test_keys_travel_in_parts(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, None)], "id bigint, text string")
    parts = [[tuple(r) for r in quality.keys(docs, part).collect()] for part in range(quality.SLICES)]
    found = [r for part in parts for r in part]
    assert all(r[1] % quality.SLICES == part for part, rows in enumerate(parts) for r in rows)
    # text 1: 6 trigrams (places), 7 pairs, words BEGIN a b c END; text 2: 1, 2 and 2
    assert sum(r[2] for r in found if r[0] == 1) == 6 + 7 + 7 and sum(r[2] for r in found if r[0] == 2) == 1 + 2 + 2
    assert sum(r[0] == 1 for r in found) == 6 + 7 + 5  # words once each


def test_words_are_not_broadcast(spark, monkeypatch):
    """The table of words grows with the texts, so it meets the pairs by a shuffle, in every part."""
    plans, plain = [], quality.values

    def values(*args):
        out = plain(*args)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(quality, "values", values)
    texts = spark.createDataFrame([("a b a b c",), ("b c",)], "text string")
    model, unseen = quality.train(texts)
    assert len(plans) == quality.SLICES and not any("broadcast" in p for p in plans)
    assert unseen < 0 and model.count() > 0


def test_frequent_middle_words_are_counted_by_joins_with_the_same_values(spark, monkeypatch):
    texts = spark.createDataFrame([("a b a b c",), ("b c " * 9 + "Zoë " + "x" * 70,), (None,), ("a  b\n\tc a d b",)], "text string")
    model = lambda: sorted((r["key"], round(r["value"], 9)) for r in quality.train(texts)[0].collect())
    packed = model()
    asked, plain = [], quality.frequent
    monkeypatch.setattr(quality, "HOT", 3)
    monkeypatch.setattr(quality, "frequent", lambda texts: asked.append(plain(texts)) or asked[0])
    assert model() == packed and len(packed) > 20 and 0 < len(asked[0]) < 6


def test_lookups_travel_packed(spark):
    """A row for each batch and bucket, not one for each key; a word's hash is its bytes' alone."""
    rows = quality.asked(spark.createDataFrame([(i, "a b c d e " * 50) for i in range(40)], "id bigint, text string").coalesce(1), 0, 2).collect()
    assert len(rows) <= 2 and sum(len(r["keys"]) // 8 for r in rows) > 1000
    own, counts = quality.hashed(["Ab ab\x0bcd", None, "", " cd " + "y" * 200 + " " + "y" * 201])
    assert counts.tolist() == [3, 0, 0, 3] and own[0] == own[1] and own[2] == own[3] and len(set(own.tolist())) == 4
