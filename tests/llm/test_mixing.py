import pytest
from pyspark.sql import functions as F

from tidesift.llm.mixing import TOKENIZER, copies_of, mixing_rates, mixture, shares_reached, token_counts

WEIGHTS = [("a", 0.5, 4), ("b", 0.3, 1), ("c", 0.1, 1), ("none", 0.1, 2)]


def _sizes(spark):
    rows = [(i, "a", 10) for i in range(200)] + [(1000 + i, "b", 30) for i in range(400)] + [(5000 + i, "c", 50) for i in range(300)]
    rows += [(9000, None, 5), (9001, "extra", 5), (9002, "a", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_rates_shares_and_copies(spark):
    sizes, weights = _sizes(spark), spark.createDataFrame(WEIGHTS, "source string, target_share double, max_repeats int")
    rates = mixing_rates(sizes, weights)
    rate = {r.source: r.rate for r in rates.collect()}
    # the total is bound by a: 4 x 2000 tokens for 5/9 of it
    assert rate["a"] == pytest.approx(4) and rate["b"] == pytest.approx(14400 * 3 / 9 / 12000) and rate["c"] == pytest.approx(14400 / 9 / 15000)
    assert rate["none"] == rate["extra"] == rate[None] == 0
    mixed = mixture(sizes, rates)
    assert mixed.collect() == mixture(sizes, rates).collect()
    assert {r.n_copies for r in mixed.where("source = 'a'").collect()} == {4}
    report = {r.source: r for r in shares_reached(mixed, rates).collect()}
    assert all(abs(report[s].reached - share / 0.9) < 0.03 for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)))
    assert report["none"].used_tokens == 0 and sum(r.reached for r in report.values()) == pytest.approx(1)
    docs = sizes.withColumnRenamed("n_tokens", "rate").withColumn("copy_no", F.lit("x")).withColumn("n_copies", F.lit(0))
    copies = copies_of(docs, rates)
    assert copies.columns == ["doc_id", "source", "rate", "n_copies", "copy_no"]
    expected = sorted((r.doc_id, k) for r in mixed.collect() for k in range(1, r.n_copies + 1))
    assert sorted((r.doc_id, r.copy_no) for r in copies.collect()) == expected
    more = {r.source: r.rate for r in mixing_rates(sizes, weights, total_tokens=1e6).collect()}
    assert more["a"] == 4 and more["b"] == 1 and more["c"] == 1


def test_tokens(spark):
    import base64
    from pathlib import Path

    if not Path(TOKENIZER).exists():
        pytest.skip("no tokenizer here")
    docs = spark.createDataFrame([(1, "s", "hello world"), (2, "s", None), (3, None, ""), (4, "s", "<|endoftext|> é" * 3000)], "doc_id bigint, source string, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 9000
    assert base64.b64decode(Path(TOKENIZER).read_bytes().split()[0])


def test_empty(spark):
    sizes = _sizes(spark).limit(0)
    weights = spark.createDataFrame(WEIGHTS, "source string, target_share double, max_repeats int")
    rates = mixing_rates(sizes, weights)
    assert {r.rate for r in rates.collect()} == {0.0} and mixture(sizes, rates).count() == 0
    assert mixing_rates(_sizes(spark), weights.limit(0)).where("rate > 0").count() == 0
