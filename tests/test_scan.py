import random

import pandas as pd
from pyspark.sql import functions as F

from wattloom.functions import scan


def _frame(spark, n=3000, seed=3):
    """One key holds two thirds of the rows; order is shuffled on arrival."""
    rng = random.Random(seed)
    rows = [(("hot" if rng.random() < 0.66 else rng.choice("abc")), i, rng.randrange(50), rng.choice("xyz")) for i in range(n)]
    pdf = pd.DataFrame(rows, columns=["key", "seq", "v", "s"])
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).withColumn("chunk", F.floor(F.col("seq") / 97))
    return pdf.sort_values("seq"), df


def _got(df, col):
    return df.select("key", "seq", F.col(col).alias("x")).toPandas().sort_values("seq").reset_index(drop=True)["x"]


def test_running_sum_equals_plain_cumulation(spark):
    pdf, df = _frame(spark)
    want = pdf.groupby("key")["v"].cumsum().reset_index(drop=True)
    assert _got(scan.running_sum(df, ["key"], "chunk", ["seq"], "v", "out"), "out").tolist() == want.tolist()


def test_previous_max_and_neighbours(spark):
    pdf, df = _frame(spark)
    want = pdf.groupby("key")["v"].transform(lambda x: x.cummax().shift(1)).reset_index(drop=True)
    got = _got(scan.previous_max(df, ["key"], "chunk", ["seq"], "v", "out"), "out")
    assert got.fillna(-1).tolist() == want.fillna(-1).tolist()
    for fn, shift in ((scan.previous_row, 1), (scan.next_row, -1)):
        want = pdf.groupby("key")["s"].shift(shift).reset_index(drop=True)
        out = fn(df, ["key"], "chunk", ["seq"], ["s"], "o").withColumn("out", F.col("o.s"))
        assert _got(out, "out").fillna("-").tolist() == want.fillna("-").tolist()


def test_islands_number_runs_of_equal_label(spark):
    pdf, df = _frame(spark)
    change = pdf.groupby("key")["s"].transform(lambda x: (x != x.shift(1)).astype(int).cumsum()).reset_index(drop=True)
    assert _got(scan.islands(df, ["key"], "chunk", ["seq"], F.col("s"), "out"), "out").tolist() == change.tolist()


def test_exact_median_of_skewed_keys(spark):
    pdf, df = _frame(spark)
    pdf = pdf.assign(v=pdf["v"] / 4)
    got = scan.exact_median(df.withColumn("v", F.col("v") / 4), ["key"], "v", 2.0).toPandas().set_index("key")["median"].to_dict()
    assert got == pdf.groupby("key")["v"].median().to_dict()
