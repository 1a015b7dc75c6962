"""Density of token windows, against brute force over every window."""

from lodestar.operators import chunking
from pyspark.sql import functions as F

W = 16384


def brute(text):
    odd = [not (c.isalpha() or c in " \t\n\x0b\f\r") for c in text]
    if len(text) <= W:
        return bool(text) and sum(odd) >= 0.3 * len(text)
    now = sum(odd[:W])
    found = now >= 0.3 * W
    for i in range(W, len(text)):
        now += odd[i] - odd[i - W]
        found = found or now >= 0.3 * W
    return found


def test_token_dense_every_window(spark):
    texts = [
        "a " * 20_000 + "1;" * 9_000, "a " * 20_000, "1;" * 9_000 + "a " * 20_000, "a " * 15_001 + ";" * 4_916 + "é " * 15_000,
        "a " * 15_001 + ";" * 4_915 + "é " * 15_000, "😀" * 20_000, "日本" * 9_000, "", "ab1", "abc1", "x" * (W - 1) + ";" * 4_916, ";" * 4_915 + "x" * W,
    ]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "i int, t string")
    got = {r["i"]: (r["d"], r["b"]) for r in rows.select("i", chunking.token_dense(F.col("t")).alias("d"), chunking.chunk_budget(F.col("t"), 256).alias("b")).collect()}
    assert got.pop(99) == (None, 473)
    assert got == {i: (brute(t), 256 if brute(t) else 473) for i, t in enumerate(texts)}
    assert got[0] == (True, 256) and not got[1][0] and got[3][0] and not got[4][0]
