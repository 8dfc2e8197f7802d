"""Names in one pass against one replacement after the other, and hashes of texts against plain ones."""

import random

from pyspark.sql import functions as F

from recollect.functions import text
from recollect.operators import memory


def one_by_one(column):
    out = F.regexp_replace(text.trimmed(column), f"(?: {text.SPACE}+|(?! ){text.SPACE}{text.SPACE}*)", " ")
    for pattern, name in text.NAMES:
        out = F.regexp_replace(out, f"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])", name)
    return F.regexp_replace(out, "(?i)mac os x(?![A-Za-z0-9_])", "macOS")


def test_names(spark):
    q = random.Random(2)
    words = [*text.SPELT, "SQLITE-vec", "sqlite-vector", "xmac os x", "Mac OS X", "mac", "os", "x", "node", "js", "Kotlin", "_", "9", "-", ".", " ", "  ", "\t", "\n", " ", "　", "$1", "\\", "é", "\U0001f600"]
    rows = [("".join(q.choice(words).swapcase() if q.random() < 0.2 else q.choice(words) for _ in range(q.randrange(12))),) for _ in range(3000)] + [(None,), ("",)]
    got = spark.createDataFrame(rows, "text string").select(text.normalized(F.col("text")).alias("a"), one_by_one(F.col("text")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and len({r["a"] for r in got}) > 1000


def test_names_are_looked_for_once(spark):
    assert str(text.normalized(F.col("text"))).count("regexp_replace") == 1


def test_seeds(spark):
    def plain(t):
        h = 0
        for i in range(0, len(raw := t.encode("utf-16-be")), 2):
            h = (h * 31 + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
        return h - 2**32 if h >= 2**31 else h

    texts = ["", "a", "\x00b", "é\U0001f600￿", "word " * 3000]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").select("text", text.fake_seed(F.col("text")).alias("h")).collect()
    assert [r["h"] for r in got] == [*map(plain, texts), None]


def test_a_memory_is_embedded_once(spark):
    times = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(body):
        times.add(1)
        return [float(len(body))]

    requests = spark.createDataFrame([("1",)] * 5 + [("3",)], "id string")
    rows = memory.reembedded(requests, spark.createDataFrame([("1", "abc"), ("2", "d")], "id string, text string"), embed).collect()
    assert sorted((r["id"], r["outcome"], r["embedding"]) for r in rows) == [("1", "embedded", [3.0])] * 5 + [("3", "missing", None)]
    assert times.value == 1
