"""Each SQL function against the Column function that it stands for, over odd values of every parameter's type."""
import itertools
import re

import pytest
from pyspark.sql import functions as F

from shutterlake.functions import scalars as S

TEXTS = [None, "", " ", "\t", "Anna\t", " Ab ", " x ", "+4 x", "\t5 x", "-2.5", "1.5.2", ".", "é É", "a.JPEG", "x.y.raf", "noext", ".jpg", "a.Jpg.RAF", 'xmp:Rating="4"', "<xmp:Rating>2</xmp:Rating>", 'xmp:Rating="9"', 'xmp:Rating="99999999999"', "a<b>&c", "#ff0A10", "#ff0a1", "0123456789abcdef-f3r2.jpg", "0.004", "2", "1", "1/1100", "200", "100%", "%", "3145728", '["a","b"]', '["a"', '{"from":1,"to":5}', "rate"]
VALUES = {
    "STRING": TEXTS, "DOUBLE": [None, 0.0, -1.0, 0.3, 1.0, 255.0, 1500.0, 1e300], "INT": [None, 0, 1, 2, 3, 5, 6, 8, 9, 4000], "BOOLEAN": [None, True, False],
    "ARRAY<INT>": [None, [], [255, 0, 10]], "ARRAY<STRING>": [None, [], ["a"], ["b", "a", "a"]], "ARRAY<DOUBLE>": [None, [0.0, 0.0], [1.0, 2.0], [-3.0, 0.5]], "MAP<STRING, STRING>": [None, {}, {"a": "1"}, {"a": "1", "b": "2"}],
}
HELPERS = {"xmp_number", "colour_listed", "rate_payload"}


def parameters(head):
    return re.findall(r"(\w+) ((?:ARRAY|MAP)<[^>]*>|\w+)(?:, |$)", head[head.index("(") + 1 : -1])


@pytest.mark.parametrize("head", [f[0] for f in S.SQL_FUNCTIONS if f[0].split("(")[0] not in HELPERS])
def test_pair(spark, head):
    S.register(spark)
    name, own = head.split("(")[0], parameters(head)
    column = getattr(S, S.TWINS.get(name, name))
    short = lambda kind: VALUES[kind] if len(own) < 3 else VALUES[kind][:7]
    rows = list(itertools.product(*[short(kind) for _, kind in own]))
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {kind}" for n, kind in own))
    if name == "days_from_civil":
        df = df.filter("y > 0 and m between 1 and 9 and d between 1 and 9")
    if name == "clipping_fingerprint":
        df = df.filter("hc is not null and sc is not null")
    arguments = [F.col(n) for n, _ in own]
    both = df.select(column(*arguments).alias("a"), F.expr(f"{name}({', '.join(f'`{n}`' for n, _ in own)})").alias("b"))
    odd = [(r["a"], r["b"]) for r in both.collect() if r["a"] != r["b"]]
    assert not odd and both.count()


def test_payload_and_photo_id(spark):
    S.register(spark)
    df = spark.createDataFrame([("rate", '{"from":1,"to":5}'), ("tags", '{"from":["a"],"to":[]}'), ("trash", "{}"), ("rate", "x"), ("rate", None)], "kind string, text string")
    rows = df.select(S.payload(F.col("kind"), F.col("text")).alias("p"), F.expr("rate_payload(kind, text)").alias("r")).collect()
    assert [r["p"]["rate"] for r in rows] == [r["r"] for r in rows] and tuple(rows[0]["p"]["rate"]) == (1, 5)
    assert rows[1]["p"]["tags"]["from"] == ["a"] and rows[1]["p"]["tags"]["to"] == [] and rows[2]["p"]["rate"] is None and rows[2]["p"]["tags"] is None
    ids = [r[0] for r in spark.createDataFrame([("/a/b",), ("/a/c",), ("/a/b",)], "path string").select(S.photo_id(F.col("path"))).collect()]
    assert ids[0] == ids[2] != ids[1] and all(re.fullmatch("[0-9a-f]{16}", i) for i in ids)
