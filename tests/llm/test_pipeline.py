"""The pipeline's stages against plain Python, each on its predecessor's rows."""
from collections import Counter

import corpus_pipeline as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import mixing
from shutterlake.llm.common import table, written

from .conftest import SCHEMA, SPACES, doc, words_of
from .test_operators import UPPER, groups, shingles


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, out = docs.columns, {}
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, sf), name)
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    start = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    language = {r["doc_id"]: r["text"] for r in out["language"]}
    assert all(start[i] == t for i, t in language.items()) and len(language) > 0.97 * len(start)

    key = lambda line: line.strip(SPACES).translate(UPPER)
    often = Counter(k for t in language.values() for k in {key(x) for x in t.split("\n")} if k)
    clean = {i: "\n".join(x for x in t.split("\n") if often[key(x)] < 10) for i, t in language.items()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out["line_dedup"]} == {i: (t, len(t)) for i, t in clean.items()}

    sets = {i: shingles(t, P.NEAR_WORDS) for i, t in clean.items()}
    ids = sorted(sets)
    links = [(i, j) for i in ids for j in ids if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= P.NEAR_PERCENT * len(sets[i] | sets[j])]
    of = groups(links)
    single = {i: t for i, t in clean.items() if of.get(i, i) == i}
    assert {r["doc_id"]: r["text"] for r in out["ngram_join"]} == single

    copies = Counter(r["doc_id"] for r in out["mixing"])
    assert set(copies) <= {i for i, t in single.items() if words_of(t)} and max(copies.values()) <= 3
    assert all(single[r["doc_id"]] == r["text"] for r in out["mixing"])

    # rounding: half a document for each shard, and each source has one shard here
    size, source = {i: len(words_of(t)) for i, t in single.items()}, {r["doc_id"]: r["source"] for r in out["ngram_join"]}
    exact = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame(out["ngram_join"], SCHEMA)).collect()}
    for s in set(source.values()):
        own = [i for i in source if source[i] == s]
        assert abs(sum(copies[i] * size[i] - exact[i] for i in own)) <= max(size[i] for i in own) / 2 + mixing.BLOCK

    pieces = Counter(r["doc_id"] for r in out["packing"] if r["piece"] == 0)
    assert pieces == copies


def test_near_copies_between_thresholds(spark):
    """One word of 50 differs: 43 of 51 four-word shingles (84 %), 41 of 51 five-word shingles (80 %). Two words that lie apart: not a near copy by either."""
    base = [f"w{i}" for i in range(50)]
    one, two = base[:25] + ["x"] + base[26:], base[:15] + ["y"] + base[16:35] + ["z"] + base[36:]
    texts = {1: " ".join(base), 2: " ".join(one), 3: " ".join(two)}
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    assert 100 * len(sets[1] & sets[2]) >= 80 * len(sets[1] | sets[2]) and 100 * len(shingles(texts[1]) & shingles(texts[2])) < 85 * len(shingles(texts[1]) | shingles(texts[2]))
    out = P.one_of_each_group(spark, spark.createDataFrame([doc(i, t) for i, t in texts.items()], SCHEMA), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_null_and_repeated_ids(spark):
    text = lambda w, n: " ".join(f"{w}{i}" for i in range(n))
    a, b, c, d, e = (text(w, 64) for w in "abcde")
    rows = [doc(None, a), doc(None, b), doc(None, b), doc(None, c + " x"), doc(7, c), doc(7, d), doc(7, d), doc(7, ""), doc(8, None), doc(None, ""), doc(9, d + " x"), doc(7, e, None), doc(7, e, "de"), (None, e, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = P.one_of_each_group(spark, docs, "").collect()
    want = [(None, a), (None, b), (7, c), (7, d), (7, ""), (8, None), (None, ""), (7, e)]
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(want)

    # one source: the mix takes each of its words once, in whole blocks of 64
    rows = [doc(None, a), doc(None, b), doc(None, b), doc(7, c), doc(7, text("f", 128)), doc(7, ""), doc(8, None), doc(8, d)]
    got = P.mixed(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert Counter(map(tuple, got)) == Counter(r for r in rows if r[1])


def test_stages_on_odd_rows(spark, odd, none):
    names = ["kept", "n_lines", "_id", "_lost", "_text", "_letters", "_copies", "_copy", "key", "row", "copies", "lang_pred", "score", "component_id", "size", "taken"]
    wide = odd.select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in P.STAGES:
        out = stage(spark, wide, "")
        got = out.collect()
        assert name == "packing" or (out.columns == wide.columns and all(r[n] == n for r in got for n in names))
        ids = {r["doc_id"] for r in got}
        if name == "language":
            assert not ids & {1, 2, 3}
        elif name == "line_dedup":
            assert len(got) == odd.count()
        elif name == "ngram_join":
            # 5 equals 4 but for case, 8 has one shingle more than 6, and 7 equals 6
            assert Counter(r["doc_id"] for r in got) == Counter({r["doc_id"] for r in odd.collect()} - {5, 7, 8})
        elif name == "mixing":
            assert Counter(r["text"] for r in got if r["doc_id"] is None).keys() <= {"no id here at all"} and not ids & {1, 2, 3}
        else:
            assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r["doc_id"] for r in odd.collect())
        assert stage(spark, none, "").count() == 0, name
    docs, empty = odd, none
    for name, stage in P.STAGES:
        docs, empty = written(stage(spark, docs, ""), name), written(stage(spark, empty, ""), name)
    assert empty.count() == 0


@pytest.mark.parametrize("doc_id", [None, 1])
def test_rows_stay_whatever_their_ids(spark, sf, doc_id):
    """All rows without an id, or with one: the language stage keeps the rows that it keeps otherwise."""
    docs = table(spark, sf, "documents")
    want = P.by_language(spark, docs, sf).select("text")
    got = P.by_language(spark, docs.withColumn("doc_id", F.lit(doc_id).cast("long")), sf).select("text")
    assert want.count() > 100 and want.exceptAll(got).count() + got.exceptAll(want).count() <= 0.03 * want.count()


def test_python_gets_small_batches(spark, none):
    """12 MB of texts in one task: a batch held all of them, several times in the JVM and in Python."""
    texts = spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("the cat sat on the mat "), F.repeat(F.lit("and so on "), 400), "id").alias("text"))

    def sized(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([batch.nbytes] * batch.num_rows)], ["doc_id", "text", "batch_bytes"])

    seen = texts.mapInArrow(sized, "doc_id long, text string, batch_bytes long")
    docs = seen.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("a").alias("source"), F.length("text").cast("long").alias("n_chars"), "batch_bytes")
    before = spark.conf.get(P.BATCH_BYTES)
    try:
        got = dict(P.STAGES)["language"](spark, docs, "").agg(F.count("*"), F.max("batch_bytes")).first()
        assert got[0] == 3000 and got[1] < 6e6
        for name, stage in P.STAGES:
            spark.conf.unset(P.BATCH_BYTES)
            stage(spark, none, "")
            assert spark.conf.get(P.BATCH_BYTES) == P.BATCH, name
    finally:
        spark.conf.set(P.BATCH_BYTES, before)
