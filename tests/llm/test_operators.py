"""The ten operators against plain Python on small tables, with odd rows, and on no rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


from shutterlake.llm import chat_format, language_id, line_dedup, mixing, ngram_join, packing, quality_resampling, quality_rules, spot_signatures, text_arrays, toxicity
from shutterlake.llm.common import components, table

from .conftest import SPACES, words_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def shingles(text, n=4):
    w = words_of((text or "").translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_words_match_regex():
    texts = ["", " a  b\tc ", "é ü\x0bß", "x", None, "a" * 5000 + " b"]
    (_, _, data, offsets), = text_arrays.slices(pa.array(texts))
    words = text_arrays.Words(data, offsets)
    got = [[bytes(data[s:e]).decode() for s, e in zip(words.start[a:b], words.end[a:b])] for a, b in zip(words.first[:-1], words.first[1:])]
    assert got == [words_of(t) for t in texts]
    h = words.hashes(True)
    assert len(set(h.tolist())) == len({w.lower() for t in texts for w in words_of(t)})


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2000 + i) for i in range(1, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = groups(e for e in edges if e[0] != e[1])
    assert got == want


@pytest.mark.parametrize("block", [512, 3])
def test_ngram_join(spark, block):
    rng = random.Random(1)
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(9):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"e{rng.randrange(50)}"
            texts.append(" ".join(own[: len(own) - rng.choice([0, 0, 3])] + [f"t{rng.randrange(4)}"] * rng.choice([0, 1, 4])))
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = groups(links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(df, block=block).collect()}
    assert got == {i: (len(sets[i]), want.get(i, i)) for i in range(len(texts))}


def test_divide_skip():
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(60), rng.randrange(5, 40))) for _ in range(80)]
    lists = ngram_join.inverted([np.array(s) for s in sets], np.arange(60))
    for q in sets[:20]:
        for least in (1, 3, len(q) // 2, len(q)):
            found = sorted(ngram_join.divide_skip(q, lists, least, lambda i: least, lambda i: False))
            assert found == [i for i, s in enumerate(sets) if len(set(q) & set(s)) >= least]


def test_ngram_join_odd(odd, none):
    rows = defaultdict(set)
    for r in ngram_join.joined(odd).collect():
        rows[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert rows[1] == {(0, 1)} and rows[2] == {(0, 2)} and rows[3] == {(0, 3)} and rows[5] == {(1, 4)} and rows[7] == {(57, 6)} and rows[8] == {(58, 6)} and rows[9] == {(1, 9)}
    assert rows[None] == {(2, None)}
    assert ngram_join.joined(none).count() == 0


def test_ngram_join_keeps_null_ids_apart(spark):
    rows = [(5, "one two three four five"), (None, "one two three four five"), (None, ""), (6, "one two three four five")]
    got = ngram_join.joined(spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, number int, token int"))
    assert Counter(map(tuple, got.collect())) == Counter([(5, 2, 5), (None, 2, None), (None, 0, None), (6, 2, 5)])


def test_ngram_join_of_shared_passages(spark):
    """Documents of shared sentences: long lists of many components and sizes, cut and searched in small blocks."""
    rng = random.Random(12)
    sentences = [" ".join(f"s{k}w{i}" for i in range(12)) for k in range(24)]
    texts = [" ".join(rng.sample(sentences, rng.randrange(2, 14))) for _ in range(250)]
    texts += [t + " more" for t in texts[::10]]
    sets = [shingles(t) for t in texts]
    want = groups((i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    for block in (8, 512):
        got = ngram_join.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {i: want.get(i, i) for i in range(len(texts))}


def test_packing(spark, sf, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).union(spark.createDataFrame([(77, "a <|endoftext|> b"), (78, "word " * 9000)], "doc_id long, text string"))
    want = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        ends = [len(ids)] if len(ids) <= 2048 else [*range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip([0, *ends], ends)):
            want[r["doc_id"], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = packing.packed(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.packed(none).count() == 0


def test_ids_of_long_runs(spark):
    """Runs on which a recursive regular expression fails, through Spark, against the tokenizers library on the whole text."""
    from tokenizers import Tokenizer

    tokenizer, most = Tokenizer.from_file(packing.tokenizer_path()), 10**6
    rng = random.Random(3)
    bits = ["word", "x  y", "\n\n", "it's", "é ü", "12 345", "\t\t z", "日本 語", "a\u00a0b", "<|end", "<|endoftext|>", " \x1c x", "!!!"]
    texts = [" " * most, "\t" * most, "\n" * most, "a" * most, "x" + " " * most + "y", " ".join(rng.choice(bits) for _ in range(100_000)), "ten million. " * 800_000]
    want = []
    for t in texts:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        ends = [*range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.append([zlib.crc32(ids[a:b].tobytes()) for a, b in zip([0, *ends], ends)])
    got = packing.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, crcs in enumerate(want):
        assert [r["ids_crc32"] for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])] == crcs


def test_other_vocabularies_take_the_plain_way():
    import json

    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    assert packing.as_ranks(spec)
    assert packing.as_ranks(spec | {"normalizer": {"type": "Lowercase"}}) is None
    merges = spec["model"]["merges"]
    assert packing.as_ranks(spec | {"model": spec["model"] | {"merges": [merges[1], merges[0], *merges[2:]]}}) is None


def test_plan_is_near_the_bound():
    lengths = np.minimum(2048, np.exp(np.random.default_rng(5).normal(6.5, 0.9, 20000)).astype(int) + 1)
    counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    runs, n = packing.planned(counts)
    placed = Counter()
    for length, a, b, _, _ in runs:
        placed[length] += b - a
    assert placed == Counter(counts) and n <= 1.003 * lengths.sum() / 2048


def test_chat_format(spark, none):
    said = ["</s>[INST] ok [/INST]", "␛e ␛0 <s>", "", None, "plain\ntext", "<|turn|>x<|body|>y</s>"]
    rows = [(c, t, role, said[(c + t) % len(said)]) for c in range(6) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])] + [(None, None, None, None), (9, 0, "us<s>er", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.formatted(chat_format.conversation_turns(df))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r[1], r[2]) for r in own]
        assert back[c]["loss_text"] == "".join(r[2] for r in own if r[1] == "assistant")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.formatted(chat_format.conversation_turns(empty)).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <image> ", None, None, None, None, None), ("image", None, "s3://a", 28, 15, None, None), ("audio", None, "b", None, None, 2.5, None), ("document", None, "c", None, None, None, 3), ("image", None, "d", None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    row = chat_format.formatted(df).first()
    assert row["formatted"] == "<s><|turn|>user<|body|>see ␛8 <image><audio><document><image></s>"
    assert [tuple(a) for a in row["attachments"]] == [("image", "s3://a", 4), ("audio", "b", 63), ("document", "c", 1536), ("image", "d", 1)]


def lines_want(rows, min_docs=10):
    """(doc_id, kept, n_lines, n_dropped) of (doc_id, text) by plain Python; rows equal in both are one document."""
    key = lambda line: line.strip(SPACES).translate(UPPER)
    docs_with = Counter(k for _, t in {(i, t or "") for i, t in rows} for k in {key(x) for x in t.split("\n")} if k)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if docs_with[key(x)] < min_docs]
        want[i, "\n".join(stay), len(lines), len(lines) - len(stay)] += 1
    return want


def test_line_dedup_of_equal_rows(spark):
    """Rows equal in doc_id and text are one document, however many there are: each loses the same places, named once."""
    rows = [(1, "own\nshared\nshared")] * 3000 + [(2 + i, f"shared\n{i}") for i in range(9)]
    got = line_dedup.common_lines_dropped(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "kept", "n_dropped").count().collect()
    assert {tuple(r) for r in got} == {(1, "own", 2, 3000)} | {(2 + i, str(i), 1, 1) for i in range(9)}


def test_line_dedup(spark, sf, odd, none):
    docs = table(spark, sf, "documents").select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = line_dedup.common_lines_dropped(docs)
    assert Counter((r["doc_id"], r["kept"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == lines_want([tuple(r) for r in docs.collect()])
    assert line_dedup.common_lines_dropped(none).count() == 0


def test_line_dedup_clashing_columns(odd):
    """Names that the operator uses itself pass through, but for those of its results."""
    names = ["row", "r1", "r2", "at", "lost", "lines", "h1", "h2", "batch", "_id", "_lost"]
    wide = odd.select("*", *[F.lit(n).alias(n) for n in names], F.lit("old").alias("kept"), F.lit("old").alias("n_lines"))
    got = line_dedup.common_lines_dropped(wide)
    assert got.columns == [*odd.columns, *names, "kept", "n_lines", "n_dropped"]
    rows = got.collect()
    assert all(r[n] == n for r in rows for n in names)
    assert Counter((r["doc_id"], r["kept"], r["n_lines"], r["n_dropped"]) for r in rows) == lines_want([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_line_dedup_of_a_long_document(spark):
    """Linear in the lines of one document."""
    lines = [f"own line {i}" if i % 2 else "Shared " for i in range(300_000)]
    docs = spark.createDataFrame([(0, "\n".join(lines))] + [(i, "shared") for i in range(1, 12)], "doc_id long, text string")
    row = line_dedup.common_lines_dropped(docs).filter("doc_id = 0").first()
    assert row["kept"] == "\n".join(lines[1::2]) and (row["n_lines"], row["n_dropped"]) == (300_000, 150_000)


def test_line_runs(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    seen, rng = set(), random.Random(3)
    for b in range(5):
        docs = [(10 * b + i, "\n".join(f"line {rng.randrange(60)}" for _ in range(6))) for i in range(4)]
        out = {r["doc_id"]: r["kept"] for r in line_dedup.new_lines_kept(runs, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert out == {i: "\n".join(x for x in t.split("\n") if x not in seen) for i, t in docs}
        seen |= {x for _, t in docs for x in t.split("\n")}
    assert sum(map(len, runs.levels)) <= 3 and runs.known().count() == len(seen)
    kept = [run for level in runs.levels for run in level]
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("run_")} == set(kept)
    # two runs of one bucketing meet without a shuffle
    plan = runs._merged(kept[:2])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.deleted()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_mixing(spark, sf, odd, none):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source").union(odd.filter("doc_id is not null").select(F.col("doc_id") + 10**6, "text", "source"))
    rows = [(r["doc_id"], len(words_of(r["text"])), r["source"]) for r in docs.collect()]
    total = Counter()
    for _, n, s in rows:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, full = {s: i % 3 + 1 for i, s in enumerate(names)}, set()
    while True:
        rest, w = sum(total.values()) - sum(3 * total[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 3 * total[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if target[s] > 3 * total[s] + 1e-9}
        if not over - full:
            break
        full |= over
    got = mixing.mix(docs)
    first, taken = sorted(map(str, got.collect())), Counter()
    source = {(i, n): s for i, n, s in rows}
    for r in got.collect():
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6 * (1 + target[s])
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK
    assert len(first) == len(rows) and first == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(none).count() == 0


def test_sainte_lague(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(30):
        votes, seats = [rng.choice([0, 1, 5, rng.randrange(1, 10000)]) for _ in range(rng.randrange(1, 12))], rng.randrange(0, 200)
        won = [0] * len(votes)
        for _ in range(seats if any(votes) else 0):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        rows += [(k, i, v, seats) for i, v in enumerate(votes)]
        want |= {(k, i): n for i, n in enumerate(won)}
    df = spark.createDataFrame(rows, "k long, i long, votes long, seats long")
    got = {(r["k"], r["i"]): r["won"] for r in mixing.apportioned(df, ["k"], "votes", "seats", ["i"], "won").collect()}
    assert got == want


def spots(text):
    """The signatures of a text as tuples of words, by plain Python."""
    words = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text.translate(UPPER))
    is_anchor = [w in spot_signatures.ANCHORS or len(w.encode()) <= spot_signatures.SHORT for w in words]
    found = set()
    for i, w in enumerate(words):
        chain = [x for x, a in zip(words[i + 1 :], is_anchor[i + 1 :]) if not a][: spot_signatures.CHAIN]
        if is_anchor[i] and len(chain) == spot_signatures.CHAIN:
            found.add((w, *chain))
    return found or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, sf, odd, none):
    docs = table(spark, sf, "documents").select("doc_id", "text").union(odd.filter("doc_id is not null and doc_id <> 7").select(F.col("doc_id") + 10**6, "text"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in spot_signatures.edited_and_next(docs, 5).collect()}
    sets = [(i, spots(t)) for i, t in rows]
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and 100 * len(a & b) >= 80 * len(a | b)]
    group = groups(links)
    assert len({group[i] for i in group}) < len(group) and {i: r["component_id"] for i, r in got.items()} == {i: group.get(i, i) for i, _ in rows}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        m = len(t) // 3
        changed = t[: len(t) - m] + after[:m]
        r, own, theirs = got[i], spots(t), spots(changed)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert len(spot_signatures.decoded(r["fingerprint"])) == len(own) and len(spot_signatures.decoded(r["edited_fingerprint"])) == len(theirs)
        assert abs(r["near_edited"] - jaccard(own, theirs)) < 1e-9 and abs(r["near_next"] - jaccard(own, spots(after))) < 1e-9
    assert spot_signatures.with_next(none.select("doc_id", "text"), 3).count() == 0 and spot_signatures.with_next(none.select("doc_id", "text")).count() == 0
    assert spot_signatures.fingerprinted(odd).count() == odd.count()
    assert spot_signatures.edited_and_next(none).count() == 0


def test_groups_of_repeated_and_null_ids(spark):
    """Rows of one doc_id have one group, the smallest of theirs; rows without a doc_id or a word have none and their own; clashing columns change nothing."""
    prose = "the harbour opened early and the ferry crossed a quiet channel while the gulls followed a fishing boat of the village"
    other = "an engine of the mill stopped before the evening shift and a smith was called from the valley"
    rows = [(3, prose), (5, prose), (5, other), (9, other), (None, prose), (7, None), (8, ""), (8, "")] + [(100 + i, prose) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], "doc_id long, text string, component_id int, fingerprint string, bucket double")
    got = sorted(((r["doc_id"], r["n_chars"], r["component_id"]) for r in spot_signatures.edited_and_next(docs, 6).collect()), key=str)
    want = {3: 3, 5: 3, 9: 5, None: None, 7: 7, 8: 8}
    assert got == sorted(((i, len(t or ""), want.get(i, 3)) for i, t in rows), key=str)


def test_next_of_repeated_and_null_ids(spark):
    """Null ids come last, rows of one id in descending order of their texts; each bucket ends with the next one's first row."""
    rows = [(None, "x"), (None, "a"), (5, "b"), (5, "c"), (9, "d"), (1, "e"), (2**60, "f"), (2**60 + 1, "g")]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -ord(r[1])))
    got = {}
    for part in spot_signatures.with_next(spark.createDataFrame(rows, "doc_id long, text string"), 4).rdd.glom().collect():
        for x, y in zip(part, part[1:]):
            if not x["ghost"]:
                got[x["doc_id"], x["text"]] = (y["doc_id"], y["text"])
    assert got == {r: want[(i + 1) % len(want)] for i, r in enumerate(want)}


def test_near_copies(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = docs.collect()
    sets = [spots(r["text"]) for r in rows]
    links = [(rows[i]["doc_id"], rows[j]["doc_id"]) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = groups(links)
    got = {r["doc_id"]: r["component_id"] for r in spot_signatures.near_copies(docs).collect()}
    assert got == {r["doc_id"]: want.get(r["doc_id"], r["doc_id"]) for r in rows}


def test_quality_rules(spark, sf, odd, none):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text").union(odd.select("doc_id", "lang", "text"))
    want = Counter()
    for r in docs.collect():
        t = r["text"] or ""
        w = words_of(t)
        lines = [x for x in t.split("\n") if words_of(x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often, covered = Counter(windows), set()
        for i, x in enumerate(windows):
            covered |= {i, i + 1, i + 2} if often[x] > 1 else set()
        base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[r["doc_id"], len(w), sum(map(len, w)), sum(t.count(c) for c in "[#*$%&|<>]"[1:-1]), len(lines) - len(set(lines)), len(covered), base] += 1
    got = quality_rules.judged(docs).collect()
    symbols = lambda r: (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
    assert Counter(map(symbols, got)) == want
    good = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    clean = [r["kept"] for r in got if good.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(clean) / len(clean) > 0.9  # references of a few dozen documents are rough
    assert quality_rules.judged(none).count() == 0


def test_distances(spark, sf, odd):
    """Common words, references, distances and verdicts by plain Python; only a word's hash, which parts equally frequent words, is the library's."""
    extra = [(10**6 + i, "xx", f"lalo mimi zuzu {i} lalo sasa mimi ! " * (20 + i)) for i in range(3)]
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text").union(odd.select(F.col("doc_id") + 10**7, "lang", "text").distinct()).union(spark.createDataFrame(extra, "doc_id long, lang string, text string"))
    rows = [(r["doc_id"], r["lang"], r["text"] or "") for r in docs.collect()]
    words = {w for _, _, t in rows for w in words_of(t.translate(UPPER))}
    (_, _, data, offsets), = text_arrays.slices(pa.array(sorted(words)), 1 << 40)
    bucket = dict(zip(sorted(words), text_arrays.Words(data, offsets).hashes(True).view(np.int64).tolist()))
    by_lang = defaultdict(Counter)
    for _, lang, t in rows:
        if lang is not None:
            by_lang[lang].update(bucket[w] for w in words_of(t.translate(UPPER)))
    common = {lang: [b for b, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.N_COMMON]] for lang, c in by_lang.items()}

    def kind(c):
        if c in SPACES:
            return 3
        return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 4 if c in ".,;:!?'\"()-" else 5 if "!" <= c <= "~" else 6

    def histograms(lang, t):
        seen = [bucket[w] for w in words_of(t.translate(UPPER))]
        return Counter(map(kind, t)), Counter(b if b in common.get(lang, []) else None for b in seen)

    def distance(p, q):
        n, m = sum(p.values()), sum(q.values())
        if not n or not m:
            return 0.0
        total = 0.0
        for k in p.keys() | q.keys():
            x, y = p[k] / n, q[k] / m
            total += sum(a * math.log2(2 * a / (x + y)) for a in (x, y) if a) / 2
        return math.sqrt(max(total, 0))

    got = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    chars, often = defaultdict(Counter), defaultdict(Counter)
    for i, lang, t in rows:
        if not got[i]["base_failed"]:
            c, w = histograms(lang, t)
            chars[lang] += c
            often[lang] += w
    for i, lang, t in rows:
        c, w = histograms(lang, t)
        by_char, by_word = distance(c, chars[lang]), distance(w, often[lang]) if lang is not None else 0.0
        assert abs(got[i]["char_distance"] - by_char) < 1e-9 and abs(got[i]["word_distance"] - by_word) < 1e-9
        unlike = len(t) >= 200 and by_char > quality_rules.MAX_CHAR_DISTANCE or len(words_of(t)) >= 200 and by_word > quality_rules.MAX_WORD_DISTANCE
        assert got[i]["kept"] == (not got[i]["base_failed"] and not unlike)


def test_every_language_has_a_reference(spark):
    """5,000 languages, the rarest of two documents and an odd one: judged by their own references, however languages are sliced."""
    text = lambda k, word="w": " ".join(random.Random(k).choices([f"{word}{k}x{i}" for i in range(30)], k=240))
    rows = [(k, f"l{k:04}", text(k)) for k in range(4998)] + [(5000, "rare", text(-1)), (5001, "rare", text(-1) + " end"), (5002, "rare", text(-1, "z")[:-1] + " other words"), (5003, None, text(7))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    got = {r["doc_id"]: r for r in quality_rules.judged(docs, slice_languages=1500).collect()}
    assert len(got) == len(rows) and all(got[k]["kept"] and got[k]["word_distance"] < 1e-6 for k in range(4998))
    assert got[5000]["kept"] and not got[5002]["kept"] and not got[5002]["base_failed"] and got[5002]["word_distance"] > 0.3
    assert got[5003]["word_distance"] == 0
    some = docs.filter("doc_id >= 4990")
    assert sorted(map(tuple, quality_rules.judged(some, slice_languages=2).collect())) == sorted(map(tuple, quality_rules.judged(some).collect()))


def test_common_words_by_parts(spark):
    """Counts that a task gives on in several parts add up."""
    rng = random.Random(8)
    rows = [(rng.choice("ab"), " ".join(f"w{min(rng.randrange(3000), rng.randrange(3000))}" for _ in range(400))) for _ in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = sorted(map(tuple, quality_rules.common_words(docs).collect()))
    assert sorted(map(tuple, quality_rules.common_words(docs, held=50).collect())) == want and len(want) == 40


def test_language_id(spark, sf, odd, none):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    told = language_id.tagged(docs, model).filter(language_id.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in told) / len(told) > 0.97
    strange = {r["doc_id"]: r for r in language_id.tagged(odd, model).collect()}
    assert all(strange[i]["lang_pred"] == "und" and strange[i]["score"] == 0 for i in (1, 2, 3)) and strange[10]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in strange.values())
    assert language_id.fit(none) is None and language_id.tagged(odd, None).filter("lang_pred <> 'und'").count() == 0
    assert language_id.tagged(none, model).count() == 0


def test_margins():
    """A toy model's predictions by plain Python: trigrams, frequencies, one family against the rest, then votes."""
    texts = ["aba aba abc", "abc abd abd", "xyz xyx xyy", "uvu uvw uvv"] * 3
    labels = ["en", "de", "fr", "qq"] * 3
    counts = []
    for _, _, data, offsets in text_arrays.slices(pa.array(texts)):
        bucket, first = language_id.trigrams(data, offsets)
        counts += [np.array(np.unique(bucket[a:b], return_counts=True)) for a, b in zip(first[:-1], first[1:])]
    model = language_id.fitted(labels, counts)
    assert sorted(map(tuple, model.families)) == [("de", "en"), ("fr",), ("qq",)]  # one unlisted language is one cluster

    def plain(text):
        folded = bytes(c if 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in text.encode())
        padded = b" " + folded + b" "
        grams = [int.from_bytes(padded[i : i + 3], "big") * 2654435761 % 2**32 >> (32 - language_id.BITS) for i in range(len(padded) - 2) if padded[i + 1] != 32]
        margins = [sum(model.root[g, k] for g in grams) / len(grams) + model.root[-1, k] for k in range(3)]
        family = int(np.argmax(margins))
        if len(model.families[family]) == 1:
            return model.families[family][0]
        return model.families[family][int(sum(model.pairs[family][g, 0] for g in grams) / len(grams) + model.pairs[family][-1, 0] >= 0)]

    tried = texts[:4] + ["Aba, abD!", "xyz aba xyx", "uvu é"]
    (_, _, data, offsets), = text_arrays.slices(pa.array(tried))
    got, _ = model.predict(*language_id.trigrams(data, offsets))
    assert got == [plain(t) for t in tried] and got[:4] == labels[:4]


def test_many_languages(spark):
    """250 languages of no list, the rarest with four documents to learn from."""
    rng = random.Random(9)
    letters, rows, i = "abcdefghijklmnopqrstuvwxyz", [], 0
    for k in range(250):
        syllables = ["".join(rng.choice(letters) for _ in range(rng.choice([2, 3]))) for _ in range(14)]
        need = 4 if k == 0 else 8
        while need:
            words = ["".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 3]))) for _ in range(60)]
            rows.append((i, " ".join(words), f"l{k:03}"))
            need -= zlib.crc32(str(i).encode()) % 5 != 0
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert sum(map(len, model.families)) == 250 and sum(m.shape[1] for m in model.pairs if m.size) < 250 * 249 / 8
    told = language_id.tagged(docs, model).collect()
    assert all(r["lang_pred"] == "l000" for r in told if r["lang"] == "l000")
    held = [r for r in told if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 3, lambda i: i % 2 * 5 + 1, lambda i: i])
def test_languages_whatever_the_ids(spark, sf, ids):
    """All ids null, or one or two ids for all rows: every language is learned, equal rows count once."""
    rows = [(ids(i), r["text"], r["lang"]) for i, r in enumerate(table(spark, sf, "documents").filter("lang is not null and text rlike '[a-z]'").collect())]
    rows += [(ids(0), "qqq zzz qqq xxx", "rare")] + rows[:1] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, per_language=30)
    left = docs.filter(~language_id.held_out(F.col("doc_id")))
    assert {lang for names in model.families for lang in names} == {r["lang"] for r in left.select("lang").distinct().collect()}
    told = language_id.tagged(docs, model).filter("text <> 'qqq zzz qqq xxx'")
    assert told.filter("lang = lang_pred").count() / told.count() > 0.95
    assert language_id.fit(docs.filter("lang = 'rare'").limit(0)) is None


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 10])
def test_unlisted_languages_are_clustered_at_every_size(n):
    rng = np.random.default_rng(n)
    names = [f"q{i}" for i in range(n)]
    families = language_id.families_of(names, rng.random((n, 50)), {})
    assert sorted(sum(families, [])) == names and len(families) <= math.ceil(math.sqrt(n))


def test_language_columns(odd):
    """Names that the operator uses itself pass through."""
    wide = odd.drop("lang").select("*", *[F.lit(n).alias(n) for n in ("_text", "_letters", "row", "letters", "score", "a.b")])
    out = language_id.tagged(wide, None)
    assert out.columns == [c for c in wide.columns if c != "score"] + ["lang_pred", "score"] and out.first()["_letters"] == "_letters"


def test_cumulative_link_is_the_likelihoods_maximum():
    """No small step in any tried direction raises the penalised likelihood, computed by plain Python."""
    rng = np.random.default_rng(4)
    x = [(np.flatnonzero(rng.random(5) < 0.6), None) for _ in range(120)]
    x = [(at, rng.integers(1, 4, len(at))) for at, _ in x]
    true = np.array([1.5, -1.0, 0.5, 2.0, 0.0])
    grades = np.array([int(np.clip(sum(true[a] * math.log1p(n) for a, n in zip(*r)) + rng.logistic(), 0, 3.99)) for r in x])
    ridge = 0.2
    w, theta = toxicity.cumulative_link(x, 5, grades, 3, ridge, rounds=4000, rate=0.03)
    weight = {True: len(grades) / (2 * (grades > 0).sum()), False: len(grades) / (2 * (grades == 0).sum())}

    def likelihood(w, theta):
        total = -ridge / 2 * sum(v * v for v in w)
        for (at, n), g in zip(x, grades):
            score = sum(w[a] * math.log1p(k) for a, k in zip(at, n))
            above = [1.0, *[1 / (1 + math.exp(t - score)) for t in theta], 0.0]
            total += weight[bool(g > 0)] * math.log(above[g] - above[g + 1])
        return total

    best = likelihood(w, theta)
    for _ in range(60):
        step = rng.normal(size=8)
        step *= 0.02 / np.linalg.norm(step)
        assert likelihood(w + step[:5], theta + step[5:]) < best + 1e-4
    model = toxicity.Model(np.arange(5, dtype=np.uint64), w, theta)
    assert np.allclose(model.chances(x[:3])[:, 0], [1 / (1 + math.exp(theta[0] - sum(w[a] * math.log1p(k) for a, k in zip(*r)))) for r in x[:3]])


def test_selected_words(spark):
    """Counts, odds and gain of words by plain Python."""
    rng = random.Random(5)
    rows = [(i % 3 == 0, [w for w in range(40) if rng.random() < (0.8 if w < 6 and i % 3 == 0 else 0.03 if w < 6 else 0.4)]) for i in range(300)]
    words, odds = toxicity.selected_words(spark.createDataFrame(rows, "toxic boolean, h array<long>"), 100, 200, 4, 6)
    want = {}
    for w in range(40):
        a, b = (sum(w in h for t, h in rows if t == k) for k in (True, False))
        p, q = a / 100, b / 200
        gain = sum(v * math.log(2 * v / (p + q)) for v in (p, q) if v)
        odd = math.log((a + 0.5) / 100) - math.log((b + 0.5) / 200)
        if a + b >= 6 and odd > math.log(8):
            want[w] = (gain, odd)
    best = sorted(sorted(want, key=lambda w: -want[w][0])[:4])
    assert words.tolist() == best and np.allclose(odds, [want[w][1] for w in best])


def test_toxicity(spark, odd, none):
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(300)]
    rows, grades = [], {}
    for i in range(400):
        grade = rng.choice([0, 0, 1, 2, 3])
        w = [rng.choice(plain) for _ in range(60)] + [rng.choice(["vileness", "nasty", "vilest"]) for _ in range(3 * grade)]
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        grades[i] = grade
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g > 0), g) for i, g in grades.items()], "doc_id long, toxic int, grade int")
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = [r for r in toxicity.scored(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["toxic"] == (grades[r["doc_id"]] > 0) for r in got)
    assert np.mean([abs(r["severity"] - grades[r["doc_id"]]) for r in got]) < 0.5
    # a null grade of a document that is not toxic is 0; a toxic one without a grade is left out
    partly = labels.withColumn("grade", F.when((F.col("toxic") > 0) & (F.col("doc_id") % 10 > 0), F.col("grade")))
    by_part = toxicity.fit(docs, partly)
    assert len(by_part.thresholds) == 3 and np.allclose(by_part.thresholds, toxicity.fit(docs, labels.filter("toxic = 0 or doc_id % 10 > 0")).thresholds)
    assert toxicity.fit(docs, partly.withColumn("grade", F.lit(None).cast("int"))) is None
    many = labels.union(labels).union(labels.limit(1).crossJoin(spark.range(500)).drop("id"))
    assert np.allclose(toxicity.fit(docs, many).thresholds, model.thresholds)
    without = toxicity.fit(docs, labels.drop("grade"))
    # grades made out of fold still rise with the true ones
    made = {r["doc_id"]: r["severity"] for r in toxicity.scored(docs, without).collect()}
    means = [np.mean([made[i] for i, g in grades.items() if g == k]) for k in range(4)]
    assert means == sorted(means) and means[3] > means[1] + 0.5
    assert sum(r["toxic"] != (grades[r["doc_id"]] > 0) for r in toxicity.scored(docs, without).collect()) < 8
    strange = toxicity.scored(odd, model).collect()
    assert len(strange) == odd.count() and not any(r["toxic"] for r in strange if r["doc_id"] in (1, 2, 3))
    assert toxicity.fit(none, labels.limit(0)) is None and toxicity.scored(odd, None).filter("toxic").count() == 0 and toxicity.scored(none, model).count() == 0


def test_quality_resampling(spark, sf, odd, none):
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    got = quality_resampling.resampled(docs, labels).collect()
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    share = sum(q == 1 for q in quality.values()) / len(quality)
    kept = sorted((r for r in got if r["kept"]), key=lambda r: -r["key"])
    assert len(kept) == round(len(got) * share) and kept[-1]["key"] >= max(r["key"] for r in got if not r["kept"])
    assert sum(r["kept"] for r in got if quality.get(r["doc_id"]) == 1) > 5 * sum(r["kept"] for r in got if quality.get(r["doc_id"]) == 0)
    assert quality_resampling.resampled(odd, labels, k=4).filter("kept").count() == 4
    assert quality_resampling.resampled(none, labels).count() == 0


def test_weights_and_keys(spark, sf, odd):
    """log_weight and key of every row by plain Python; only a word's hash and Spark's hash of doc_id are the libraries'."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "text").union(odd.select(F.col("doc_id") + 10**6, "text").distinct()), table(spark, sf, "labels")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    words = sorted({w for t in texts.values() for w in words_of(t)})
    (_, _, data, offsets), = text_arrays.slices(pa.array(words), 1 << 40)
    h = dict(zip(words, map(int, text_arrays.Words(data, offsets).hashes(False))))

    def grams(t):
        own = [h[w] for w in words_of(t)]
        pairs = [int(x) for x in text_arrays.chains(np.array(own, np.uint64), 2)]
        return [x >> (64 - quality_resampling.BITS) for x in own + pairs]

    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    size, n, m = 1 << quality_resampling.BITS, sum(raw.values()), sum(target.values())

    def ratio(g):
        p = (raw[g] + 1) / (n + size)
        q = (target[g] + p * size) / (m + size)
        return math.log((0.98 * q + 0.02 * p) / p)

    noise = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(11)).alias("h")).collect()}
    got = quality_resampling.resampled(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        want = sum(map(ratio, grams(texts[r["doc_id"]])))
        u = (noise[r["doc_id"]] % 2**52 + 0.5) / 2**52
        assert r["n_grams"] == len(grams(texts[r["doc_id"]])) and abs(r["log_weight"] - want) < 1e-6 * (1 + abs(want))
        assert abs(r["key"] - r["log_weight"] + math.log(-math.log(u))) < 1e-9


def test_top_k(spark):
    rows = [(i, float(v), float(-(i % 3)), float(-i)) for i, v in enumerate([5, 5, 5, 5, 1, 9, 9, -3, 5, 0])]
    df = spark.createDataFrame(rows, "doc_id long, key double, second double, third double")
    for k in range(11):
        want = {r[0] for r in sorted(rows, key=lambda r: (-r[1], -r[2], -r[3]))[:k]}
        for enough in (1, 100):
            assert {r["doc_id"] for r in quality_resampling.top_k(df, ["key", "second", "third"], k, "kept", 4, enough).filter("kept").collect()} == want


def test_other_columns_change_nothing(odd):
    """Operators that return columns of their own take no notice of others, whatever their names."""
    names = ["row", "key", "size", "taken", "target", "bucket", "ghost", "h", "n", "words", "chars", "severity", "weight", "kept", "piece", "number", "n_words", "blocks", "shard"]
    wide = odd.select("*", *[F.lit(n).alias(n) for n in names])
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), np.array([1.0]))
    runs = {
        "packing": lambda d: packing.packed(d).select("doc_id", "piece", "ids_crc32"), "toxicity": lambda d: toxicity.scored(d, model), "weights": lambda d: quality_resampling.weighed(d, np.zeros(1 << quality_resampling.BITS)),
        "fingerprints": lambda d: spot_signatures.fingerprinted(d), "next": lambda d: spot_signatures.with_next(d, 3).select("doc_id", "text"), "rules": lambda d: quality_rules.judged(d), "mix": lambda d: mixing.mix(d), "join": lambda d: ngram_join.joined(d),
    }
    for name, run in runs.items():
        assert Counter(map(str, run(wide).collect())) == Counter(map(str, run(odd).collect())), name


def test_tied_turns(spark):
    """Turns of one number and role stand in the order of their escaped texts."""
    df = spark.createDataFrame([(1, 0, "user", t) for t in ("␛A", "␛<s>", "<s>", "b")], "conv_id long, turn long, role string, text string")
    got = chat_format.read_back(chat_format.formatted(chat_format.conversation_turns(df))).first()["turns"]
    escape = lambda t: t.replace("␛", "␛e").replace("<s>", "␛0")
    assert [t["text"] for t in got] == sorted(["␛A", "␛<s>", "<s>", "b"], key=lambda t: escape(t).encode())
