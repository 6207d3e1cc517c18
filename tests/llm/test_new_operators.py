"""Whitening, WARC and spelling variants against brute force, with odd rows, damage, and no rows."""
import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import spelling_variants, warc, whitening
from shutterlake.llm.common import scratch

VECTORS = "vec_id long, vector array<double>, n int, component string"


def brute_white(vectors, k=32):
    """n, deviations, eigenvalues, covariance, all from fractions."""
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    z = [[n * r[i] - s[i] for i in range(d)] for r in x]
    cov = [[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)]
    values, columns = np.linalg.eigh(np.array(cov))
    centred = np.array([[float(Fraction(c, n)) for c in r] for r in z])
    return n, [sum(c * c for c in r) for r in z], values[::-1][:k], centred @ columns[:, ::-1][:, :k] / np.sqrt(np.maximum(values[::-1][:k], 1e-300)), np.trace(cov)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) / 20).tolist()
    odd = [(901, None, 0, "x"), (902, [None] + good[0][1:], 0, "x"), (903, [float("nan")] + good[0][1:], 0, "x"), (904, [float("inf")] + good[0][1:], 0, "x"), (905, [], 0, "x"), (906, [1.0, 2.0], 0, "x"), (907, [1e300] * 40, 0, "x")]
    ids = [None, 7, 7, *range(3, 300)]
    rows = spark.createDataFrame([(i, v, 1, None) for i, v in zip(ids, good)] + odd, VECTORS).repartition(3)
    got = whitening.whitened(rows).collect()
    n, deviations, values, white, trace = brute_white(good)
    assert len(got) == 300 * 32 and {r["n"] for r in got} == {300} and {r["component"] for r in got} == set(range(1, 33))
    assert Counter(r["vec_id"] for r in got) == {i: 32 * c for i, c in Counter(ids).items()}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviations)
    own = {r["component"]: r["whitened"] for r in got if r["vec_id"] == 50}
    want = white[ids.index(50)]
    assert all(abs(abs(own[c]) - abs(want[c - 1])) < 1e-6 for c in own)
    assert all(abs(r["explained"] / (values[r["component"] - 1] / trace) - 1) < 1e-9 for r in got)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    by_component = np.array([[r["whitened"] for r in got if r["component"] == c] for c in (1, 32)])
    assert np.allclose(np.cov(by_component, bias=True)[[0, 1], [0, 1]], 1)


def test_covariance_is_exact_for_wide_values(spark):
    """Values whose squares leave 64 bits, and a dimension far from zero."""
    rng = random.Random(3)
    vectors = [[rng.uniform(-1e12, 1e12), 1e9 + rng.random(), rng.random()] for _ in range(50)]
    rows = spark.createDataFrame([(i, v, 1, None) for i, v in enumerate(vectors)], VECTORS).repartition(4)
    m = whitening.moments(rows)
    cov = whitening.covariance(rows, m)
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    s = [sum(c) for c in zip(*x)]
    assert m.sums == s
    for i in range(3):
        for j in range(3):
            assert cov[i, j] == float(Fraction(sum((50 * r[i] - s[i]) * (50 * r[j] - s[j]) for r in x), 50**3))
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(rows).collect()}
    want = {i: sum((50 * c - t) ** 2 for c, t in zip(r, s)) for i, r in enumerate(x)}
    assert got == {i: v if v < 1 << 63 else None for i, v in want.items()}


def test_whitening_without_spread(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], 1, None)] * 3, VECTORS)
    assert whitening.whitened(one).count() == 0 and whitening.whitened(one.limit(0)).count() == 0
    # two dimensions that are the same give one component
    line = spark.createDataFrame([(i, [i / 8, i / 8], 1, None) for i in range(9)], VECTORS)
    got = whitening.whitened(line).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9 and abs(got[0]["explained"] - 1) < 1e-12


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, first int").repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 4])
def test_warc_round_trip(spark, least):
    rows = [(i, f"http://a/{i}", f"<p>{i % 7}é</p>" * (i % 7)) for i in range(60)] + [(100, None, None), (101, "x\r\ny", ""), (None, "u", "<p>1é</p>"), (None, None, "alone"), (200, "v", "long " * 300_000), (7, "again", "abc"), (8, "again", "abc"), (5, "again", "<p>5é</p>" * 5)]
    rows.append((None, None, "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
    got = warc.archived_pages(pages(spark, rows), scratch(spark, "warc"), least).collect()
    want = []
    for i, _, html in rows:
        size = len((html or "").encode())
        ids = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(ids) if ids and size >= least and i != min(ids) else None
        want.append((i, size, digest(html), "revisit" if first is not None else "response", first))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.archived_pages(pages(spark, rows).limit(0), scratch(spark, "warc")).count() == 0


def found(data):
    out = list(warc.salvaged(pa.PythonFile(io.BytesIO(data), "r")))
    return [f for f in out if isinstance(f, warc.Found)], [g for g in out if isinstance(g, warc.Gap)]


@pytest.fixture(scope="module")
def parts():
    rng = random.Random(1)
    return [warc.page_record(i, f"http://h/{i}", bytes(rng.randrange(32, 127) for _ in range(rng.randrange(2000))), None if i % 3 else 0, "2000-01-01T00:00:00Z") for i in range(30)]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(parts, zipped):
    units = [gzip.compress(p, mtime=0) for p in parts] if zipped else parts
    whole = b"".join(units)
    starts = np.cumsum([0, *map(len, units)])
    ids = [f"<urn:page:{i}>" for i in range(len(parts))]
    good, gaps = found(whole)
    assert [g.head["warc-record-id"] for g in good] == ids and not gaps and [g.offset for g in good] == starts[:-1].tolist()
    # bytes lost at the front, in the middle and at the end; junk between; a record cut short
    good, gaps = found(b"\x1f\x8b\x08junk WARC/1.1\r\n" + whole)
    assert [g.head["warc-record-id"] for g in good] == ids and [(g.offset, g.end) for g in gaps] == [(0, 18)]
    good, gaps = found(whole[:-5])
    assert len(good) >= 29 and [(g.end) for g in gaps] == [len(whole) - 5]
    hole = whole[: starts[4] + 20] + whole[starts[7] + 30 :]
    good, gaps = found(hole)
    assert [g.head["warc-record-id"] for g in good] == ids[:4] + ids[8:] and [(g.offset, g.end) for g in gaps] == [(starts[4], starts[4] + 20 + starts[8] - starts[7] - 30)]
    good, gaps = found(b"".join(u + bytes(50) for u in units))
    assert len(good) == 30 and [g.end - g.offset for g in gaps] == [50] * 30
    assert found(b"") == ([], []) and [(g.offset, g.end) for g in found(bytes(3_000_000))[1]] == [(0, 3_000_000)]


@pytest.mark.parametrize("seed", range(40))
def test_salvage_of_flipped_bytes(parts, seed):
    """Whatever byte is damaged, the other records come back, and what comes back is right."""
    rng = random.Random(seed)
    units = [gzip.compress(p, mtime=0) if seed % 2 else p for p in parts]
    starts = np.cumsum([0, *map(len, units)])
    data, hurt = bytearray(b"".join(units)), set()
    for _ in range(rng.randrange(1, 6)):
        at = rng.randrange(len(data))
        data[at] ^= rng.randrange(1, 256)
        hurt.add(int(np.searchsorted(starts, at, "right")) - 1)
    good, gaps = found(bytes(data))
    by_place = {g.offset: g for g in good}
    for i, p in enumerate(parts):
        if i not in hurt:
            own = by_place[starts[i]]
            assert own.head["warc-record-id"] == f"<urn:page:{i}>" and p.endswith(own.block + b"\r\n\r\n")
    for g in gaps:
        assert any(starts[i] <= g.offset < starts[i + 1] for i in hurt)
    assert all(any(p.endswith(g.block + b"\r\n\r\n") for p in parts) for g in good)


def test_salvage_inside_one_member(parts):
    """A file that is one member: records before and after a broken one come back, and one after which the member is cut."""
    broken = parts[5].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    good, gaps = found(gzip.compress(b"".join(parts[:5]) + broken[:200] + b"".join(parts[6:])))
    assert [g.head["warc-record-id"] for g in good] == [f"<urn:page:{i}>" for i in range(30) if i != 5] and len(gaps) == 1
    good, _ = found(gzip.compress(b"".join(parts))[:-2000])
    assert 10 < len(good) < 30


def test_gaps_are_rows(spark, tmp_path, parts):
    whole = gzip.compress(parts[0]) + b"junk" + gzip.compress(parts[1])
    (tmp_path / "a.warc.gz").write_bytes(whole)
    (tmp_path / "b.warc").write_bytes(parts[2] + parts[3][:50])
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_archives(spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("a.warc.gz", "b.warc", "c.warc")] + [(None,)], "path string")).collect()
    assert Counter(r["kind"] for r in rows) == {"record": 3, "gap": 2}
    gap = next(r for r in rows if r["kind"] == "gap" and r["path"].endswith("gz"))
    assert whole[gap["offset"] : gap["offset"] + gap["length"]] == b"junk" and gap["reason"]


def test_archive_of_a_lost_task_is_not_read(spark):
    folder = scratch(spark, "warc")
    paths = warc.archived(warc.planned(pages(spark, [(i, "u", f"text {i}") for i in range(20)])), folder, archive_bytes=500)
    assert paths.count() > 1 and paths.agg(F.sum("records")).first()[0] == 20
    again = warc.archived(warc.planned(pages(spark, [(1, "u", "other")])), folder)
    assert warc.read_archives(again).filter("record_type = 'response'").count() == 1


def brute_variants(rows, min_count=2, ratio=10):
    counts = Counter()
    for i, text in rows:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, vs in close.items():
        if vs and n[(best := min(vs, key=lambda v: (-n[v], v)))] >= ratio * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(close[w]), n.get(form.get(w))) for w in n}


def told(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"block": 5}, {"parents": 4}, {"parents": 10**6, "block": 20}])
def test_variants(spark, options):
    rng = random.Random(9)
    letters = "abÀé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 13))) for _ in range(60)] + ["Abracadabra", "aaaaaaa", "aaaaaaaa", "x" * 300, "ÀÀÀÀÀÀÀ"]
    rows = []
    for i in range(400):
        words = []
        for w in rng.choices(base, weights=[1 + 200 // (1 + j) for j in range(len(base))], k=12):
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:]])
            words.append(w)
        rows.append((i, " ".join(words)))
    rows += [(None, "Abracadabra zzzzzzzzz zzzzzzzzz"), (3, None), (4, ""), (5, "zzzzzzzz, zzzzzzzz-zzzzzzzzzz"), (5, "zzzzzzzz, zzzzzzzz-zzzzzzzzzz")]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    assert told(spelling_variants.variants(docs, **options)) == brute_variants(rows)
    assert spelling_variants.variants(docs.limit(0)).count() == 0


def test_affected_grams_bound():
    """However a word is edited once, it keeps `needed` grams on the same outer text, and one at least."""
    rng = random.Random(2)
    for _ in range(300):
        letters = "ab" if rng.random() < 0.5 else "abcd"
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 14))) for _ in range(30)]
        counts = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
        least = rng.randrange(1, 12)
        grams = spelling_variants.Grams({g for g, n in counts.items() if n > least})
        for w in words:
            own = grams.of(w)
            needed = len(own) - grams.affected([b for _, b in own])
            assert needed >= 1
            at = rng.randrange(len(w) + 1)
            other = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:]])
            if other != w and len(other) >= 7:
                theirs = grams.of(other)
                alike = {w[:b] for _, b in own} & {other[:b] for _, b in theirs}, {w[a:] for a, _ in own} & {other[a:] for a, _ in theirs}
                assert len(alike[0]) + len(alike[1]) >= needed, (w, other)
                short = min(len(w), len(other))
                (head, tail), (head2, tail2) = grams.outer(own, len(w), short), grams.outer(theirs, len(other), short)
                assert w[:head] == other[:head2] or w[len(w) - tail :] == other[len(other) - tail2 :], (w, other)


def test_words_must_keep_a_gram(spark, none):
    with pytest.raises(ValueError):
        spelling_variants.variants(none, longest=4)
