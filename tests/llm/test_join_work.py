"""How much the join of near copies does: candidates of a large group, and the jobs that the driver plans for its components."""

import random
import re
import time

import numpy as np

from shutterlake.llm import ngram_join
from shutterlake.llm.common import components


def test_candidates_of_a_group_around_a_middle(spark, monkeypatch):
    """Copies of one text with four words in forty replaced link with it at 80 %, and hardly with each other; the text itself comes last."""
    pick, words, n = random.Random(5), [f"w{i}" for i in range(40)], 150
    texts = []
    for i in range(n):
        gone = set(pick.sample(range(40), 4))
        texts.append(" ".join(f"x{i}x{j}" if j in gone else w for j, w in enumerate(words)))
    seen, real = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda candidates, *rest: seen.append(candidates.count()) or real(candidates, *rest))
    got = ngram_join.joined(spark.createDataFrame(list(enumerate([*texts, " ".join(words)])), "doc_id long, text string"), ngram_join.ShingleSets(1), 80).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == n + 1
    assert sum(seen) <= 10 * n


def varied(n, seed=8):
    """Copies of one text of forty words, each without six of them and with two of its own: two are alike by 64 to 80 %, and have most of their rarest words in common."""
    pick, words = random.Random(seed), [f"w{i}" for i in range(40)]
    return [" ".join([*(w for w in words if w not in set(gone)), f"x{i}", f"y{i}"]) for i in range(n) for gone in [pick.sample(words, 6)]]


def test_candidates_of_copies_just_below_the_threshold(spark, monkeypatch):
    """Such copies are candidates of each other by their short lists, and hardly any two link: they are not written as pairs."""
    texts = varied(200)
    sets, least = [frozenset(t.split()) for t in texts], list(range(len(texts)))
    linked = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in linked:
            least[i] = least[j] = min(least[i], least[j])
    seen, real = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda candidates, *rest: seen.append(candidates.count()) or real(candidates, *rest))
    got = ngram_join.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ngram_join.ShingleSets(1), 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(least)) and len(set(least)) > 50
    assert sum(seen) <= 10 * len(texts), seen


def test_bitmaps_never_differ_more_than_their_sets():
    pick = np.random.default_rng(3)
    for n in (0, 1, 5, 60, 3000):
        shared, mine, theirs = (np.unique(pick.integers(0, 2**64, k, dtype=np.uint64)) for k in (n, n // 3, n // 5))
        a, b = np.union1d(shared, mine), np.union1d(shared, theirs)
        x, y = (int.from_bytes(ngram_join.bitmap(s)) for s in (a, b))
        assert (x ^ y).bit_count() <= len(np.setxor1d(a, b)) and x.bit_count() <= len(a)


def test_shuffles_of_finished_steps_go_before_the_next(spark, monkeypatch):
    """When the first candidates are verified, no shuffle that made lists and candidates is on disk, but the small one of the sketch."""
    def there():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return set(re.findall(r"/shuffle_(\d+)_", files))

    seen, real = [], ngram_join.verified

    def waiting(*rest):
        end = time.time() + 5
        while len(there() - before) > 1 and time.time() < end:
            time.sleep(0.2)
        seen.append(there() - before)
        return real(*rest)

    monkeypatch.setattr(ngram_join, "verified", waiting)
    before = there()
    ngram_join.joined(spark.createDataFrame(list(enumerate(varied(20))), "doc_id long, text string"), ngram_join.ShingleSets(1), 80).count()
    assert len(seen[0]) <= 1


def test_jobs_of_settled_components(spark):
    """Links that are stars already cost a look at them, not a round."""
    links = spark.createDataFrame([(10 * c, 10 * c + i) for c in range(1, 20) for i in range(1, 10)], "a long, b long")
    context = spark.sparkContext
    context.setJobGroup("settled", "settled")
    try:
        got = dict(map(tuple, components(links).collect()))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: i // 10 * 10 for i in range(10, 200)}
    assert len(context.statusTracker().getJobIdsForGroup("settled")) <= 8
