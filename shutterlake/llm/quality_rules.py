"""Operator 9: quality rules by distribution divergence.

A document's histogram of character classes and its histogram of its language's common
words are compared with those of the language by Jensen-Shannon distance. Common words and
references come from all documents of a language; documents too short for a histogram to
mean anything are not judged by it.

Word counts by language over all texts, by 64-bit hash, name each language's common words. One pass
over the texts then counts everything else. What it counts is written, so that references
and distances read numbers only. Every language has a reference, however rare: where there are many, they are
taken in slices of a bounded number, each with the documents of its languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import table, written
from .text_arrays import SPACE, Words, chains, mixed, slices

CLASSES = ["lower", "upper", "digit", "space", "point", "symbol", "other"]
MIN_CHARS, MIN_WORDS = 200, 200
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.26
#: Common words of a language.
N_COMMON = 20
#: Languages whose common words and references a task holds at once, about.
SLICE = 4096
#: Distinct words that a task holds before its counts go on.
HELD = 1 << 20
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 6, np.uint8)
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[SPACE] = 3
    kind[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    kind[[c for c in range(33, 127) if kind[c] == 6]] = 5
    kind[0x80:0xC0] = 7  # inside a code point
    return kind


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the sums of their counts."""
    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def common_words(docs: DataFrame, n: int = N_COMMON, held: int = HELD) -> DataFrame:
    """(lang, hash, place): of each language its n most frequent words, A-Z in lower case, from 0, over all texts of docs (lang, text); of equally frequent ones the smaller hash first.

    A task sums up about `held` distinct words at a time. No task sees all words of a language: each passes on its own best n.
    """
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[list[np.ndarray]]] = {}
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            for lang, (hashes, counts) in total.items():
                h, c = summed(hashes, counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(c)], ["lang", "hash", "n"])

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            number = langs.indices.to_numpy(zero_copy_only=False)
            for a, b, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                h, of = words.hashes(True), np.repeat(number[a:b], np.diff(words.first))
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, int)
                counts = np.diff(np.append(first, len(h)))
                h, of = h[first], of[first]
                for k in np.unique(of):
                    at = of == k
                    own = total.setdefault(langs.dictionary[int(k)].as_py(), [[], []])
                    own[0].append(h[at])
                    own[1].append(counts[at])
                size += len(h)
                if size > 4 * held:
                    total = {lang: [[x] for x in summed(*own)] for lang, own in total.items()}
                    size = sum(len(own[0][0]) for own in total.values())
                    if size > held:
                        yield from given()
                        total, size = {}, 0
        yield from given()

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null")
    counts = rows.mapInArrow(told, "lang string, hash long, n long").groupBy("lang", "hash").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "hash"))).filter(F.col("rank") <= n)
    return ranked.select("lang", "hash", (F.col("rank") - 1).alias("place"))


def of_language(hashes: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """One hash of a word and its language's number; for one language, different words stay different."""
    return mixed(hashes + np.uint64(0x9E3779B97F4A7C15) * np.asarray(number).astype(np.uint64))


def measured(docs: DataFrame, common: dict[str, list[int]], n: int = N_COMMON) -> DataFrame:
    """(doc_id, lang, the columns of BASE, chars, words): the counts of each row of docs (doc_id, lang, text). One pass over the bytes. common: hashes of a language's common words, in order of place."""
    names = sorted(common)
    keys = np.concatenate([of_language(np.array(common[lang], np.int64).view(np.uint64), i) for i, lang in enumerate(names)] or [np.zeros(0, np.uint64)])
    places = np.concatenate([np.arange(len(common[lang])) for lang in names] or [np.zeros(0, int)])
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast(({lang: i for i, lang in enumerate(names)}, keys[order], places[order]))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (number, keys, places), kinds = shared.value, _byte_classes()
        symbol = np.zeros(256, bool)
        symbol[[*b"#*$%&|<>"]] = True
        for batch in batches:
            if not batch.num_rows:
                continue
            columns: dict[str, list] = {k: [] for k in (*BASE, "chars", "words")}
            langs = np.array([number.get(x, len(number)) for x in batch.column("lang").to_pylist()])
            for a, b, data, offsets in slices(batch.column("text")):
                words, rows = Words(data, offsets), b - a
                n_words = np.diff(words.first)
                row = np.repeat(np.arange(rows), np.diff(offsets))
                classes = np.bincount(row * 8 + kinds[data], minlength=8 * rows).reshape(rows, 8)[:, :7]
                triples, repeats = chains(words.hashes(False), 3), np.zeros(rows, np.int64)
                for i in range(rows):
                    lo, hi = words.first[i], words.first[i + 1]
                    if hi - lo < 4:
                        continue
                    _, back, count = np.unique(triples[lo : hi - 2], return_inverse=True, return_counts=True)
                    twice = count[back] > 1
                    if twice.any():
                        covered = np.zeros(hi - lo, bool)
                        for k in range(3):
                            covered[k : k + len(twice)] |= twice
                        repeats[i] = covered.sum()
                word_row = np.repeat(np.arange(rows), n_words)
                at = np.full(len(word_row), n)
                if len(keys):
                    own = of_language(words.hashes(True), langs[a:b][word_row])
                    found = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    at = np.where(keys[found] == own, places[found], n)
                columns["n_words"].append(n_words)
                columns["word_chars"].append(classes.sum(1) - classes[:, 3])
                columns["n_symbols"].append(np.bincount(row, weights=symbol[data], minlength=rows))
                columns["n_dup_lines"].append(_duplicate_lines(data, offsets))
                columns["n_repeat_words"].append(repeats)
                columns["chars"].append(classes)
                columns["words"].append(np.bincount(word_row * (n + 1) + at, minlength=rows * (n + 1)).reshape(rows, n + 1))
            longs = [pa.array(np.concatenate(columns[k]).astype(np.int64)) for k in BASE]
            lists = [_lists(np.concatenate(columns[k]).astype(np.int64)) for k in ("chars", "words")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *longs, *lists], ["doc_id", "lang", *BASE, "chars", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(told, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, words array<long>")


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.reshape(-1)))


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text its lines with a word that equal an earlier line of it."""
    out = np.zeros(len(offsets) - 1, np.int64)
    ends = np.flatnonzero(data == 10)
    raw = data.tobytes()
    for i in range(len(out)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if np.searchsorted(ends, b) == np.searchsorted(ends, a):
            continue
        lines = [line for line in raw[a:b].split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
        out[i] = len(lines) - len(set(lines))
    return out


def divergence(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts to the same row of reference; 0 if one of them is empty."""
    n, m = counts.sum(1, keepdims=True), reference.sum(1, keepdims=True)
    p, q = counts / np.maximum(n, 1), reference / np.maximum(m, 1)
    term = lambda x, y: np.where(x > 0, x * np.log2(np.where(x > 0, 2 * x / np.maximum(x + y, 1e-300), 1)), 0).sum(1)
    return np.where((n[:, 0] > 0) & (m[:, 0] > 0), np.sqrt(np.maximum((term(p, q) + term(q, p)) / 2, 0)), 0.0)


def judged(docs: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, slice_languages: int = SLICE) -> DataFrame:
    """One row a row of docs (doc_id, lang, text): base counts, both distances, base_failed and kept.

    References are sums over all documents of a language that pass the base rules. A null text has no words
    and fails the base rules. Documents without a language, of mixed origin, are held against each other by
    characters only. Null doc_ids and repeated rows come back as they are; other columns are left
    out, whatever their names; an empty table gives none. Very long texts are measured whole.
    """
    common = written(common_words(docs), "common-words")
    parts = max(1, -(-common.select("lang").distinct().count() // slice_languages))
    part = F.when(F.col("lang").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col("lang").cast("string")), F.lit(parts)))
    out = None
    for k in range(parts):
        words: dict[str, list[int]] = {}
        for r in sorted(common.filter(part == k).collect(), key=lambda r: (r["lang"], r["place"])):
            words.setdefault(r["lang"], []).append(r["hash"])
        own = docs if parts == 1 else docs.filter(part == k)
        told = distances(written(measured(own, words), "measured"), min_chars, min_words, max_char_distance, max_word_distance)
        out = told if out is None else out.unionAll(told)
    return out


def distances(rows: DataFrame, min_chars: int, min_words: int, max_char_distance: float, max_word_distance: float) -> DataFrame:
    """What judged() gives, from the measures of all documents of some languages, about SLICE at most: their references are broadcast."""
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    n, m = len(CLASSES), N_COMMON + 1
    found = rows.filter("not base_failed").groupBy("lang").agg(F.array(*[F.sum(F.col("chars")[i]) for i in range(n)]).alias("chars"), F.array(*[F.sum(F.col("words")[i]) for i in range(m)]).alias("words")).collect()
    shared = rows.sparkSession.sparkContext.broadcast(({r["lang"]: i for i, r in enumerate(found)}, np.array([r["chars"] for r in found] + [[0] * n], float), np.array([r["words"] if r["lang"] is not None else [0] * m for r in found] + [[0] * m], float)))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chars, words = shared.value
        for batch in batches:
            of = np.array([number.get(x, len(number)) for x in batch.column("lang").to_pylist()], np.int64)
            own, theirs = (np.array(batch.column(c).flatten().to_numpy(zero_copy_only=False), float).reshape(len(of), -1) if len(of) else np.zeros((0, k)) for c, k in (("chars", n), ("words", m)))
            by_char, by_word = divergence(own, chars[of]), divergence(theirs, words[of])
            unlike = ((own.sum(1) >= min_chars) & (by_char > max_char_distance)) | ((theirs.sum(1) >= min_words) & (by_word > max_word_distance))
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *BASE, "base_failed")], pa.array(~failed & ~unlike), pa.array(by_char), pa.array(by_word)], ["doc_id", *BASE, "base_failed", "kept", "char_distance", "word_distance"])

    return rows.select("doc_id", "lang", *BASE, "base_failed", "chars", "words").mapInArrow(told, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
