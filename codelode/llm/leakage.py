"""Evaluation texts leaking into documents: shared-token seeds and greedy string tiling."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codelode.session import cut_lineage


@dataclass(frozen=True)
class LeakParams:
    seed_words: int = 4  # words of a seed
    least_seeds: int = 2  # different seeds a pair must share; fifteen words with two altered keep four
    tile_words: int = 3  # least words of a tile once a pair has a seed
    passage_words: int = 15  # consecutive words of an item that make a leak
    edge_words: int = 1  # altered words allowed to hide at the two ends of a passage
    gap_words: int = 6  # altered words allowed between tiles, in item and document
    altered_share: float = 0.2  # most of a passage that may be altered
    shared_share: float = 0.05  # a seed in this share of the items is wording that reports share
    part_words: int = 8  # least words of a tile that counts as part of a reordered passage
    coverage: float = 0.5  # share of an item's own words that such tiles must hold
    vocabulary_rows: int = 2_000_000  # item words held by every task; beyond, words travel as hashes


_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_HIDDEN = {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_MARK = re.compile(r"[^\w\s]+")
#: ASCII letters to lower case, control characters to blanks; marks are deleted.
_FOLD = bytes(ord(chr(c).lower()) if 33 <= c < 127 else 32 for c in range(256))
_MARKS = bytes(c for c in range(33, 127) if not (chr(c).isalnum() or c == 95))


def words(text: str) -> list[str]:
    """Words without case, mark-up, quoting, entities and compatibility forms.

    Blanks part words and marks are left out, so ``8.2.13,`` is the word ``8213`` however it is
    punctuated. Underscores inside a word stay.
    """
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if text.isascii():
        text = text.encode().translate(_FOLD, _MARKS).decode()
    else:
        text = _MARK.sub("", unicodedata.normalize("NFKC", text.translate(_HIDDEN)).lower())
    out = text.split()
    if "_" in text and any(w[0] == "_" or w[-1] == "_" for w in out):
        out = [w for w in (w.strip("_") for w in out) if w]
    return out


def word_codes(ws: list[str]) -> list[int]:
    """Stable 64-bit codes of words."""
    import xxhash

    f = xxhash.xxh64_intdigest
    return [f(w) - (1 << 63) for w in ws]


def seed_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A Karp-Rabin key for every run of ``n`` word codes (arithmetic modulo 2**64)."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.int64)
    u = codes.astype(np.int64).view(np.uint64)
    key = np.zeros(len(u) - n + 1, dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for i in range(n):
            key = key * base + (u[i : len(u) - n + 1 + i] ^ (u[i : len(u) - n + 1 + i] >> np.uint64(29)))
    return key.view(np.int64)


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(start in a, start in b, length)`` of non-overlapping matches.

    Each round finds the longest matches among unmarked words, by doubling the length
    at which Karp-Rabin keys of the two sides meet, marks them longest first, and
    repeats with shorter ones down to ``least``.
    """
    out: list[tuple[int, int, int]] = []
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    x, y = a.tolist(), b.tolist()
    length = least
    while length * 2 <= min(len(a), len(b)) and np.intersect1d(seed_keys(a, length * 2), seed_keys(b, length * 2)).size:
        length *= 2
    while length >= least:
        found = []
        ka, kb = seed_keys(a, length), seed_keys(b, length)
        both = np.intersect1d(ka, kb)
        if both.size:
            places: dict[int, list[int]] = {}
            for j in np.flatnonzero(np.isin(kb, both)).tolist():
                if free_b[j : j + length].all():
                    places.setdefault(int(kb[j]), []).append(j)
            top = min(len(a), len(b))
            for i in np.flatnonzero(np.isin(ka, both)).tolist():
                if not free_a[i : i + length].all():
                    continue
                for j in places.get(int(ka[i]), ()):
                    if i and j and x[i - 1] == y[j - 1] and free_a[i - 1] and free_b[j - 1]:
                        continue  # inside a longer match
                    n = 0
                    while n < top and i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and free_a[i + n] and free_b[j + n]:
                        n += 1
                    if n >= length:
                        found.append((-n, i, j))
        for n, i, j in sorted(found):
            # What an earlier tile has marked is cut off; the rest comes again at a shorter length.
            n = -n
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                free_a[i : i + n] = free_b[j : j + n] = False
                out.append((i, j, n))
        if length == least:
            # Matches that lost words to longer tiles may leave parts that are still long enough.
            out.extend(_rests(a, b, free_a, free_b, least))
            break
        length = max(least, length // 2)
    return sorted(out)


def _rests(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Tiles among the words that are still free, found run by run."""
    at: dict[int, list[int]] = {}
    for j, key in enumerate(seed_keys(b, least).tolist()):
        at.setdefault(key, []).append(j)
    for i, key in enumerate(seed_keys(a, least).tolist()):
        for j in at.get(key, ()):
            n = 0
            while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                free_a[i : i + n] = free_b[j : j + n] = False
                yield i, j, n


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short gaps."""
    row = [0] * (len(b) + 1)
    for x in a.tolist():
        last = 0
        for j, y in enumerate(b.tolist()):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def covered(a: np.ndarray, b: np.ndarray, found: list[tuple[int, int, int]], common: np.ndarray, p: LeakParams) -> tuple[int, int]:
    """The longest passage of item ``a`` that its tiles cover in ``b``: (words, unaltered words).

    Tiles are chained while both sides go on with at most ``gap_words`` between them; where they do not,
    a new chain starts, so that reordered parts are judged one by one. Within a chain the longest
    passage with at most ``altered_share`` of its words altered, left out or put in counts.
    Words of ``common`` wording count for nothing.
    """
    best = (0, 0)
    own = [int((~common[i : i + n]).sum()) for i, _, n in found]
    lo = 0
    while lo < len(found):
        hi = lo
        gaps: list[tuple[int, int]] = []  # words of the item, words altered
        while hi + 1 < len(found):
            (i, j, n), (i2, j2, _) = found[hi], found[hi + 1]
            if not (0 <= i2 - i - n <= p.gap_words and 0 <= j2 - j - n <= p.gap_words):
                break
            x, y = a[i + n : i2], b[j + n : j2]
            gaps.append((len(x), max(len(x), len(y)) - _alike(x, y)))
            hi += 1
        for s in range(lo, hi + 1):
            span, bad = own[s], 0
            best = max(best, (span, span))
            for e in range(s + 1, hi + 1):
                span += gaps[e - 1 - lo][0] + own[e]
                bad += gaps[e - 1 - lo][1]
                if bad <= p.altered_share * span:
                    best = max(best, (span, span - bad))
        lo = hi + 1
    return best


def matches(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """All longest runs of at least ``least`` words that both sides share, overlapping or not: ``(start in a, start in b, length)``."""
    at: dict[int, list[int]] = {}
    ka, kb = seed_keys(a, least), seed_keys(b, least)
    for i in np.flatnonzero(np.isin(ka, kb)).tolist():
        at.setdefault(int(ka[i]), []).append(i)
    x, y = a.tolist(), b.tolist()
    out = []
    for j in np.flatnonzero(np.isin(kb, ka)).tolist():
        for i in at[int(kb[j])]:
            if i and j and x[i - 1] == y[j - 1]:
                continue  # inside a longer run
            n = 0
            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                n += 1
            if n >= least:
                out.append((i, j, n))
    return out


def aligned(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]], common: np.ndarray, p: LeakParams) -> tuple[int, int]:
    """As ``covered``, over all shared runs: the longest passage on any path through them.

    Tiles own their words, so a tile put to another copy of its words breaks the chain it
    belongs to; here every run may go on in every run near its diagonal, wherever else its words stand.
    Runs that overlap are cut where they meet. Of the ways to a run those stay that no other
    beats in both words and alterations.
    """
    own = np.concatenate(([0], np.cumsum(~common))).tolist()
    by: dict[int, list[tuple[int, int, int]]] = {}
    for run in runs:
        by.setdefault(run[1] - run[0], []).append(run)
    for line in by.values():
        line.sort()
    best = (0, 0)
    ways: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}  # words, words altered, words cut from the run's start
    for run in sorted(runs, key=lambda t: (t[0] + t[2], t[1] + t[2])):
        i, j, n = run
        end, there = i + n, j + n
        kept: list[tuple[int, int, int]] = []
        for way in sorted([*ways.pop(run, ()), (own[end] - own[i], 0, 0)], key=lambda w: (w[1], -w[0], w[2])):
            if not kept or way[0] > kept[-1][0]:
                kept.append(way)
        for span, bad, _ in kept:
            if bad <= p.altered_share * span:
                best = max(best, (span, span - bad))
        for d in range(j - i - p.gap_words, j - i + p.gap_words + 1):
            line = by.get(d, ())
            # Runs of a diagonal lie apart, so few of them end behind this one and start near its end.
            for i2, j2, n2 in line[bisect_right(line, end, key=lambda t: t[0] + t[2]) :]:
                if i2 - end > p.gap_words or j2 - there > p.gap_words:
                    break
                if j2 + n2 <= there:
                    continue
                over = max(0, end - i2, there - j2)
                back = max(0, over - n2 + p.tile_words)  # words this run gives up, and the next one
                off = over - back
                x, y = a[end - back : i2 + off], b[there - back : j2 + off]
                if off > n2 - p.tile_words or len(x) > p.gap_words or len(y) > p.gap_words:
                    continue
                more = max(len(x), len(y)) - _alike(x, y)
                gain = len(x) + own[i2 + n2] - own[i2 + off] - (own[end] - own[end - back])
                for span, bad, cut in kept:
                    if n - cut - back >= p.tile_words and bad + more <= p.altered_share * len(a):
                        ways.setdefault((i2, j2, n2), []).append((span + gain, bad + more, off))
    return best


def _read(item: bool, p: LeakParams):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                codes = word_codes(words(text or ""))
                rows.append((key, codes, seed_keys(np.array(codes, dtype=np.int64), p.seed_words).tolist()))
            yield pd.DataFrame(rows, columns=["instance_id", "codes", "keys"])

    return run


def _scan(vocabulary, p: LeakParams):
    """Documents to word codes (0 for words no item has) and the keys of seeds made of item words."""
    n = p.seed_words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] | None = vocabulary.value if vocabulary else None
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                ws = words(text)
                codes = np.array([known.get(w, 0) for w in ws] if known is not None else word_codes(ws), dtype=np.int64)
                if len(codes) < n:
                    continue
                run_ok = np.convolve(codes != 0, np.ones(n, dtype=int), "valid") == n
                if not run_ok.any():
                    continue
                rows.append((key, codes, np.unique(seed_keys(codes, n)[run_ok])))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "codes", "keys"])

    return run


def _tile(p: LeakParams):
    names = ["doc_id", "instance_id", "passage", "matched", "item_words", "tiled", "covered", "leaked"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, instance_id, doc, item, common in zip(pdf["doc_id"], pdf["instance_id"], pdf["codes"], pdf["item"], pdf["common"]):
                shared = np.zeros(len(item), bool)
                shared[np.asarray(common, dtype=int)] = True
                found = tiles(np.asarray(item), np.asarray(doc), p.tile_words)
                span, own = max(covered(np.asarray(item), np.asarray(doc), found, shared, p), aligned(np.asarray(item), np.asarray(doc), matches(np.asarray(item), np.asarray(doc), p.tile_words), shared, p))
                words_of = [(n, int((~shared[i : i + n]).sum())) for i, _, n in found]
                parts = sum(w for n, w in words_of if n >= p.part_words)
                share = parts / max(1, int((~shared).sum()))
                leaked = span >= p.passage_words - p.edge_words or parts >= p.passage_words and share >= p.coverage
                rows.append((doc_id, instance_id, span, own, len(item), sum(w for _, w in words_of), share, leaked))
            yield pd.DataFrame(rows, columns=names).astype({"leaked": "bool"})

    return run


def read_items(items: DataFrame, p: LeakParams) -> DataFrame:
    """Distinct items with word codes, the keys of their seeds, and the places of common wording."""
    once = items.where("instance_id is not null and problem_statement is not null").select("instance_id", "problem_statement").distinct()
    read = cut_lineage(once.mapInPandas(_read(True, p), "instance_id string, codes array<long>, keys array<long>"))
    at = read.select("instance_id", F.posexplode("keys").alias("pos", "key"))
    many = max(3.0, p.shared_share * read.select("instance_id").distinct().count())
    often = at.groupBy("key").agg(F.countDistinct("instance_id").alias("n")).where(F.col("n") >= many)
    common = at.join(often, "key", "left_semi").select("instance_id", F.explode(F.sequence("pos", F.col("pos") + p.seed_words - 1)).alias("w")).groupBy("instance_id").agg(F.sort_array(F.collect_set("w")).alias("common"))
    rare = at.join(often, "key", "left_anti").groupBy("instance_id").agg(F.collect_set("key").alias("seeds"))
    return read.drop("keys").join(common, "instance_id", "left").join(rare, "instance_id", "left").withColumn("common", F.coalesce("common", F.array().cast("array<int>")))


def leaks(documents: DataFrame, items: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """``(doc_id, instance_id, passage, matched, item_words, tiled, covered, leaked)`` for every pair that shares ``least_seeds`` seeds.

    ``passage`` is the longest passage of the item that the document repeats, in words
    of the item that are not wording shared by many items, and ``matched`` how many of those
    are unaltered; ``tiled`` counts all words in tiles, wherever they stand, and ``covered`` is the share
    of the item in tiles of ``part_words`` or more, so reordered copies show there. ``leaked``: a passage of
    ``passage_words``, or such parts in any order that hold ``coverage`` of the item. Documents and items that are null or blank
    give no rows; repeated items count once.

    Documents are read once. Only seeds whose words all occur in items leave a task, so what is
    shuffled follows what is shared. The item vocabulary goes to every task while it has at most
    ``vocabulary_rows`` words; a larger one is left out and all seeds take part in the join.
    """
    spark = documents.sparkSession
    read = cut_lineage(read_items(items, p))
    size = read.select(F.sum(F.size("codes"))).first()[0] or 0
    vocabulary = None
    if size <= p.vocabulary_rows:
        texts = items.where("problem_statement is not null").select("problem_statement").distinct().toArrow()
        known = sorted({w for t in texts.column(0).to_pylist() for w in words(t)})
        vocabulary = spark.sparkContext.broadcast(dict(zip(known, word_codes(known))))
    scanned = cut_lineage(documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(_scan(vocabulary, p), "doc_id long, codes array<long>, keys array<long>"))
    seeds = read.select("instance_id", F.explode("seeds").alias("key"))
    pairs = scanned.select("doc_id", F.explode("keys").alias("key")).join(seeds, "key").groupBy("doc_id", "instance_id").agg(F.count("*").alias("n")).where(F.col("n") >= p.least_seeds).drop("n")
    # Texts and items join once more, by their ids; a pair carries one document and one item.
    wide = pairs.join(scanned.select("doc_id", "codes"), "doc_id").join(read.select("instance_id", F.col("codes").alias("item"), "common"), "instance_id")
    return wide.select("doc_id", "instance_id", "codes", "item", "common").mapInPandas(_tile(p), "doc_id long, instance_id string, passage int, matched int, item_words int, tiled int, covered double, leaked boolean")


def p8_found(documents: DataFrame, items: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """Pairs in which the document repeats a passage of at least ``passage_words`` words, or most of the item in parts."""
    return leaks(documents, items, p).where("leaked").select("doc_id", "instance_id").distinct()
