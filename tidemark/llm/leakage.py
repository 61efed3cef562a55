"""Passages of held-out items inside a corpus: size-partitioned MinHash containment, verified word by word.

What counts as leaked is a run of RUN words in common. A query is such a passage of an item: a set of RUN - SHINGLE + 1
shingles of SHINGLE words. The domains are windows of the documents: a text is covered by windows of WINDOW words that
overlap by RUN - 1, so that every passage lies whole within one. MinHash estimates Jaccard similarity, so the windows
are partitioned by size: in the partition of windows of u shingles a passage of q shingles that is contained (a
containment of 1) has a Jaccard similarity of q / u. A window and an item that agree in AGREE hash functions or more are a
candidate, and the number of hash functions is set so that the chance that fewer agree is at most MISS (`bands`). Short
texts are one small window and need few.

1. The items' signatures are a table (signature, item), made in parallel, however many items there are.
2. One pass over the corpus makes the signatures of all windows. Windows of which fewer than AGREE are in a Bloom filter
   of the items' signatures are dropped at once; the filter has at most FILTER_BITS bits, and beyond FILTER_KEYS signatures there is none, which
   costs time and no result.
3. The rest are joined with the items' table on the signature (broadcast if it is counted to be small, else a shuffle
   whose hot signatures Spark splits), and the agreements of a window and an item are counted.
4. Candidates are verified exactly: the window holds RUN consecutive words of the item.

Defined cases: null and empty texts and texts under RUN words hold no passage. Each document and item is reported
once. Repeated documents and items are each reported; null ids are ids like others. Markup within a line is a gap between
words, then entities are resolved, then invisible characters dropped; letters are compared without regard to case. Very
long texts are worked through in parts of PART_WORDS words. Other columns are ignored. Empty tables give nothing.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut, maybe_broadcast

RUN, SHINGLE, WINDOW = 12, 5, 16
#: Agreeing signatures that make a candidate, and the chance that a passage has fewer with the window that holds it.
AGREE, MISS = 3, 1e-9
FILTER_BITS, FILTER_KEYS = 1 << 27, 1 << 23
INDEX_ROWS, PART_WORDS = 500_000, 50_000
_MARKUP = re.compile(r"<[^<>\n]*>|\[[^\[\]\n]*\]")
#: Soft hyphen, zero-width and invisible formatting characters.
_INVISIBLE = re.compile("[­͏᠎​-‏‪-‮⁠-⁤﻿]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "<" in text or "[" in text:
        text = _MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return _WORD.findall(text.casefold())


class Hasher:
    """64-bit hashes of words, kept for the words of a process as long as they are few."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        out = []
        for w in ws:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, "uint64")


def bands(shingles: int, passage: int, agree: int = AGREE, miss: float = MISS) -> int:
    """How many hash functions it takes that `agree` of them find a passage of so many shingles in a window of `shingles`,
    but for a chance of `miss`."""
    n, j = agree, min(1.0, passage / shingles)
    while sum(math.comb(n, k) * j**k * (1 - j) ** (n - k) for k in range(agree)) > miss:
        n += 1
    return n


def shingle_hashes(h: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of each run of `shingle` word hashes."""
    m = max(0, len(h) - shingle + 1)
    with np.errstate(over="ignore"):
        s = np.zeros(m, "uint64")
        for k in range(shingle):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
        s ^= s >> np.uint64(31)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        return s ^ (s >> np.uint64(29))


def family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd multipliers of n hash functions."""
    r = np.random.default_rng(20240521)
    return r.integers(0, 2**63, (n, 1), "uint64"), r.integers(0, 2**63, (n, 1), "uint64") * np.uint64(2) + np.uint64(1)


def window_minima(s: np.ndarray, width: int, n: int, pad: np.ndarray | None = None) -> np.ndarray:
    """(n, len(s) - width + 1): under each hash function the least hash of every `width` consecutive shingles, with the
    function's number mixed in. Padding never is a minimum."""
    mask, mul = family(n)
    with np.errstate(over="ignore"):
        m = (s ^ mask) * mul
    if pad is not None:
        m[:, pad] = np.uint64(2**64 - 1)
    have = 1
    while have < width:  # minima of 2, 4, 8 ... and then of exactly `width` shingles
        step = min(have, width - have)
        m = np.minimum(m[:, : m.shape[1] - step], m[:, step:])
        have += step
    return m ^ (np.arange(n, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15))[:, None]


def passage_signatures(text: str | None, hasher: Hasher, run: int, shingle: int, n: int) -> np.ndarray:
    """The distinct signatures of all passages of an item."""
    s = shingle_hashes(hasher(words(text)), shingle)
    width = run - shingle + 1
    if len(s) < width:
        return np.empty(0, "uint64")
    part = PART_WORDS
    return np.unique(np.concatenate([window_minima(s[i : i + part + width - 1], width, n).ravel() for i in range(0, len(s) - width + 1, part)]))


def _hit(filter_: np.ndarray | None, sig: np.ndarray) -> np.ndarray:
    """Which signatures may be in the filter (two bits each)."""
    if filter_ is None:
        return np.ones(sig.shape, bool)
    top = np.uint64(len(filter_) * 64 - 1)
    test = lambda p: (filter_[(p >> np.uint64(6)).astype("int64")] >> (p & np.uint64(63))) & np.uint64(1) != 0
    out = test(sig & top)
    out[out] = test((sig[out] >> np.uint64(32)) & top)
    return out


def make_filter(signatures: DataFrame, keys: int) -> np.ndarray | None:
    """A Bloom filter of the column `sig`, in 64-bit words; None if there are too many keys for one."""
    if keys > FILTER_KEYS:
        return None
    bits = min(FILTER_BITS, max(1 << 16, 1 << (64 * max(1, keys) - 1).bit_length()))
    top = np.uint64(bits - 1)

    def partial(batches):
        w = np.zeros(bits // 64, "uint64")
        for b in batches:
            sig = b.sig.to_numpy("int64").view("uint64")
            for p in (sig & top, (sig >> np.uint64(32)) & top):
                np.bitwise_or.at(w, (p >> np.uint64(6)).astype("int64"), np.uint64(1) << (p & np.uint64(63)))
        yield pd.DataFrame({"w": [w.tobytes()]})

    out = np.zeros(bits // 64, "uint64")
    for r in signatures.select("sig").coalesce(4).mapInPandas(partial, "w binary").toLocalIterator():  # 16 MB each at most
        out |= np.frombuffer(bytes(r.w), "uint64")
    return out


def _windows(n: int, window: int, run: int) -> range | list[int]:
    """First words of the windows that cover n >= run words."""
    if n <= window:
        return [0]
    starts = list(range(0, n - window + 1, window - run + 1))
    return starts if starts[-1] == n - window else [*starts, n - window]


def item_index(items: DataFrame, run: int = RUN, shingle: int = SHINGLE, window: int = WINDOW) -> DataFrame:
    """(sig, item_id): the distinct signatures of items(item_id, text)."""
    n, kind = bands(window - shingle + 1, run - shingle + 1), items.schema["item_id"].dataType.simpleString()

    def sign(batches):
        hasher = Hasher()
        for b in batches:
            ids, sigs = [], []
            for i, t in zip(b.item_id, b.text, strict=True):
                sigs.append(passage_signatures(t, hasher, run, shingle, n))
                ids += [i] * len(sigs[-1])
                if len(ids) > 500_000:
                    yield pd.DataFrame({"sig": np.concatenate(sigs).view("int64"), "item_id": ids})
                    ids, sigs = [], []
            if ids:
                yield pd.DataFrame({"sig": np.concatenate(sigs).view("int64"), "item_id": ids})

    return items.mapInPandas(sign, f"sig long, item_id {kind}").distinct()


def candidate_windows(docs: DataFrame, filter_, run: int = RUN, shingle: int = SHINGLE, window: int = WINDOW) -> DataFrame:
    """(doc_id, at, passages, sigs) of the windows of docs(doc_id, text) with enough signatures that may be in the filter (a
    broadcast): the first word's place, and each run of words spelled between blanks."""
    q, u = run - shingle + 1, window - shingle + 1
    of_size = np.array([bands(max(k, q), q) for k in range(u + 1)])
    n, kind = int(of_size[u]), docs.schema["doc_id"].dataType.simpleString()

    def search(batches):
        hasher, known = Hasher(), filter_.value
        for b in batches:
            parts: list[tuple] = []
            size = 0

            def flush(parts):
                s, pad, at, need, where = [], [], [], [], []
                base = 0
                for i, w, first, starts in parts:
                    h = shingle_hashes(hasher(w), shingle)
                    empty = max(0, u - len(h))
                    s += [h, np.zeros(empty, "uint64")]
                    pad += [np.zeros(len(h), bool), np.ones(empty, bool)]
                    at.append(np.asarray(starts) + base)
                    need.append(np.full(len(starts), of_size[min(len(h), u)]))
                    where += [(i, w, first, k) for k in starts]
                    base += len(h) + empty
                sig = window_minima(np.concatenate(s), u, n, np.concatenate(pad))[:, np.concatenate(at)]
                hit = np.zeros(sig.shape, bool)
                used = np.arange(n)[:, None] < np.concatenate(need)[None]
                hit[used] = _hit(known, sig[used])
                some = np.flatnonzero(hit.sum(axis=0) >= AGREE)
                rows = []
                for k in some:
                    i, w, first, at = where[k]
                    ends = range(at, min(at + window, len(w)) - run + 1)
                    rows.append((i, first + at, [f" {' '.join(w[j : j + run])} " for j in ends], sig[hit[:, k], k].view("int64").tolist()))
                return pd.DataFrame(rows, columns=["doc_id", "at", "passages", "sigs"])

            for i, t in zip(b.doc_id, b.text, strict=True):
                w = words(t)
                if len(w) < run:
                    continue
                starts = _windows(len(w), window, run)
                per = PART_WORDS // (window - run + 1)
                for k in range(0, len(starts), per):
                    mine = starts[k : k + per]
                    parts.append((i, w[mine[0] : mine[-1] + window], mine[0], [x - mine[0] for x in mine]))
                    size += mine[-1] + window - mine[0]
                    if size >= PART_WORDS:
                        yield flush(parts)
                        parts, size = [], 0
            if parts:
                yield flush(parts)

    return docs.mapInPandas(search, f"doc_id {kind}, at long, passages array<string>, sigs array<long>")


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN, shingle: int = SHINGLE, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id) of every document that holds `run` consecutive words of an item."""
    if not 0 < shingle <= run <= window:
        raise ValueError("0 < shingle <= run <= window is needed")
    it = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter(F.length("text") >= 2 * run - 1)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") >= 2 * run - 1)
    index = cut(item_index(it, run, shingle, window))
    keys = index.count()
    sent = docs.sparkSession.sparkContext.broadcast(make_filter(index, keys))
    found = cut(candidate_windows(d, sent, run, shingle, window))  # few of the corpus's windows, used twice
    pairs = found.select("doc_id", "at", F.explode("sigs").alias("sig")).join(maybe_broadcast(index, INDEX_ROWS), "sig").groupBy(F.col("doc_id").alias("d_"), F.col("at").alias("a_"), "item_id").agg(F.count("*").alias("n")).filter(F.col("n") >= AGREE)
    kind = items.schema[item_id].dataType.simpleString()

    def spell(batches):
        for b in batches:
            yield pd.DataFrame({"i_": b.item_id, "whole": [f" {' '.join(words(t))} " for t in b.text]})

    whole = it.distinct().mapInPandas(spell, f"i_ {kind}, whole string")
    x = pairs.join(found.select("doc_id", "at", "passages"), F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("at") == F.col("a_")))
    x = x.join(maybe_broadcast(whole), F.col("item_id").eqNullSafe(F.col("i_")))
    return x.filter(F.exists("passages", lambda p: F.contains(F.col("whole"), p))).select("doc_id", "item_id").distinct()
