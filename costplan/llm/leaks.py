"""Test passages leaking into training text, found by winnowing.

Both sides are cut into words (see text.words). A fingerprint is the hash of k successive words;
of every window of w successive fingerprints the least is kept (the rightmost of equals). Two
texts that share at least w + k - 1 words in a row share a whole window and so keep the same
fingerprint of it: with k = 6 and w = 5 no common passage of ten words or more can be missed.
Training and test fingerprints are joined and every hit is extended word by word on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costplan.llm.text import words
from costplan.session import written

K, W = 6, 5


def _hashes(tokens: list[str], k: int, known: dict[str, int]) -> np.ndarray:
    """64-bit hash of each k successive words."""
    import xxhash

    n = len(tokens) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    codes = np.empty(len(tokens), np.uint64)
    for i, t in enumerate(tokens):
        h = known.get(t)
        if h is None:
            if len(known) > 200_000:
                known.clear()
            h = known[t] = xxhash.xxh64_intdigest(t)
        codes[i] = h
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash of each window of w (the rightmost of equals); all of them if there are fewer than w."""
    if len(h) == 0:
        return np.empty(0, np.int64)
    if len(h) <= w:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    windows = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.unique(np.arange(len(windows)) + w - 1 - windows.argmin(axis=1))


def _scan(id_type, k: int, w: int, span: int, wanted: np.ndarray | None):
    """Rows (id, side, hash, before, after) of the kept fingerprints that are wanted (all if None).

    before holds the span - k words before the k-gram, nearest last; after the k words and the
    span - k words that follow. That is all an extension to span words needs.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            out: dict[str, list] = {"id": [], "side": [], "hash": [], "before": [], "after": []}
            for i, side, text in zip(batch["id"], batch["side"], batch["text"]):
                tokens = words(text)
                h = _hashes(tokens, k, known)
                at = winnow(h, w)
                values = h[at].view(np.int64)
                if wanted is not None and len(values):
                    place = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1) if len(wanted) else np.zeros(len(values), int)
                    hit = wanted[place] == values if len(wanted) else np.zeros(len(values), bool)
                    at, values = at[hit], values[hit]
                for p, v in zip(at.tolist(), values.tolist()):
                    out["id"].append(i)
                    out["side"].append(side)
                    out["hash"].append(v)
                    out["before"].append(tokens[max(0, p - span + k) : p])
                    out["after"].append(tokens[p : p + span])
            yield pd.DataFrame(out).astype({"side": object})

    return work


def _fingerprints(texts: DataFrame, k: int, w: int, span: int, wanted: np.ndarray | None) -> DataFrame:
    return texts.mapInPandas(_scan(None, k, w, span, wanted), "id long, side string, hash long, before array<string>, after array<string>")


def leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, sides: list[str], span: int = 10, k: int = K, most_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, side) for each document and test item that share span successive words.

    Null and empty texts share nothing, neither do texts of fewer than span words; repeated
    documents and items each give their rows, once. The test side's distinct fingerprints are
    counted: up to most_broadcast of them (8 bytes each) go to every task, so that only hits
    leave the scan; beyond that all training fingerprints are shuffled by hash and joined.
    Columns other than the named ones are ignored, whatever they are called.
    """
    w = span - k + 1
    if k < 1 or w < 1:
        raise ValueError("k must lie between 1 and span")
    tests = items.select(F.col(item_id).cast("long").alias("id"), F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("text")) for s in sides])).alias("s")).select("id", "s.side", "s.text")
    tests = tests.where(F.col("id").isNotNull() & F.col("text").isNotNull()).distinct()
    tests = written(_fingerprints(tests, k, w, span, None), "fingerprints")
    hashes = tests.select("hash").distinct()
    wanted = None
    if hashes.count() <= most_broadcast:
        wanted = np.sort(np.array([r[0] for r in hashes.toLocalIterator()], np.int64))
    docs = corpus.select(F.col(doc_id).cast("long").alias("id"), F.lit("").alias("side"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    found = _fingerprints(docs, k, w, span, wanted)
    a, b = found.alias("a"), tests.alias("b")
    both = a.join(b, F.col("a.hash") == F.col("b.hash"))
    # Extension: common words to the left (nearest first) and, from the k-gram's start, to the right.
    left, right = (F.arrays_zip(F.reverse(F.col("a.before")).alias("x"), F.reverse(F.col("b.before")).alias("y")), F.arrays_zip(F.col("a.after").alias("x"), F.col("b.after").alias("y")))
    same = lambda z: F.aggregate(z, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, p: F.struct((s["n"] + (s["on"] & F.coalesce(p["x"] == p["y"], F.lit(False))).cast("int")).alias("n"), (s["on"] & F.coalesce(p["x"] == p["y"], F.lit(False))).alias("on")))["n"]
    forward = same(right)
    whole = both.where((forward >= k) & (forward + same(left) >= span))
    return whole.select(F.col("a.id").alias("doc_id"), F.col("b.id").alias("item_id"), F.col("b.side").alias("side")).distinct()
