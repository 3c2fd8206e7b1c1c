"""Scores for abusive, hateful or sexual language.

A text is folded (markup, invisible characters, accents, case, look-alike letters), disguised words
are unmasked (digits and signs for letters, s.p.a.c.e.d letters, streeetched letters, st*rs), and
one Aho-Corasick automaton finds the weighted entries of the lexicon and the phrases of harmless
use, whose hits are taken back. The score is the sum of the weights (light entries count once a
text) in relation to the length, and a text is offensive from a fixed score on.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costplan.llm.lexicon import LIGHT, entries, harmless
from costplan.llm.text import fold_letters, plain

#: Signs and digits that stand for letters, fixed values; 1 stands for i or l.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "!": "i", "|": "i", "+": "t"}

_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:(?P<sep>[ .\-_·•,/])[^\W_](?![^\W_]))(?:(?P=sep)[^\W_](?![^\W_]))+")
_MIXED = regex.compile(r"[\p{L}\p{N}$@€!|+*#]*[\p{L}*#][\p{L}\p{N}$@€!|+*#]*")
_ODD = re.compile(r"[0-9$@€|+*#!]|([^\W\d_])\1\1")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_RUN = re.compile(r"(.)\1+")
_WORD = re.compile(r"[^\W_]+")


class Matcher:
    """The automaton and the tables that unmask disguised words; built once in each Python worker."""

    def __init__(self) -> None:
        import ahocorasick

        self.phrases = entries()
        self.vocabulary = {w for p in self.phrases for w in p.split() if len(w) > 2}
        # For words with stars: those that are entries themselves come before parts of phrases.
        alone = {p: -w for p, (_, w) in self.phrases.items() if " " not in p}
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(alone.keys() | {w for w in self.vocabulary if len(w) > 3}, key=lambda w: (alone.get(w, 0.0), w)):
            self.by_length[len(w)].append(w)
        self.squeezed = {}
        for w in sorted(self.vocabulary, reverse=True):
            self.squeezed.setdefault(_RUN.sub(r"\1", w), w)
        self.automaton = ahocorasick.Automaton()
        safe = set(harmless())
        for p in {*self.phrases, *safe}:
            self.automaton.add_word(f" {p} ", (len(p), self.phrases.get(p), p in safe))
        self.automaton.make_automaton()
        self.table = str.maketrans(SIGNS)
        self.other = str.maketrans(SIGNS | {"1": "l", "!": "l", "|": "l"})

    def _known(self, word: str) -> str | None:
        if word in self.vocabulary:
            return word
        return self.squeezed.get(_RUN.sub(r"\1", word)) if _TRIPLE.search(word) else None

    def unmask(self, token: str) -> str:
        """The lexicon's word that a token with signs, digits, stars or stretched letters stands for, else the token."""
        bare = token.strip("!|+")
        for t in (bare, token):
            for table in (self.table, self.other):
                if found := self._known(t.translate(table)):
                    return found
        if "*" in bare or "#" in bare:
            shape = bare.translate(self.table)
            if any(c not in "*#" for c in shape):
                for w in self.by_length.get(len(shape), ()):
                    if all(a == b or a in "*#" for a, b in zip(shape, w)):
                        return w
        return token

    def _joined(self, m: re.Match) -> str:
        letters = m[0].replace(m["sep"], "")
        return f" {letters} " if self._known(letters.translate(self.table)) or self._known(letters.translate(self.other)) else m[0]

    def folded(self, text: str) -> str:
        t = fold_letters(plain(text))
        t = _SPACED.sub(self._joined, t)
        parts = t.split()
        if any(not p.isalpha() for p in parts) or _TRIPLE.search(t):
            for i, p in enumerate(parts):
                # Plain words and plain numbers, by far the most, need no look at their letters.
                if (p.isalpha() and not _TRIPLE.search(p)) or p.isdigit():
                    continue
                if _ODD.search(p):
                    parts[i] = _MIXED.sub(lambda m: self.unmask(m[0]) if _ODD.search(m[0]) else m[0], p)
            t = " ".join(parts)
        return f" {' '.join(_WORD.findall(t))} "

    def hits(self, text: str | None) -> tuple[dict[str, float], int]:
        """Weights by category and the number of words; the longest of entries that share a start or lie inside one another counts."""
        if not text:
            return {}, 0
        t = self.folded(text)
        spans, safe = [], []
        for end, (n, entry, is_safe) in self.automaton.iter(t):
            where = (end - n, end)
            if is_safe:
                safe.append(where)
            if entry:
                spans.append((*where, entry))
        total: dict[str, float] = defaultdict(float)
        reached, once = -1, set()
        for a, b, (category, weight) in sorted(spans, key=lambda s: (s[0], -s[1])):
            if b <= reached or any(x <= a and b <= y for x, y in safe):
                continue
            reached = max(reached, b)
            if weight <= LIGHT:
                if t[a:b] in once:
                    continue
                once.add(t[a:b])
            total[category] += weight
        return dict(total), t.count(" ") - 1


CATEGORIES = ("insult", "threat", "hate", "sexual")


#: A text of this score or more is offensive: one strong entry in up to about 700 words, two in up to 11 000.
OFFENSIVE = 0.4


def score(df: DataFrame, text: str, words_of_one: int = 200) -> DataFrame:
    """df with insult, threat, hate, sexual (weights found), n_words, evidence, score and offensive.

    evidence is the sum of the weights, score is evidence / (1 + ln(1 + n_words / words_of_one)),
    and a text is offensive from a score of OFFENSIVE on: longer texts need more evidence. A null
    or empty text has no words, no evidence and a score of 0. Texts are read whole. The scan needs no
    shuffle. Columns of df of these names are refused, as they would clash.
    """
    new = ["n_words", *CATEGORIES, "evidence", "score", "offensive"]
    if clash := set(new) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    kind = "struct<n_words:long," + ",".join(f"{c}:double" for c in CATEGORIES) + ">"

    @F.pandas_udf(kind)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher()
        for s in parts:
            rows = [matcher.hits(x if isinstance(x, str) else None) for x in s]
            yield pd.DataFrame([(n, *(w.get(c, 0.0) for c in CATEGORIES)) for w, n in rows], columns=["n_words", *CATEGORIES])

    hit = df.withColumn("__hit", found(F.col(text)))
    flat = hit.select(*df.columns, *[F.col(f"__hit.{c}").alias(c) for c in ("n_words", *CATEGORIES)])
    evidence = F.round(sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0])), 6)
    flat = flat.withColumn("evidence", evidence)
    return flat.withColumn("score", F.round(F.col("evidence") / (1 + F.log1p(F.col("n_words") / words_of_one)), 6)).withColumn("offensive", F.col("score") >= OFFENSIVE)


def strength(evidence: float, n_words: int, words_of_one: int = 200) -> float:
    """The score of a single text."""
    return evidence / (1 + math.log1p(n_words / words_of_one))
