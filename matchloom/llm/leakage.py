"""Evaluation texts inside training documents: a BM25 index searched with block-max WAND under a bound of each item, then an exact check."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import spread, stored

WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­​-‏⁠﻿]|\\\\-|\\{\\}")
_BROKEN = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t]*%?[ \t]*(?=\w)")
_MATH = re.compile(r"\$\$?[^$\n]*[\\^_=<>+{}][^$\n]*\$\$?")
_MACRO = re.compile(r"\\(?:(?:re|provide)?newcommand\*?\s*\{?|def\s*)\\([A-Za-z]+)\}?\s*\{([^{}\\$#]*[^\W\d_][^{}\\$#]*)\}")
_POINTER = re.compile(r"\\(?:[A-Za-z]*cite[A-Za-z]*\*?(?:\[[^\]]*\])*|label|ref|eqref|pageref|index|hspace\*?|vspace\*?)\s*\{[^{}]*\}")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?|\\[^A-Za-z\s]")


@dataclass
class Settings:
    """BM25's k1 and b, the share of an item's words that has to be carried, and the postings in a block."""

    k1: float = 1.2
    b: float = 0.4
    coverage: float = 0.3
    block: int = 16


@dataclass
class Counts:
    """Different items and their words in all, and how many items hold a word, or a pair of neighbouring words."""

    items: int
    words: int
    in_items: dict[str, int]
    pairs: dict[tuple[str, str], int]


class ItemIndex:
    """Inverted lists of the items' word pairs with BM25 contributions, in blocks that know their largest one.

    Items of the same words are held once, with all their ids.  Contributions are in units of the item's own bound (see
    ``_least``), so that every item that the check can accept has a score of 1 or more.
    """

    def __init__(self, items: list[tuple[int, str]], settings: Settings, corpus: Counts | None = None):
        self.settings = settings
        same: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for i, t in items:
            same[tuple(WORD.findall(t.lower()))].append(i)
        self.ids = list(same.values())
        self.words = [list(words) for words in same]
        lists: dict[tuple[str, str], dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for d, words in enumerate(self.words):
            for pair in zip(words, words[1:], strict=False):
                lists[pair][d] += 1
        if corpus is None:
            in_items: dict[str, int] = defaultdict(int)
            for words in self.words:
                for w in set(words):
                    in_items[w] += 1
            corpus = Counts(len(self.words), sum(map(len, self.words)), in_items, {p: len(d) for p, d in lists.items()})
        n, mean = max(1, corpus.items), corpus.words / max(1, corpus.items) or 1.0
        #: rarity of single words, for the check; squared, so that words which every sentence of a pattern has weigh little
        self.weight = {w: log(1 + n / c) ** 2 for w, c in corpus.in_items.items()}
        self.postings: dict[tuple[str, str], tuple[list[int], list[float], list[float]]] = {}
        self.most: dict[tuple[str, str], float] = {}
        k1, b = settings.k1, settings.b
        raw: dict[tuple[str, str], list[float]] = {}
        own: list[list[tuple[tuple[str, str], int, float]]] = [[] for _ in self.words]
        for pair, docs in lists.items():
            idf = log(1 + (n - corpus.pairs[pair] + 0.5) / (corpus.pairs[pair] + 0.5))
            raw[pair] = [idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(self.words[d]) / mean)) for d, tf in docs.items()]
            for (d, tf), score in zip(docs.items(), raw[pair], strict=True):
                own[d].append((pair, tf, score))
        least = [self._least(words, pairs) for words, pairs in zip(self.words, own, strict=True)]
        for pair, docs in lists.items():
            order = list(docs)  # ascending, as items were read in turn
            scores = [score / least[d] for d, score in zip(order, raw[pair], strict=True)]
            blocks = [max(scores[i : i + settings.block]) for i in range(0, len(scores), settings.block)]
            self.postings[pair] = (order, scores, blocks)
            self.most[pair] = max(blocks)

    def _least(self, words: list[str], pairs: list[tuple[tuple[str, str], int, float]]) -> float:
        """A score that no text misses which carries ``coverage`` of the item's words and of their weights.

        A pair that the text has carries two words at each of its places, at most.  The cheapest pairs, the last one in
        part, that make up the share are no dearer than any others that do; this holds for words and for weights.
        """
        least = 0.0
        for gain, total in ((lambda p: 2.0, len(words)), (lambda p: self.weight[p[0]] + self.weight[p[1]], sum(self.weight[w] for w in words))):
            need, cost = self.settings.coverage * total, 0.0
            for given, score in sorted(((tf * gain(pair), score) for pair, tf, score in pairs), key=lambda x: x[1] / x[0]):
                cost += score * min(1.0, need / given)
                need -= given
                if need <= 0:
                    break
            least = max(least, cost)
        return least * (1 - 1e-9)

    def search(self, terms: list[tuple[str, str]], threshold: float) -> list[int]:
        """Every item whose score for these terms reaches ``threshold``, by block-max WAND."""
        size, end = self.settings.block, len(self.ids)
        lists = [(*self.postings[t], self.most[t]) for t in terms]
        at = [0] * len(lists)
        heads = [docs[0] for docs, _, _, _ in lists]
        order = list(range(len(lists)))
        out = []
        while True:
            order.sort(key=heads.__getitem__)
            reach, pivot = 0.0, end
            for rank, k in enumerate(order):
                if heads[k] == end:
                    break
                reach += lists[k][3]
                if reach >= threshold:
                    pivot, last = heads[k], rank
                    break
            if pivot == end:
                return out
            while last + 1 < len(order) and heads[order[last + 1]] == pivot:
                last += 1
            # what the blocks that hold the pivot can give at most
            bound, leap = 0.0, end
            for k in order[: last + 1]:
                docs, _, blocks, _ = lists[k]
                i = at[k]
                while i < len(docs) and docs[min((i // size + 1) * size, len(docs)) - 1] < pivot:
                    i = (i // size + 1) * size
                if i < len(docs):
                    bound += blocks[i // size]
                    leap = min(leap, docs[min((i // size + 1) * size, len(docs)) - 1] + 1)
            if bound >= threshold:
                target, score = pivot, 0.0
                for k in order[: last + 1]:
                    docs, scores, _, _ = lists[k]
                    i = at[k]
                    while i < len(docs) and docs[i] < pivot:
                        i += 1
                    if i < len(docs) and docs[i] == pivot:
                        score += scores[i]
                        i += 1
                    at[k], heads[k] = i, docs[i] if i < len(docs) else end
                if score >= threshold:
                    out.append(target)
            else:
                leap = max(pivot + 1, min(leap, heads[order[last + 1]] if last + 1 < len(order) else end))
                for k in order[: last + 1]:
                    docs, i = lists[k][0], at[k]
                    while i < len(docs) and docs[i] < leap:
                        i += 1
                    at[k], heads[k] = i, docs[i] if i < len(docs) else end

    def retrieve(self, words: list[str]) -> list[int]:
        """Items that the whole document retrieves; their stretches may stand anywhere in it."""
        terms = [pair for pair in set(zip(words, words[1:], strict=False)) if pair in self.most]
        return self.search(terms, 1.0) if sum(map(self.most.__getitem__, terms)) >= 1.0 else []

    def reachable(self, k: int, pairs: set[tuple[str, str]]) -> bool:
        """Whether the words of item ``k`` that stand in any of these pairs make up the share, by number and by weight."""
        item = self.words[k]
        on = {q for p, pair in enumerate(zip(item, item[1:], strict=False)) if pair in pairs for q in (p, p + 1)}
        share = self.settings.coverage * (1 - 1e-9)
        return len(on) >= share * len(item) and sum(self.weight[item[p]] for p in on) >= share * sum(map(self.weight.__getitem__, item))


def readable(text: str) -> list[str]:
    """The document's words as they would be set: author's macros written out, broken words joined, pointers and formulas left out."""
    t = _BROKEN.sub("", _INVISIBLE.sub("", text if text.isascii() else unicodedata.normalize("NFKC", text)))
    if "\\" in t:
        own = {name: body for name, body in _MACRO.findall(t)}
        if own:
            t = re.sub(r"\\(" + "|".join(sorted(map(re.escape, own), key=len, reverse=True)) + r")(?![A-Za-z])", lambda m: f" {own[m[1]]} ", t)
        t = _POINTER.sub(" ", t)
        t = _COMMAND.sub(" ", _MATH.sub(" ", t))
    return WORD.findall(t.lower())


def carried(item: list[str], words: list[str], weight: dict[str, float]) -> tuple[float, float]:
    """Shares of the item's words, and of their weights, that the text carries in stretches that keep the item's wording.

    Word pairs of the item that stand in the text are chained while both move on by a few words, so that a changed,
    broken or inserted word does not end a stretch.  A stretch counts if seven words of it or more are the item's and
    they make up seven tenths of the item's words that it spans.  Longer stretches come first and no word of the text
    is used twice, so that one sentence cannot stand for several of the item's that follow the same pattern.
    """
    where = defaultdict(list)
    for p, pair in enumerate(zip(item, item[1:], strict=False)):
        where[pair].append(p)
    chains: list[tuple] = []  # last p, last j, {item position: text position}, first p
    done = []
    for j, pair in enumerate(zip(words, words[1:], strict=False)):
        spots = where.get(pair)
        if not spots:
            continue
        keep = []
        for c in chains:
            (keep if j - c[1] <= 9 else done).append(c)
        chains = keep
        for p in spots:
            fit = [c for c in chains if 0 < p - c[0] <= 5 and j > c[1]]
            if fit:
                c = max(fit, key=lambda c: len(c[2]))
                c[0], c[1] = p, j
                c[2].update({p: j, p + 1: j + 1})
            else:
                chains.append([p, j, {p: j, p + 1: j + 1}, p])
    covered: set[int] = set()
    used: set[int] = set()
    for last, _, spots, first in sorted(done + chains, key=lambda c: (-len(c[2]), c[3], c[1])):
        own = {p for p, j in spots.items() if j not in used and p not in covered}
        if len(own) >= 7 and len(own) >= 0.7 * (last + 2 - first):
            covered |= own
            used |= {spots[p] for p in own}
    total = sum(weight.get(w, 0.0) for w in item)
    return len(covered) / max(1, len(item)), sum(weight.get(item[p], 0.0) for p in covered) / total if total else 0.0


#: Items that one index holds; a longer list is searched in parts, each over the words of all documents.
INDEX_ITEMS = 20_000


def leaked_items(documents: DataFrame, items: DataFrame, settings: Settings | None = None, index_items: int = INDEX_ITEMS) -> DataFrame:
    """``(doc_id, item_id, coverage)`` for every document that carries enough of an item's text.

    Every document, as it reads once it is set, is a query against the index of all items; what reaches the item's
    bound, as all do that the check can accept, is then checked word by word.  The items are counted before they are
    broadcast; more than ``index_items`` are cut into parts, which share the counts of the whole list, so that the
    number of parts changes no weight and no bound.

    Documents or items without text match nothing, an item of a single word cannot be found, copies of a document
    are found each, and empty tables give an empty result.
    """
    settings = settings or Settings()
    wanted = items.where("item_id is not null and text is not null").select("item_id", "text")
    parts = max(1, -(-wanted.count() // index_items))
    texts = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    send = documents.sparkSession.sparkContext.broadcast
    if parts == 1:
        return _searched(texts, send((sorted((r.item_id, r.text) for r in wanted.collect()), None)), settings)
    # a long list: documents are read once, and every part of the list is weighed by the counts of the whole
    texts = stored(texts.select("doc_id", F.array_join(_words(readable)("text"), " ").alias("text")))
    wanted = stored(wanted.select("item_id", "text", _words(lambda t: WORD.findall(t.lower()))("text").alias("words")))
    one = wanted.select("words").distinct().withColumn("part", F.pmod(F.xxhash64("words"), F.lit(parts)))
    total = one.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("words")).head()
    neighbours = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.struct(F.get("words", i).alias("a"), F.get("words", i + 1).alias("b"))))
    terms = [stored(one.select("part", F.explode(F.array_distinct(c)).alias("t"))) for c in (F.col("words"), neighbours)]
    found = None
    for part in range(parts):
        own = sorted((r.item_id, r.text) for r in wanted.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part).select("item_id", "text").collect())
        words, pairs = ([(r.t, r.n) for r in t.join(t.where(F.col("part") == part).select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()] for t in terms)
        counts = Counts(total.n, total.words, dict(words), {(p.a, p.b): n for p, n in pairs})
        out = _searched(texts, send((own, counts)), settings)
        found = out if found is None else found.unionByName(out)
    return found


def _words(read: Callable[[str], list[str]]) -> Callable[[str], Column]:
    return F.pandas_udf(lambda texts: texts.map(read), "array<string>")


def _searched(texts: DataFrame, held: Broadcast, settings: Settings) -> DataFrame:
    """Documents against the index of one list of items, which every task builds from the broadcast."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = ItemIndex(held.value[0], settings, held.value[1])
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                words = readable(text)
                hit = index.retrieve(words)
                if hit:
                    pairs = set(zip(words, words[1:], strict=False))
                    for k in hit:
                        if not index.reachable(k, pairs):
                            continue
                        share, weighed = carried(index.words[k], words, index.weight)
                        if min(share, weighed) >= settings.coverage:
                            rows += [(doc, i, share) for i in index.ids[k]]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage"])

    return texts.mapInPandas(scan, "doc_id long, item_id long, coverage double")
