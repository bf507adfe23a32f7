"""Mapping freely typed values to a list of reference names with a BK-tree over an edit metric."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import parallel, ship
from .listing_text import _INVISIBLE, is_missing, near, plain

# Words around a company's name that are not part of it.
_LEADS = re.compile(r"^(?:\s|[a-z]{2,12}\s?:|made by\b|by\b|from\b|brand\b|mfr\b|mfg\b|manufacturer\b|\(c\)|[:.\-*,/])+")
_TAGS = re.compile(r"\(c\)|\((?:oem|r|tm|imported)\)|\[[^\]]*\]|(?:[-,/]\s*|\s)(?:education|europe|usa|imported|oem)\s*(?=[\W_]|$)|\b(?:consumer division|distribution|retail)\b")
_AROUND = tuple("from made brand corporation limited company distribution education consumer division imported retail europe".split())
_LEGAL = frozenset("inc ltd llc corp corporation co company gmbh ag sa bv limited plc the and".split())
_DOTTED = re.compile(r"\b([a-z])\.([a-z])\.?(?![a-z])")
_GLUED = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_WORD = re.compile(r"[^\W_]+")
_INITIALS = re.compile(r"(?:[A-Z]\.){3,5}|[A-Z]{3,5}")

# Words for a company's line of business, with their short forms.
_TRADES = frozenset("technologies electronics software systems publishing interactive digital media games learning labs peripherals group works".split())
_SHORT = {
    "sftw": "software", "sw": "software", "tech": "technologies", "technology": "technologies", "techs": "technologies", "elec": "electronics", "electronic": "electronics", "soft": "software", "sys": "systems", "system": "systems",
    "pub": "publishing", "publ": "publishing", "int": "interactive", "inter": "interactive", "dig": "digital", "med": "media", "learn": "learning", "lab": "labs", "laboratories": "labs",
    "periph": "peripherals", "per": "peripherals", "grp": "group", "game": "games",
}


class Pattern:
    """A word prepared for Levenshtein distances (a true metric) by bit-parallel columns, one step per letter of the other word."""

    def __init__(self, word: str):
        self.word, self.masks = word, {}
        for i, c in enumerate(word):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def to(self, other: str) -> int:
        size = len(self.word)
        if not size:
            return len(other)
        full, last = (1 << size) - 1, 1 << (size - 1)
        plus, minus, score, masks = full, 0, size, self.masks
        for c in other:
            eq = masks.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | (full & ~(xh | plus)), plus & xh
            if ph & last:
                score += 1
            elif mh & last:
                score -= 1
            ph, mh = (ph << 1 | 1) & full, (mh << 1) & full
            plus, minus = mh | (full & ~(xv | ph)), ph & xv
        return score


def metric(a: str, b: str) -> int:
    return 0 if a == b else Pattern(a).to(b)


class BKTree:
    """Entries arranged by distance to their parent; the triangle inequality rules out whole branches of a search."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.root: list | None = None
        for key, ref in entries:
            self.add(key, ref)

    def add(self, key: str, ref: int) -> None:
        if self.root is None:
            self.root = [key, {ref}, {}]
            return
        node, word = self.root, Pattern(key)
        while True:
            d = word.to(node[0])
            if d == 0:
                node[1].add(ref)
                return
            if d not in node[2]:
                node[2][d] = [key, {ref}, {}]
                return
            node = node[2][d]

    def within(self, key: str, most: int) -> list[tuple[int, str, set[int]]]:
        """All entries at distance ``most`` or less, as (distance, key, references)."""
        found, open_, word = [], [self.root] if self.root else [], Pattern(key)
        while open_:
            name, refs, children = open_.pop()
            d = word.to(name)
            if d <= most:
                found.append((d, name, refs))
            open_ += [child for k, child in children.items() if d - most <= k <= d + most]
        return found


@lru_cache(maxsize=1 << 14)
def trade_word(word: str) -> str | None:
    """The line of business that a word names, one slip of the pen allowed."""
    word = _SHORT.get(word, word)
    if word in _TRADES:
        return word
    return next((x for x in sorted(_TRADES) if near(x, word, 1) < 2), None) if len(word) >= 5 else None


@lru_cache(maxsize=1 << 14)
def around(word: str) -> bool:
    """A misspelt word of those that stand around a name."""
    return len(word) > 3 and any(near(x, word, 1) < 2 for x in _AROUND if len(x) > 4 or x[0] == word[0])


def name_keys(value: str | None) -> tuple[str, str]:
    """``(name, trade)`` of a company name: case, accents, invisible signs, legal forms, tags and word order removed."""
    t = plain(_GLUED.sub(" ", _INVISIBLE.sub("", value or "")))
    t = re.sub("[©®™]|(?<=[a-z.])tm(?![a-z])", " ", t)
    t = re.sub("(?<=[a-z])1|1(?=[a-z])", "l", re.sub("(?<=[a-z])0|0(?=[a-z])", "o", t))
    t = _TAGS.sub(" ", _LEADS.sub("", t))
    t = _DOTTED.sub(r"\1\2", t)
    names, trade = [], []
    for w in _WORD.findall(t):
        if w in _LEGAL or around(w):
            continue
        business = trade_word(w)
        if business:
            trade.append(business)
        else:
            names.append(w)
    name = "".join(names)
    for tail in () if trade else (*sorted(_TRADES), *_SHORT):
        if len(tail) > 3 and name.endswith(tail) and len(name) > len(tail) + 3:
            name, trade = name[: -len(tail)], [trade_word(tail)]
            break
    return name, "".join(sorted(set(trade)))


def initials(name: str) -> str:
    """First letters of a name of three words or more, else ``""``."""
    words = _WORD.findall(plain(name))
    return "".join(w[0] for w in words) if len(words) > 2 else ""


def allowed(key: str) -> int:
    """Edits allowed for a key of this length."""
    return 0 if len(key) < 4 else 1 if len(key) < 6 else 2


class Names:
    """A reference list: a tree over the names without their line of business, which has to agree, and their initials."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = [(ref, name) for ref, name in rows if not is_missing(name)]
        split = [(ref, *name_keys(name)) for ref, name in rows]
        self.trade = {ref: trade for ref, _, trade in split}
        self.tree = BKTree([(name, ref) for ref, name, _ in split if name])
        self.initials: dict[str, set[int]] = {}
        for ref, name in rows:
            if short := initials(name):
                self.initials.setdefault(short, set()).add(ref)
        self.seen: dict[str, list] = {}

    def candidates(self, value: str) -> list[tuple[int, int, int]]:
        """``(distance, how the line of business differs, reference)`` of every entry within the threshold.

        The second figure is 0 for the same line of business, 1 where one side states none, 2 for another.
        """
        if _INITIALS.fullmatch(value.strip()):
            return [(0, 0, ref) for ref in self.initials.get(value.strip().replace(".", "").lower(), ())]
        name, trade = name_keys(value)
        if not name:
            return []
        if name not in self.seen:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            self.seen[name] = self.tree.within(name, allowed(name))
        out = []
        for d, _, refs in self.seen[name]:
            for ref in refs:
                own = self.trade[ref]
                out.append((d, 0 if own == trade else 1 if not trade or not own else 2, ref))
        return out


def best(candidates: list[tuple[int, int, int]]) -> tuple[int, int] | None:
    """The one entry that is meant, as (reference, distance), or None where none or several are.

    A stated line of business has to be the entry's own; where it is left out, only one entry may bear the name.
    """
    fit = sorted(c for c in candidates if c[1] < 2)
    top = [c for c in fit if c[:2] == fit[0][:2]]
    return (top[0][2], top[0][0]) if len({c[2] for c in top}) == 1 else None


#: Names whose search a task keeps for the next value that has them.
SEEN = 50_000
#: Values that one visit to a shard takes.
VALUES = 20_000
#: References held by one tree; a longer list is sharded and every shard answers for itself.
TREE_ENTRIES = 200_000


def map_values(values: DataFrame, reference: DataFrame, value: str, ref_id: str, ref_name: str, tree_entries: int = TREE_ENTRIES) -> DataFrame:
    """``(value, ref_id, distance)`` for every distinct value of ``values`` that is not missing; ``ref_id`` is null if it means no entry.

    The reference list is counted first.  Up to ``tree_entries`` names make one tree that every executor builds from
    a broadcast; a longer list is hashed into shards, each shard's tree returns every entry within the threshold and
    the winner is picked over all shards, so both ways give the same rows.

    Null and blank values and spellings of "no value" give no row; reference entries without a name are never meant;
    two entries equally near leave a value unmapped; empty tables give an empty result or unmapped values.
    """
    ship(values.sparkSession)
    typed = values.select(F.col(value).alias("value")).where("value is not null").distinct()
    # few bytes and much work: partitions must not be put together by size
    typed = typed.repartition(parallel(values.sparkSession), "value")
    names = reference.select(F.col(ref_id).cast("long").alias("ref"), F.col(ref_name).alias("name")).where("ref is not null and name is not null")
    total = names.count()
    if total <= tree_entries:
        held = values.sparkSession.sparkContext.broadcast([(r.ref, r.name) for r in names.collect()])

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = Names(held.value)
            for frame in frames:
                rows = [(v, *(best(known.candidates(v)) or (None, None))) for v in frame["value"] if not is_missing(v)]
                yield pd.DataFrame({"value": [r[0] for r in rows], "ref_id": pd.array([r[1] for r in rows], "Int64"), "distance": pd.array([r[2] for r in rows], "Int32")})

        return typed.mapInPandas(search, "value string, ref_id long, distance int")

    shards = -(-total // tree_entries)

    def shard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = Names(list(zip(right["ref"], right["name"], strict=True)))
        rows = [(v, *c) for v in left["value"] if not is_missing(v) for c in known.candidates(v)]
        return pd.DataFrame(rows, columns=["value", "distance", "apart", "ref"])

    # every value visits every shard, the stated query set against all of the reference; parts keep one visit small
    parts = max(1, -(-typed.count() // VALUES))
    spread = typed.select("value", F.pmod(F.xxhash64("value"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    listed = names.select("ref", "name", F.pmod(F.xxhash64("ref"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    hits = spread.groupBy("part", "shard").cogroup(listed.groupBy("part", "shard")).applyInPandas(shard, "value string, distance int, apart int, ref long")
    w = hits.where("apart < 2").groupBy("value").agg(F.min(F.struct("distance", "apart")).alias("top"), F.collect_set(F.struct(F.struct("distance", "apart").alias("k"), "ref")).alias("all"))
    winner = w.select("value", "top", F.expr("transform(filter(all, x -> x.k = top), x -> x.ref)").alias("refs"))
    winner = winner.where("size(refs) = 1").select("value", F.col("refs")[0].alias("ref_id"), F.col("top.distance").alias("distance"))
    return present(typed, "value").join(winner, "value", "left").select("value", "ref_id", "distance")


def present(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text in ``column`` is not missing."""

    @F.pandas_udf("boolean")
    def stated(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: not is_missing(t)).astype(bool)

    return df.where(stated(F.col(column)))


def typed_makers(tablea: DataFrame, tableb: DataFrame, makers: DataFrame) -> DataFrame:
    """``(side, id, value, maker_id)`` for every record whose manufacturer is stated other than letter for letter as in ``makers``; 0 if it means none of them."""
    typed = tablea.select(F.lit("a").alias("side"), "id", F.col("manufacturer").alias("value")).unionByName(tableb.select(F.lit("b").alias("side"), "id", F.col("manufacturer").alias("value")))
    open_ = typed.where("value is not null").join(makers.select(F.col("name").alias("value")).distinct(), "value", "left_anti")
    mapped = map_values(open_, makers, "value", "maker_id", "name").select("value", "ref_id")
    return open_.join(mapped, "value").select("side", "id", "value", F.coalesce("ref_id", F.lit(0)).alias("maker_id"))
