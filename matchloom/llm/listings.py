"""Listings read into facts, in DataFrames: what problems on catalogues share."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import joined, parallel, spread, stored
from .listing_text import category_words, is_missing, near, parse, plain, spelling_forms, squeezed
from .listing_text import _WORD as WORD

FACTS = ("version", "edition", "size", "colour", "pack")
_READ = "side string, id long, squeezed string, facts string, forms string, model string, words array<string>, broken array<string>, kinds array<string>"


def both_tables(tablea: DataFrame, tableb: DataFrame) -> DataFrame:
    """The listings of both tables with ``side`` 'a' or 'b'; other columns are left out."""
    pick = [F.col("id").cast("long").alias("id"), F.col("title").cast("string").alias("title"), F.col("manufacturer").cast("string").alias("manufacturer"), F.col("price").cast("double").alias("price")]
    return tablea.select(F.lit("a").alias("side"), *pick).unionByName(tableb.select(F.lit("b").alias("side"), *pick)).where("id is not null")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for side, key, title in zip(frame["side"], frame["id"], frame["title"], strict=True):
            p = parse(title)
            if p is not None:
                rows.append((side, key, squeezed(title), "|".join(p[f] for f in FACTS), p["forms"], p["model"], p["names"], p["broken"], category_words(title)))
        yield pd.DataFrame(rows, columns=["side", "id", "squeezed", "facts", "forms", "model", "words", "broken", "kinds"])


def read_listings(listings: DataFrame) -> DataFrame:
    """One row per listing with a title: its letters and digits, facts, their wording, model, remaining words and words of its category."""
    return spread(listings.select("side", "id", "title")).mapInPandas(_read, _READ)


def maker_words(listings: DataFrame, makers: DataFrame) -> DataFrame:
    """Words ``(word, maker)`` of makers' names: those of the reference list, and those typed as manufacturer more than once.

    ``maker`` is the word that is meant: for one that is within its slips of a listed or more often typed one, the latter,
    so that a maker spelt in two ways does not contradict itself.
    """

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if is_missing(t) else [w for w in WORD.findall(plain(t)) if len(w) > 2 and not w.isdigit()])

    typed = listings.select("manufacturer").where("manufacturer is not null").groupBy("manufacturer").agg(F.count(F.lit(1)).alias("n"))
    typed = typed.select(F.explode(words("manufacturer")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").select("word", F.lit(False).alias("listed"), "n")
    listed = makers.select(F.explode(words(F.col("name").cast("string"))).alias("word"), F.lit(True).alias("listed"), F.lit(0).cast("long").alias("n"))
    every = stored(typed.unionByName(listed).groupBy("word").agg(F.max("listed").alias("listed"), F.sum("n").alias("n")))
    near_ = stored(near_names(every.select(F.lit("").alias("facts"), F.col("word").alias("name"))))
    both = near_.select(F.col("name_1").alias("word"), F.col("name_2").alias("other"), "distance").unionByName(near_.select(F.col("name_2").alias("word"), F.col("name_1").alias("other"), "distance"))
    known = joined(joined(both, every, "word"), every.select(F.col("word").alias("other"), F.col("listed").alias("l2"), F.col("n").alias("n2")), "other")
    better = known.where(~F.col("listed") & (F.col("l2") | (F.col("n2") > F.col("n"))))
    meant = better.groupBy("word").agg(F.max_by("other", F.struct("l2", -F.col("distance"), "n2", "other")).alias("maker"))
    return joined(every.select("word"), meant, "word", "left").select("word", F.coalesce("maker", "word").alias("maker"))


def with_names(read: DataFrame, words: DataFrame) -> DataFrame:
    """``read`` with ``names`` (what the product line may be called) and ``makers`` (maker's words of the title) for ``words``."""
    each = read.select("side", "id", F.posexplode("words").alias("at", "word"))
    known = joined(each, words, "word", "left")
    parts = known.groupBy("side", "id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("maker").isNull(), F.struct("at", "word")))), lambda x: x["word"]).alias("rest"),
        F.sort_array(F.collect_set("maker")).alias("makers"),
    )

    empty = F.array().cast("array<string>")
    rest = F.coalesce("rest", empty)
    glued = F.when(F.size(rest) > 1, F.transform(F.sequence(F.lit(1), F.size(rest) - 1), lambda i: F.concat(F.get(rest, i - 1), F.get(rest, i)))).otherwise(empty)
    # words of two or three letters are mostly pieces of a broken name, which stands among the joined ones then
    long, paired = F.filter(rest, lambda w: F.length(w) >= 4), F.concat(glued, F.col("broken"))
    alone = F.when((F.size(long) == 0) & (F.size(paired) == 0), rest).otherwise(long)
    return joined(read, stored(parts, "zstd"), ["side", "id"], "left").select(*[c for c in read.columns if c not in ("words", "broken")], F.array_distinct(F.concat(alone, paired)).alias("names"), F.coalesce("makers", empty).alias("makers"))


def prepare(tablea: DataFrame, tableb: DataFrame, makers: DataFrame) -> DataFrame:
    """Both tables read: side, id, squeezed, facts, forms, model, kinds, names, makers; listings without title are left out."""
    listings = both_tables(tablea, tableb)
    # each part is stored, so that no plan holds the exchanges of all: the driver keeps a thread and metrics for each
    return with_names(stored(read_listings(listings), "zstd"), stored(maker_words(listings, makers)))


#: Names of the same facts that are compared in one piece; of more, those meet that share a shortened form.
NAMES_AT_ONCE = 4000


def _cells(name: str, cells: int) -> set[int]:
    return {crc32(form.encode()) % cells for form in spelling_forms(name)} if cells > 1 else {0}


def _near_within(facts: str, names: list[str], cells: int, cell: int) -> list[tuple[str, str, str, int]]:
    """Names within their slips of each other that share a shortened form which belongs to this cell."""
    found, bearers = [], {}
    for name in names:
        met = set()
        for form in spelling_forms(name):
            if cells < 2 or crc32(form.encode()) % cells == cell:
                same = bearers.setdefault(form, [])
                met.update(same)
                same.append(name)
        for other in met:
            least = min(len(name), len(other))
            if (d := near(name, other, 2)) <= (1 if least < 7 else 2):
                found.append((facts, *sorted((name, other)), d))
    return found


def near_names(names: DataFrame, at_once: int = NAMES_AT_ONCE) -> DataFrame:
    """``(facts, name_1, name_2, distance)`` with name_1 < name_2: names within their slips of each other, under the same facts.

    ``names(facts, name)`` holds every name once, so repeated listings do not multiply, and should be cheap to read twice.
    The names of the same facts go to one place, where they meet if they share a shortened form and the distance is then
    worked out exactly; more than ``at_once`` are dealt into cells by those forms.  So names are moved, not their forms, of
    which there are fifty times as many.
    """
    dealt_to = F.ceil(F.col("n") / at_once).cast("int").alias("cells")
    many = names.groupBy("facts").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > at_once).select("facts", dealt_to)
    sized = names.select("facts", "name").join(F.broadcast(many), "facts", "left").select("facts", "name", F.coalesce("cells", F.lit(1)).alias("cells"))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 2000):
                part = frame.iloc[at : at + 2000]
                rows = [(f, n, c, cell) for f, n, c in zip(part["facts"], part["name"], part["cells"], strict=True) for cell in _cells(n, c)]
                yield pd.DataFrame(rows, columns=["facts", "name", "cells", "cell"])

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, at, held = ["facts", "name_1", "name_2", "distance"], None, []
        for frame in frames:
            rows = []
            for f, n, c, cell in zip(frame["facts"], frame["name"], frame["cells"], frame["cell"], strict=True):
                if at != (f, c, cell):
                    rows += _near_within(at[0], held, *at[1:]) if at else []
                    at, held = (f, c, cell), []
                held.append(n)
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame(_near_within(at[0], held, *at[1:]) if at else [], columns=columns)

    # the names are few bytes and much work, so their partitions must not be put together by size
    dealt = sized.mapInPandas(deal, "facts string, name string, cells int, cell int").repartition(parallel(names.sparkSession), "facts", "cell")
    met = dealt.sortWithinPartitions("facts", "cell").mapInPandas(compare, "facts string, name_1 string, name_2 string, distance int")
    return met.distinct()
