"""Listings of the same product put into one group by merging their attributes until nothing changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import dropped, joined, kept, released, salted_join, stored
from .components import RIGHT, connected_components
from .listings import near_names, prepare

#: Two spellings that this many different titles bear each are joined only if their makers or categories agree; fewer titles
#: need not name either.
ATTESTED = 3
#: Where neither can be compared, a slip is borne by this many times fewer titles than the name at least.
RARER = 4


def vertex(side: Column, key: Column) -> Column:
    """Listings of both tables in one number range, table a's below table b's."""
    return F.when(side == "b", key + F.lit(RIGHT)).otherwise(key)


def record_of(v: Column) -> tuple[Column, Column]:
    side = F.when(v >= F.lit(RIGHT >> 1), F.lit("b")).otherwise(F.lit("a"))
    return side, F.when(v >= F.lit(RIGHT >> 1), v - F.lit(RIGHT)).otherwise(v)


def _together(*arrays: str) -> list[Column]:
    return [F.sort_array(F.array_distinct(F.flatten(F.collect_set(a)))).alias(a) for a in arrays]


def clash(a: Column, b: Column) -> Column:
    """Both sides state something and nothing of it agrees."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def stated(read: DataFrame) -> Column:
    """Whether a listing says what it is: a listing without name and model is like no other."""
    return (F.size("names") > 0) | (F.col("model") != "")


def profiles_of(read: DataFrame, *scope: str) -> DataFrame:
    """Listings with equal wording of everything as one profile: smallest vertex ``pid``, ``scope``, model, names, makers, words of the category, number of titles."""
    keys = [*scope, "model", "names", "makers"]
    one = read.where(stated(read)).select(vertex(F.col("side"), F.col("id")).alias("v"), *keys, "squeezed", "kinds")
    titles = one.groupBy(*keys, "squeezed").agg(F.min("v").alias("v"), *_together("kinds"))
    return titles.groupBy(*keys).agg(F.min("v").alias("pid"), F.count(F.lit(1)).alias("titles"), *_together("kinds"))


def identities(first: DataFrame, *scope: str) -> tuple[DataFrame, DataFrame]:
    """Profiles that state the same model (or none) and the same makers (or none) and share a name or model, as one; and ``(first_pid, pid)``.

    Nothing that they state differs, so this needs no test of a contradiction however long the chain.  What is left under
    one name differs in model or makers, so a name that a third of all listings bear leaves few profiles.
    """
    same = [*scope, "model", "makers"]
    attributes = F.concat(F.transform("names", lambda x: F.concat(F.lit("n:"), x)), F.when(F.col("model") != "", F.array(F.concat(F.lit("m:"), "model"))).otherwise(F.array().cast("array<string>")))
    with released(first.sparkSession):
        each = stored(first.select("pid", *same, F.explode(attributes).alias("attribute")))
        least = each.groupBy(*same, "attribute").agg(F.min("pid").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        links = salted_join(each, least.hint("merge"), [*same, "attribute"]).select(F.col("pid").alias("u"), "v").where("u <> v")
        groups = connected_components(links, "u", "v").select(F.col("vertex").alias("pid"), "component")
        track = kept(stored(joined(first.select("pid"), groups, "pid", "left").select(F.col("pid").alias("first_pid"), F.coalesce("component", "pid").alias("pid"))))
    models = F.when(F.col("model") != "", F.array("model")).otherwise(F.array().cast("array<string>"))
    moved = joined(first.withColumnRenamed("pid", "first_pid"), track, "first_pid").withColumn("models", models)
    return moved.groupBy("pid", *scope).agg(*_together("models", "names", "makers", "kinds"), F.sum("titles").alias("titles")), track


def resolve(read: DataFrame) -> DataFrame:
    """``(side, id, group_id)`` for every listing of ``read`` (see ``listings.prepare``); ``group_id`` is common to a product.

    Generic merge resolution.  Equal listings start as one profile, and profiles that state the same facts (version,
    edition, size, colour, pack; a fact left out is a value of its own), the same model and makers, or none, and share
    a name are one.  Then every profile that states less joins the profile which it matches best: one of the same facts
    and name, whose model, makers or category agree, or the only one of that name; and a misspelt name joins the nearest,
    best attested one.  Matched profiles merge: names, models, makers and categories are united.  Merged profiles are
    blocked and matched again until none changes.

    Profiles whose models or makers contradict each other never merge, directly or over a third one: a profile takes in, of
    several that contradict each other, those that agree with the best match, and one that fits several equally well
    stays apart.  A spelling that several titles bear is another product's name, not a slip, unless makers or categories
    agree; this holds however many titles bear it.

    Price and platform do not matter.  A listing without title is in no group; one that states neither name nor model is a
    group of its own.
    """
    first = stored(profiles_of(read, "facts"))
    profiles, track = identities(first, "facts")
    profiles = stored(profiles)
    members = first.select(F.col("pid").alias("first_pid"), "facts", "model", "names", "makers")
    near = stored(near_names(profiles.select("facts", F.explode("names").alias("name")).distinct()))
    while True:
        links = stored(_shared_name_links(profiles))
        if links.isEmpty():
            links = stored(_slip_links(profiles, near))
            if links.isEmpty():
                break
        merges = stored(_accepted(profiles, links))
        into = merges.select(F.col("u").alias("pid"), "v")
        moved = joined(profiles, into, "pid", "left").withColumn("pid", F.coalesce("v", "pid"))
        spent = [profiles, track, links, merges]
        profiles = stored(moved.groupBy("pid", "facts").agg(*_together("models", "names", "makers", "kinds"), F.sum("titles").alias("titles")))
        track = stored(joined(track, into, "pid", "left").select("first_pid", F.coalesce("v", "pid").alias("pid")))
        for table in spent:
            dropped(table)
    ends = stored(joined(members, track.withColumnRenamed("pid", "group_id"), "first_pid").select("facts", "model", "names", "makers", "group_id"))
    grouped = salted_join(read.where(stated(read)).select("side", "id", "facts", "model", "names", "makers"), ends.hint("merge"), ["facts", "model", "names", "makers"])
    alone = read.where(~stated(read)).select("side", "id", vertex(F.col("side"), F.col("id")).alias("group_id"))
    return grouped.select("side", "id", "group_id").unionByName(alone)


def _informed(x: str) -> list[Column]:
    """What makes one profile say more than another, and be the better attested where both say as much."""
    return [F.size(f"{x}.models") > 0, F.size(f"{x}.makers") > 0, F.col(f"{x}.titles"), -F.col(f"{x}.pid")]


_STATE = ("pid", "models", "makers", "kinds", "titles")


def _agree(x: str, y: str) -> Column:
    return ~clash(F.col(f"{x}.models"), F.col(f"{y}.models")) & ~clash(F.col(f"{x}.makers"), F.col(f"{y}.makers"))


def _shared_name_links(profiles: DataFrame) -> DataFrame:
    """``(u, v, rank)``: a profile that says less and the best of those with the same facts and name, or model, that say more.

    Profiles meet over what they agree on - the model; for one without model, makers or category too - so that the many
    models of one line do not meet each other.  Where nothing under a name contradicts the profile
    that says most, the others join it without further evidence.
    """

    def marks(sign: str, words: str) -> Column:
        return F.transform(words, lambda w: F.concat(F.lit(sign), w))

    named = profiles.select("facts", F.explode(F.concat(marks("n:", "names"), marks("m:", "models"))).alias("name"), F.struct(*_STATE).alias("x"))

    model, rest = marks("m:", "x.models"), F.concat(marks("k:", "x.makers"), marks("c:", "x.kinds"))
    less = named.select("facts", "name", "x", F.explode(F.when(F.size("x.models") > 0, model).otherwise(rest)).alias("mark"))
    more = named.select("facts", "name", F.col("x").alias("y"), F.explode(F.concat(model, rest)).alias("mark"))
    weight = F.when(F.col("mark").startswith("m:"), 4).when(F.col("mark").startswith("k:"), 2).otherwise(1)
    agreed = joined(less, more, ["facts", "name", "mark"]).where(F.struct(*_informed("x")) < F.struct(*_informed("y"))).where(_agree("x", "y")).select("x", "y", weight.alias("w"))
    tops = named.groupBy("facts", "name").agg(F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_informed("x"))], F.col("x"))).alias("top"), F.count(F.lit(1)).alias("n"))
    under = joined(named, tops.where("n > 1").select("facts", "name", F.col("top.x").alias("y")), ["facts", "name"])
    only = under.groupBy("facts", "name").agg(F.bool_and(_agree("x", "y")).alias("only")).where("only").select("facts", "name")
    alone = joined(under, only, ["facts", "name"], "left_semi").where("x.pid <> y.pid").select("x", "y", F.lit(1).alias("w"))
    met = agreed.unionByName(alone).groupBy(F.col("x.pid").alias("u"), F.col("y.pid").alias("v")).agg(F.bit_or("w").alias("w"), F.first("y").alias("y"))
    best = met.groupBy("u").agg(F.max("w").alias("w"))
    top = joined(met, best, ["u", "w"]).groupBy("u").agg(F.max_by(F.struct("v", "w"), F.struct(*_informed("y"))).alias("b"), *_together_of("y.models", "y.makers"))
    fits = (F.size("y_models") < 2) & (F.size("y_makers") < 2)
    return top.where(fits).select("u", "b.v", F.col("b.w").cast("long").alias("rank"))


def _together_of(*arrays: str) -> list[Column]:
    return [F.collect_set(F.when(F.size(a) > 0, F.col(a))).alias(a.replace(".", "_")) for a in arrays]


def _slip_links(profiles: DataFrame, near: DataFrame) -> DataFrame:
    """``(u, v, rank)``: each less attested profile and the one whose name it most likely misspells."""
    named = profiles.select("facts", F.explode("names").alias("name"), F.struct(*_STATE).alias("x"))
    one, two = named.select("facts", F.col("name").alias("name_1"), "x"), named.select("facts", F.col("name").alias("name_2"), F.col("x").alias("y"))
    met = joined(joined(near, one, ["facts", "name_1"]), two, ["facts", "name_2"]).where("x.pid <> y.pid").where(_agree("x", "y"))
    fewer, more = F.least("x.titles", "y.titles"), F.greatest("x.titles", "y.titles")
    rare = ((F.size("x.kinds") == 0) | (F.size("y.kinds") == 0)) & (RARER * fewer <= more)
    met = met.where((fewer < ATTESTED) | F.arrays_overlap("x.makers", "y.makers") | F.arrays_overlap("x.kinds", "y.kinds") | rare)
    low = F.struct("x.titles", "y.pid") < F.struct("y.titles", "x.pid")
    pairs = met.select(F.when(low, F.col("x.pid")).otherwise(F.col("y.pid")).alias("u"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("v"), (-F.col("distance")).cast("long").alias("rank"))
    best = pairs.groupBy("u").agg(F.max_by(F.struct("v.pid", "rank"), F.struct("rank", "v.titles", -F.col("v.pid"))).alias("b"))
    return best.select("u", F.col("b.pid").alias("v"), "b.rank")


def _accepted(profiles: DataFrame, links: DataFrame) -> DataFrame:
    """The ``(u, v)`` of ``links`` that may merge at once: v joins nothing itself, and what joins it does not contradict.

    Of profiles that contradict each other those stay that agree with the best match; the others are matched again later.
    """
    roots = joined(links, links.select(F.col("u").alias("v")), "v", "left_anti")
    state = profiles.select("pid", "models", "makers")
    both = joined(roots, state.select(F.col("pid").alias("u"), F.col("models").alias("um"), F.col("makers").alias("uk")), "u")
    both = joined(both, state.select(F.col("pid").alias("v"), F.col("models").alias("vm"), F.col("makers").alias("vk")), "v")
    order = F.struct("rank", -F.col("u"))
    lead = both.groupBy("v").agg(*[F.max_by(F.when(F.size(c) > 0, F.col(c)), F.when(F.size(c) > 0, order)).alias(n) for c, n in (("um", "lm"), ("uk", "lk"))])
    fits = [(F.size(x) == 0) | (F.size(own) > 0) | (F.col(x) == F.col(one)) for x, own, one in (("um", "vm", "lm"), ("uk", "vk", "lk"))]
    # makers that each overlap those of v may still contradict each other
    fits.append((F.size("uk") == 0) | (F.size("vk") < 2) | (F.col("uk") == F.col("lk")))
    return joined(both, lead, "v").where(fits[0] & fits[1] & fits[2]).select("u", "v")


def pairs_within(groups: DataFrame, chunk: int = 512) -> DataFrame:
    """All pairs of listings in a group, ``(side_1, id_1, side_2, id_2)`` with the smaller first.

    A group is cut into chunks of about ``chunk`` members and chunk meets chunk, so no task holds all pairs of a large group.
    """
    sized = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_id", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    each = joined(groups, sized, "group_id").select("group_id", "parts", vertex(F.col("side"), F.col("id")).alias("v"))
    each = each.withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    one = each.select("group_id", "part", F.col("v").alias("v1"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    two = each.select("group_id", F.col("part").alias("other"), F.col("v").alias("v2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = joined(one, two, ["group_id", "part", "other"]).where("v1 < v2")
    (s1, k1), (s2, k2) = record_of(F.col("v1")), record_of(F.col("v2"))
    return met.select(s1.alias("side_1"), k1.alias("id_1"), s2.alias("side_2"), k2.alias("id_2"))


def same_products(tablea: DataFrame, tableb: DataFrame, makers: DataFrame) -> DataFrame:
    """``(side, id, group_id)`` for the listings of two catalogues."""
    return resolve(stored(prepare(tablea, tableb, makers)))
