"""Queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import kept, released, stored, table
from .canonical import typed_makers
from .components import link_groups
from .cosine import overlap_counts, split_overlaps
from .leakage import leaked_items
from .linkage import across, linkage_profiles, matched, matched_groups
from .listings import both_tables, prepare
from .mixing import mixture, reached_shares
from .residue import mined_templates, residue_parts, without_residue
from .resolve import pairs_within, resolve

Query = Callable[[SparkSession, str], DataFrame]


def _evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "valid").withColumn("split", F.lit("valid")).unionByName(table(spark, folder, "test").withColumn("split", F.lit("test")))


def _splits(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    return _evaluation(spark, folder), *(table(spark, folder, n) for n in ("train", "tablea", "tableb"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each valid or test row with each training row on the same two records."""
    return split_overlaps(*_splits(spark, folder)).select(F.least("eval_pair", "train_pair").alias("pair_id_1"), F.greatest("eval_pair", "train_pair").alias("pair_id_2"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each split and source, how many of them overlap with training rows, and with how many."""
    return overlap_counts(*_splits(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Manufacturers typed freely, with the maker that each means or 0."""
    return typed_makers(table(spark, folder, "tablea"), table(spark, folder, "tableb"), table(spark, folder, "makers")).select("side", "id", "maker_id")


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Typed values that mean none of the makers, with the number of listings that bear them."""
    typed = typed_makers(table(spark, folder, "tablea"), table(spark, folder, "tableb"), table(spark, folder, "makers"))
    return typed.where("maker_id = 0").groupBy("value").agg(F.count(F.lit(1)).alias("listings"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records linked by training pairs, with their group's smallest left-hand id."""
    return link_groups(table(spark, folder, "train"))


def _listings(spark: SparkSession, folder: str) -> DataFrame:
    with released(spark):
        return kept(stored(prepare(table(spark, folder, "tablea"), table(spark, folder, "tableb"), table(spark, folder, "makers")), "zstd"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of listings of the same product."""
    return pairs_within(stored(resolve(_listings(spark, folder))))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing with its product group."""
    return resolve(_listings(spark, folder))


def _match(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    with released(spark):
        profiles, members = map(kept, linkage_profiles(_listings(spark, folder), both_tables(table(spark, folder, "tablea"), table(spark, folder, "tableb")), spent=True))
    return matched(profiles, members)


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    return across(*_match(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of an a-listing and a b-listing of the same product."""
    return _matches(spark, folder).select("ltable_id", "rtable_id")


def p5_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with the confidence of each."""
    return _matches(spark, folder)


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing with the group that the matches put it in."""
    _, members, groups = _match(spark, folder)
    return matched_groups(members, groups)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry an evaluation item, whole or in part."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "bench_items")).select("doc_id", "item_id")


def p6_leaked(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation items that leaked, with the number of documents and the largest share carried."""
    found = leaked_items(table(spark, folder, "documents"), table(spark, folder, "bench_items"))
    items = table(spark, folder, "bench_items").select("item_id", "suite")
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("coverage").alias("coverage")).join(items, "item_id")


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the mixture with their size, rate and number of copies."""
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of all tokens that the sources reach."""
    return reached_shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are residue, in whole or in one of their parts."""
    return residue_parts(table(spark, folder, "documents")).select("doc_id").distinct()


def p8_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Wordings of residue with the number of parts that have them."""
    return mined_templates(table(spark, folder, "documents"))


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without residue."""
    return without_residue(table(spark, folder, "documents"))


_ALL = (p1_found, p1_report, p2_found, p2_unmatched, p3_found, p4_found, p4_groups, p5_found, p5_confidence, p5_groups, p6_found, p6_leaked, p7_mixture, p7_shares, p8_found, p8_templates, p8_kept)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

#: Groups by walking the links from every record; SQL has no cheaper way, so it suits small tables only.
SQL: dict[str, str] = {
    "p3_found": """with recursive e as (select distinct ltable_id u, rtable_id + 4611686018427387904 v from train where label = 1 and ltable_id is not null and rtable_id is not null),
s as (select u, v from e union select v, u from e), r as (select u x, u y from s union select r.x, s.v from r join s on r.y = s.u)
select case when x >= 2305843009213693952 then 'b' else 'a' end side, case when x >= 2305843009213693952 then x - 4611686018427387904 else x end id, min(y) group_id from r group by x""",
}
