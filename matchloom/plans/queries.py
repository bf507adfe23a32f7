"""The engine's queries on the product tables, each with SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import blocking as B
from ..operators import curves as C
from ..operators import features as X
from ..operators import profile as P
from ..runtime import spread, stored, table
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Cosine from which a pair is a candidate.
THRESHOLD = 0.38


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def both(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tablea").withColumn("side", F.lit("a")).unionByName(table(spark, folder, "tableb").withColumn("side", F.lit("b")))


BOTH = "(select 'a' side, * from tablea union all select 'b', * from tableb)"


def pairs(spark: SparkSession, folder: str, name: str = "train") -> DataFrame:
    """Labelled pairs with both records prepared."""
    t = spread(table(spark, folder, name).select("pair_id", "ltable_id", "rtable_id", "label"))
    a, b = X.prepare_records(table(spark, folder, "tablea"), "a"), X.prepare_records(table(spark, folder, "tableb"), "b")
    return t.join(a, F.col("ltable_id") == F.col("id_a")).join(b, F.col("rtable_id") == F.col("id_b"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    known = pairs(spark, folder).where("label is not null")
    return known.select("pair_id", F.col("label").cast("double").alias("y"), (F.floor(S.trigram_jaccard(F.col("title_norm_a"), F.col("title_norm_b")) * 100 + 1e-9) / 100).alias("s"))


# text


@query(f"select side, id, {Q.normalize('title')} norm from {BOTH}")
def er_normalize(spark, folder):
    return both(spark, folder).select("side", "id", T.normalize(F.col("title")).alias("norm"))


@query(f"select side, id, {Q.present_text('manufacturer')} has_manufacturer, {Q.present_number('price')} has_price from {BOTH}")
def er_missing(spark, folder):
    return both(spark, folder).select("side", "id", T.present_text(F.col("manufacturer")).alias("has_manufacturer"), T.present_number(F.col("price")).alias("has_price"))


@query(
    f"select side, id, (case when {Q.present_text('title')} then title else '' end) || ' | ' || (case when {Q.present_text('manufacturer')} then manufacturer else '' end) || ' | ' || (case when {Q.present_number('price')} then price::varchar else '' end) record from {BOTH}"
)
def er_serialize_record(spark, folder):
    return both(spark, folder).select("side", "id", T.serialize_record(F.col("title"), F.col("manufacturer"), F.col("price")).alias("record"))


# blocking


@query(f"with {Q.TFIDF} select side, id, gram, round(weight, 6) weight from v")
def er_tfidf_weights(spark, folder):
    return B.tfidf(table(spark, folder, "tablea"), table(spark, folder, "tableb")).select("side", "id", "gram", r6("weight").alias("weight"))


@query(f"with {Q.candidates(THRESHOLD)} select ltable_id, rtable_id, round(score, 6) score from k")
def er_block_candidates(spark, folder):
    found = B.generate_candidates(table(spark, folder, "tablea"), table(spark, folder, "tableb"), THRESHOLD)
    return found.select("ltable_id", "rtable_id", r6("score").alias("score"))


@query(f"with {Q.candidates(THRESHOLD)} select (select count(*) from tablea) n_a, (select count(*) from tableb) n_b, count(*) candidates, round(1 - count(*) / ((select count(*) from tablea)::double * (select count(*) from tableb)), 6) reduction from k")
def er_block_stats(spark, folder):
    return B.reduction_at(table(spark, folder, "tablea"), table(spark, folder, "tableb"), THRESHOLD).withColumn("reduction", r6("reduction"))


@query(
    f"""with {Q.candidates(THRESHOLD)}, l as (select distinct ltable_id, rtable_id from (select * from train union all select * from valid union all select * from test) where label = 1)
select count(*) true_pairs, count(k.ltable_id) survived, round(coalesce(count(k.ltable_id) / nullif(count(*), 0)::double, 0), 6) ceiling from l left join k using (ltable_id, rtable_id)"""
)
def er_recall_ceiling(spark, folder):
    labels = table(spark, folder, "train").unionByName(table(spark, folder, "valid")).unionByName(table(spark, folder, "test"))
    vectors = stored(B.tfidf(table(spark, folder, "tablea"), table(spark, folder, "tableb")))
    return B.recall_ceiling_at(vectors, labels, THRESHOLD).withColumn("ceiling", r6("ceiling"))


# similarities of labelled pairs


def _pair_query(name: str, spark_expr: Callable[[Column, Column], Column], sql_expr: str) -> None:
    def f(spark: SparkSession, folder: str) -> DataFrame:
        return pairs(spark, folder).select("pair_id", r6(spark_expr(F.col("title_norm_a"), F.col("title_norm_b"))).alias("value"))

    f.__name__ = f"er_{name}"
    query(f"with {Q.PAIRS} select pair_id, round({sql_expr}, 6) as value from p")(f)


_pair_query("trigram_jaccard", S.trigram_jaccard, Q.jaccard(Q.trigrams("norm_a"), Q.trigrams("norm_b")))
_pair_query("numeric_overlap", S.numeric_token_overlap, Q.jaccard(Q.numbers("norm_a"), Q.numbers("norm_b")))
_pair_query("length_ratio", S.length_ratio, "case when greatest(length(norm_a), length(norm_b)) = 0 then 0.0 else least(length(norm_a), length(norm_b))::double / greatest(length(norm_a), length(norm_b)) end")

# DuckDB's edit functions count bytes, so these two compare the titles with every other character than ASCII as one sign
ASCII = r"[^\x00-\x7F]"


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, ASCII, "?")


_pair_query(
    "levenshtein_norm",
    lambda a, b: S.levenshtein_norm(_plain(a), _plain(b)),
    f"1 - levenshtein(regexp_replace(norm_a, '{ASCII}', '?', 'g'), regexp_replace(norm_b, '{ASCII}', '?', 'g'))::double / greatest(length(norm_a), length(norm_b), 1)",
)


@query(f"with {Q.PAIRS}, q as (select pair_id, regexp_replace(norm_a, '{ASCII}', '?', 'g') x, regexp_replace(norm_b, '{ASCII}', '?', 'g') y from p) select pair_id, round({Q.jaro_winkler('x', 'y')}, 6) as value from q")
def er_jaro_winkler(spark, folder):
    known = pairs(spark, folder).select("pair_id", *[_plain(F.col(f"title_norm_{s}")).alias(s) for s in "ab"])
    return S.string_similarities(known, "a", "b", "a", "b").select("pair_id", r6("jaro_winkler_norm").alias("value"))


@query(
    f"""with {Q.PAIRS}, q as (select pair_id, array_to_string(list_sort({Q.tokens("norm_a")}), ' ') x, array_to_string(list_sort({Q.tokens("norm_b")}), ' ') y from p)
select pair_id, round({Q.indel_ratio("x", "y")}, 6) as value from q"""
)
def er_token_sort_ratio(spark, folder):
    return _strings(spark, folder).select("pair_id", r6("token_sort_ratio").alias("value"))


def _strings(spark: SparkSession, folder: str) -> DataFrame:
    return S.string_similarities(pairs(spark, folder), "title_a", "title_b", "title_norm_a", "title_norm_b")


@query(
    f"""with {Q.PAIRS}, t as (select pair_id, list_distinct({Q.tokens("norm_a")}) ta, list_distinct({Q.tokens("norm_b")}) tb from p),
q as (select pair_id, ta, tb, list_intersect(ta, tb) common, array_to_string(list_sort(list_filter(ta, lambda w: not list_contains(tb, w))), ' ') x, array_to_string(list_sort(list_filter(tb, lambda w: not list_contains(ta, w))), ' ') y from t),
u as (select *, length(array_to_string(list_sort(common), ' ')) s, case when len(common) > 0 then 1 else 0 end g from q),
w as (select *, s + g + length(x) la, s + g + length(y) lb from u),
z as (select *, case when la + lb = 0 then 0.0 else 1 - (length(x) + length(y) - 2.0 * {Q.lcs("x", "y")}) / (la + lb) end c1 from w)
select pair_id, round(case when len(ta) = 0 or len(tb) = 0 then 0.0 when len(common) > 0 and (x = '' or y = '') then 1.0 when s = 0 then c1 else greatest(c1, 1 - (1.0 + length(x)) / (s + la), 1 - (1.0 + length(y)) / (s + lb)) end, 6) as value from z"""
)
def er_token_set_ratio(spark, folder):
    return _strings(spark, folder).select("pair_id", r6("token_set_ratio").alias("value"))


@query(
    f"""with {Q.PAIRS}, d as (select distinct norm_a x, norm_b y from p where norm_a <> '' and norm_b <> ''),
q as (select x, y, case when length(x) <= length(y) then x else y end s, case when length(x) <= length(y) then y else x end l from d),
o as (select x, y, length(s) n, {Q.masks("s", "l")} masks from q union all select x, y, length(l), {Q.masks("l", "s")} from q where length(s) = length(l)),
w as (select x, y, n, unnest(list_transform(generate_series(2 - n, len(masks)), lambda i: list_slice(masks, greatest(i, 1), least(len(masks), n + i - 1)))) own from o),
m as (select x, y, max(2.0 * {Q.lcs_of("n", "own")} / (n + len(own))) v from w group by x, y)
select pair_id, round(coalesce(v, case when norm_a = norm_b then 1.0 else 0.0 end), 6) as value from p left join m on norm_a = x and norm_b = y"""
)
def er_partial_ratio(spark, folder):
    return _strings(spark, folder).select("pair_id", r6("partial_ratio").alias("value"))


@query(f"with {Q.PAIRS}, q as (select pair_id, regexp_replace(title_a, '{ASCII}', '?', 'g') x, regexp_replace(title_b, '{ASCII}', '?', 'g') y from p) select pair_id, round({Q.jaro_winkler('x', 'y')}, 6) as value from q")
def er_jaro_winkler_raw(spark, folder):
    known = pairs(spark, folder).select("pair_id", *[_plain(F.col(f"title_{s}")).alias(s) for s in "ab"])
    return S.string_similarities(known, "a", "b", "a", "b").select("pair_id", r6("jaro_winkler_raw").alias("value"))


@query("select x.vec_id, round(coalesce(list_dot_product(x.embedding::double[], y.embedding::double[]) / nullif(sqrt(list_dot_product(x.embedding::double[], x.embedding::double[])) * sqrt(list_dot_product(y.embedding::double[], y.embedding::double[])), 0), 0), 6) as value from embeddings x join embeddings y on y.vec_id = x.vec_id + 1")
def er_embedding_cosine(spark, folder):
    e = table(spark, folder, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", r6(S.cosine(F.col("embedding"), F.col("other"))).alias("value"))


PRICE = {
    "price_abs_diff": "abs(price_a - price_b)",
    "price_log_ratio": "abs(ln(greatest(price_a, 1e-6) / greatest(price_b, 1e-6)))",
    "price_rel_diff": "abs(price_a - price_b) / greatest(price_a, price_b, 1e-6)",
}
_PRICED = f"({Q.present_number('price_a')} and {Q.present_number('price_b')})"
_MADE = f"({Q.present_text('mfr_a')} and {Q.present_text('mfr_b')})"


@query(f"with {Q.PAIRS} select pair_id, " + ", ".join(f"round(case when {_PRICED} then {e} end, 6) {n}" for n, e in PRICE.items()) + f", {_PRICED}::int::double has_price_both from p")
def er_price_features(spark, folder):
    cols = X.price_features(F.col("price_a"), F.col("price_b"))
    return pairs(spark, folder).select("pair_id", *[r6(c).alias(n) for n, c in cols.items()])


_FOLD = {s: f"regexp_replace({Q.normalize(f'mfr_{s}')}, '{ASCII}', '?', 'g')" for s in "ab"}


@query(
    f"""with {Q.PAIRS}, q as (select pair_id, {_MADE} made, {_FOLD["a"]} x, {_FOLD["b"]} y from p)
select pair_id, case when made then (x = y)::int::double end manufacturer_exact, round(case when made then {Q.jaro_winkler("x", "y")} end, 6) manufacturer_jw, made::int::double has_manufacturer_both from q"""
)
def er_manufacturer_features(spark, folder):
    cols = X.manufacturer_features(F.col("mfr_a"), F.col("mfr_b"), _plain(F.col("mfr_norm_a")), _plain(F.col("mfr_norm_b")))
    return pairs(spark, folder).select("pair_id", *[r6(c).alias(n) for n, c in cols.items()])


@query(
    f"""with {Q.PAIRS}, q as (select pair_id, regexp_replace(norm_a, '{ASCII}', '?', 'g') x, regexp_replace(norm_b, '{ASCII}', '?', 'g') y, case when {_PRICED} then {PRICE["price_rel_diff"]} end rel, case when {_MADE} then ({Q.normalize("mfr_a")} = {Q.normalize("mfr_b")})::int end same from p)
select pair_id, ({Q.jaro_winkler("x", "y")} > 0.9 and coalesce(rel > 0.5, false))::int::double high_name_sim_price_mismatch, coalesce(rel > 0.3, false)::int::double + coalesce(same < 1, false)::int::double disagreeing_fields from q"""
)
def er_interactions(spark, folder):
    known = pairs(spark, folder).withColumns({f"t_{s}": _plain(F.col(f"title_norm_{s}")) for s in "ab"})
    known = S.string_similarities(known, "t_a", "t_b", "t_a", "t_b").withColumns(X.price_features(F.col("price_a"), F.col("price_b")))
    known = known.withColumns(X.manufacturer_features(F.col("mfr_a"), F.col("mfr_b"), F.col("mfr_norm_a"), F.col("mfr_norm_b")))
    return known.withColumns(X.interaction_features()).select("pair_id", "high_name_sim_price_mismatch", "disagreeing_fields")


def _features(spark: SparkSession, folder: str, name: str) -> DataFrame:
    a, b = table(spark, folder, "tablea"), table(spark, folder, "tableb")
    t = table(spark, folder, name).select("pair_id", "ltable_id", "rtable_id", "label")
    return X.pair_features(t, a, b, X.precompute_embeddings(a), X.precompute_embeddings(b))


@query()
def er_pair_features(spark, folder):
    return _features(spark, folder, "train")


_WHOLE = ("price_abs_diff", "price_log_ratio", "price_rel_diff", "manufacturer_exact", "manufacturer_jw")
_FOLDED = "(select id, regexp_replace(title, '{a}', '?', 'g') title, regexp_replace(manufacturer, '{a}', '?', 'g') manufacturer, price from {t})"


@query(
    "with "
    + Q.PAIRS.replace("join tablea a", f"join {_FOLDED.format(a=ASCII, t='tablea')} a").replace("join tableb b", f"join {_FOLDED.format(a=ASCII, t='tableb')} b")
    + f""", q as (select *, {_PRICED} priced, {_MADE} made, {Q.normalize("mfr_a")} fa, {Q.normalize("mfr_b")} fb, list_distinct({Q.tokens("norm_a")}) ta, list_distinct({Q.tokens("norm_b")}) tb,
  array_to_string(list_sort({Q.tokens("norm_a")}), ' ') sa, array_to_string(list_sort({Q.tokens("norm_b")}), ' ') sb from p),
u as (select *, list_intersect(ta, tb) common, array_to_string(list_sort(list_filter(ta, lambda w: not list_contains(tb, w))), ' ') x, array_to_string(list_sort(list_filter(tb, lambda w: not list_contains(ta, w))), ' ') y from q),
w as (select *, length(array_to_string(list_sort(common), ' ')) s, case when len(common) > 0 then 1 else 0 end g from u),
z as (select *, s + g + length(x) la, s + g + length(y) lb from w),
f as (select pair_id, ltable_id, rtable_id, label, {Q.jaro_winkler("title_a", "title_b")} jaro_winkler_raw, {Q.jaro_winkler("norm_a", "norm_b")} jaro_winkler_norm, {Q.indel_ratio("sa", "sb")} token_sort_ratio,
  case when len(ta) = 0 or len(tb) = 0 then 0.0 when len(common) > 0 and (x = '' or y = '') then 1.0 when s = 0 then 1 - (length(x) + length(y) - 2.0 * {Q.lcs("x", "y")}) / (la + lb)
    else greatest(1 - (length(x) + length(y) - 2.0 * {Q.lcs("x", "y")}) / (la + lb), 1 - (1.0 + length(x)) / (s + la), 1 - (1.0 + length(y)) / (s + lb)) end token_set_ratio,
  1 - levenshtein(norm_a, norm_b)::double / greatest(length(norm_a), length(norm_b), 1) levenshtein_norm, {Q.jaccard(Q.trigrams("norm_a"), Q.trigrams("norm_b"))} trigram_jaccard, {Q.jaccard(Q.numbers("norm_a"), Q.numbers("norm_b"))} numeric_token_overlap,
  case when greatest(length(norm_a), length(norm_b)) = 0 then 0.0 else least(length(norm_a), length(norm_b))::double / greatest(length(norm_a), length(norm_b)) end length_ratio,
  """
    + ", ".join(f"case when priced then {e} end {n}" for n, e in PRICE.items())
    + f""", case when made then (fa = fb)::int::double end manufacturer_exact, case when made then {Q.jaro_winkler("fa", "fb")} end manufacturer_jw, priced::int::double has_price_both, made::int::double has_manufacturer_both from z)
select pair_id, ltable_id, rtable_id, label, """
    + ", ".join(f"round({n}, 6) {n}" for n in X.FEATURE_NAMES if not n.startswith("emb_") and n not in ("partial_ratio", "high_name_sim_price_mismatch", "disagreeing_fields"))
    + """, (jaro_winkler_norm > 0.9 and coalesce(price_rel_diff > 0.5, false))::int::double high_name_sim_price_mismatch, coalesce(price_rel_diff > 0.3, false)::int::double + coalesce(manufacturer_exact < 1, false)::int::double disagreeing_fields from f"""
)
def er_feature_row(spark, folder):
    """The feature row without embeddings and best windows, which have queries of their own; DuckDB counts bytes, so other signs than ASCII count as one."""
    a, b = (table(spark, folder, t).withColumns({c: _plain(F.col(c)) for c in ("title", "manufacturer")}) for t in ("tablea", "tableb"))
    t = table(spark, folder, "train").select("pair_id", "ltable_id", "rtable_id", "label")
    names = [n for n in X.FEATURE_NAMES if not n.startswith("emb_") and n != "partial_ratio"]
    return X.pair_features(t, a, b).select("pair_id", "ltable_id", "rtable_id", "label", *[r6(n).alias(n) for n in names])


@query(
    f"""select t.pair_id from (select pair_id, case when label is not null then ltable_id end ltable_id, rtable_id from train) t left join (select id from tablea where {Q.present_text("title")}) a on a.id = t.ltable_id
left join (select id from tableb where {Q.present_text("title")}) b on b.id = t.rtable_id where a.id is null or b.id is null"""
)
def er_dangling_pairs(spark, folder):
    """Training pairs that name a record without title, or - where the label is missing - no left record at all."""
    t = table(spark, folder, "train").select("pair_id", F.when(F.col("label").isNotNull(), F.col("ltable_id")).alias("ltable_id"), "rtable_id")
    a, b = (table(spark, folder, n).where(T.present_text(F.col("title"))).select("id") for n in ("tablea", "tableb"))
    lost = X.dangling(t, a, b)
    return t.join(lost, t["ltable_id"].eqNullSafe(lost["ltable_id"]) & t["rtable_id"].eqNullSafe(lost["rtable_id"]), "left_semi").select("pair_id")


# curves and figures


@query(f"with {Q.SCORED} select count_if(y = 0) n_neg, count_if(y = 1) n_pos, round(count_if(y = 0)::double / nullif(count_if(y = 1), 0), 6) weight from scored")
def er_class_weight(spark, folder):
    return C.class_weight(scored(spark, folder)).withColumn("weight", r6("weight"))


@query(f"with {Q.SCORED} select count_if(y = 0 and s < 0.5) tn, count_if(y = 0 and s >= 0.5) fp, count_if(y = 1 and s < 0.5) fn, count_if(y = 1 and s >= 0.5) tp from scored")
def er_confusion(spark, folder):
    return C.confusion(scored(spark, folder).withColumn("pred", (F.col("s") >= 0.5).cast("int")))


@query(
    f"""with {Q.CUMULATIVE} select s threshold, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) "precision", round(coalesce(tp / nullif(all_pos, 0)::double, 0), 6) recall from cum union all select null, 1.0, 0.0"""
)
def er_pr_curve(spark, folder):
    return C.pr_curve(scored(spark, folder)).select("threshold", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(f"with {Q.CUMULATIVE}, f as (select s, coalesce(2.0 * tp / nullif(tp + fp + all_pos, 0), 0) f1 from cum) select s threshold, round(f1, 6) f1 from f order by f1 desc, s limit 1")
def er_max_f1(spark, folder):
    return C.max_f1(scored(spark, folder)).withColumn("f1", r6("f1"))


_AUC = "sum(pos * (all_neg - fp + neg / 2.0)) / nullif(max(all_pos) * max(all_neg), 0)::double"
_AP = "sum(pos / nullif(all_pos, 0)::double * tp / (tp + fp))"


@query(f"with {Q.CUMULATIVE} select round({_AUC}, 6) auc_roc from cum")
def er_roc_auc(spark, folder):
    return C.roc_auc(scored(spark, folder)).select(r6("auc_roc").alias("auc_roc"))


@query(f"with {Q.CUMULATIVE} select round({_AP}, 6) average_precision from cum")
def er_average_precision(spark, folder):
    return C.average_precision(scored(spark, folder)).select(r6("average_precision").alias("average_precision"))


@query(
    f"""with {Q.CUMULATIVE}, k as (select count_if(y = 1 and s >= 0.5) tp, count_if(y = 0 and s >= 0.5) fp, count_if(y = 1 and s < 0.5) fn, avg((s - y) * (s - y)) brier, count(*) n, sum(y::bigint)::bigint pos from scored)
select 0.5::double threshold, round(tp / (tp + fp)::double, 6) "precision", round(tp / (tp + fn)::double, 6) recall, round(2.0 * tp / (2 * tp + fp + fn), 6) f1, (select round({_AUC}, 6) from cum) auc_roc, (select round({_AP}, 6) from cum) average_precision,
round(brier, 6) brier_score, n n_test, pos n_positive, tp + fp n_predicted_positive from k"""
)
def er_metrics(spark, folder):
    m = C.metrics(scored(spark, folder).select("y", "s"), 0.5)
    return m.select("threshold", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "auc_roc", "average_precision", "brier_score")], "n_test", "n_positive", "n_predicted_positive")


@query(
    f"with {Q.SCORED}, b as (select *, (" + " + ".join(f"(s > {i / 10})::int" for i in range(1, 10)) + ") bin from scored) select bin, round(avg(s), 6) mean_score, round(avg(y), 6) mean_label, count(*) n from b group by bin"
)
def er_reliability(spark, folder):
    return C.reliability(scored(spark, folder)).select("bin", r6("mean_score").alias("mean_score"), r6("mean_label").alias("mean_label"), "n")


@query(
    f"""with {Q.CUMULATIVE}, i as (select s, row_number() over (order by s) k, pos, pos + neg n from bys), c as (select s, k, sum(pos) over (order by k) cp, sum(n) over (order by k) cn, pos, n from i),
m as (select x.k a, y.k b, (y.cp - x.cp + x.pos) / (y.cn - x.cn + x.n)::double mean from c x join c y on y.k >= x.k),
f as (select i.k, m.a, min(m.mean) least from i join m on m.a <= i.k and m.b >= i.k group by i.k, m.a)
select i.s, round(max(f.least), 6) fitted from f join i using (k) group by i.s"""
)
def er_isotonic(spark, folder):
    return C.isotonic(scored(spark, folder)).select("s", r6("fitted").alias("fitted"))


# profiles


@query("select 'a' side, * from (" + " union all ".join(f"select '{c}' as \"column\", count_if({c} is null) nulls, round(count_if({c} is null)::double / count(*), 6) null_rate from tablea" for c in ("title", "manufacturer", "price")) + ")")
def er_null_profile(spark, folder):
    out = P.null_profile(table(spark, folder, "tablea"), ["title", "manufacturer", "price"])
    return out.select(F.lit("a").alias("side"), "column", "nulls", r6("null_rate").alias("null_rate"))


@query("select count(price) as count, round(avg(price), 6) mean, round(stddev_samp(price), 6) std, min(price) min, round(quantile_cont(price, 0.25), 6) q25, round(quantile_cont(price, 0.5), 6) q50, round(quantile_cont(price, 0.75), 6) q75, max(price) max from tablea where not isnan(price)")
def er_describe(spark, folder):
    d = P.describe(table(spark, folder, "tablea"), "price")
    return d.select("count", *[r6(c).alias(c) for c in ("mean", "std")], "min", *[r6(c).alias(c) for c in ("q25", "q50", "q75")], "max")


# The three profiles above and below read table a, as their SQL says; these give the same of table b.


@query("select 'b' side, * from (" + " union all ".join(f"select '{c}' as \"column\", count_if({c} is null) nulls, round(count_if({c} is null)::double / count(*), 6) null_rate from tableb" for c in ("title", "manufacturer", "price")) + ")")
def er_null_profile_b(spark, folder):
    out = P.null_profile(table(spark, folder, "tableb"), ["title", "manufacturer", "price"])
    return out.select(F.lit("b").alias("side"), "column", "nulls", r6("null_rate").alias("null_rate"))


@query("select count(price) as count, round(avg(price), 6) mean, round(stddev_samp(price), 6) std, min(price) min, round(quantile_cont(price, 0.25), 6) q25, round(quantile_cont(price, 0.5), 6) q50, round(quantile_cont(price, 0.75), 6) q75, max(price) max from tableb where not isnan(price)")
def er_describe_b(spark, folder):
    d = P.describe(table(spark, folder, "tableb"), "price")
    return d.select("count", *[r6(c).alias(c) for c in ("mean", "std")], "min", *[r6(c).alias(c) for c in ("q25", "q50", "q75")], "max")


@query(
    """with v as (select least(price, 500.0) v from tableb where price is not null and not isnan(price)), e as (select min(v) lo, (max(v) - min(v)) / 50 w from v), b as (select least(floor((v - lo) / w), 49)::int bin, lo, w from v, e)
select bin, round(lo + bin * w, 6) low, count(*) n, round(count(*) / ((select count(*) from b) * w), 6) density from b group by bin, lo, w"""
)
def er_histogram_b(spark, folder):
    return P.histogram(table(spark, folder, "tableb"), "price", 50, clip=500.0).select("bin", r6("low").alias("low"), "n", r6("density").alias("density"))


@query("select median(length(title)) median_length from tableb")
def er_median_length(spark, folder):
    return P.median_length(table(spark, folder, "tableb"), "title")


@query("select split, count_if(label = 1) positives, count(*) total, round(count_if(label = 1)::double / count(*), 6) share from (select 'train' split, label from train union all select 'valid', label from valid union all select 'test', label from test) group by split")
def er_label_mix(spark, folder):
    return P.label_mix({s: table(spark, folder, s) for s in ("train", "valid", "test")}).withColumn("share", r6("share"))


@query(
    """with v as (select least(price, 500.0) v from tablea where price is not null and not isnan(price)), e as (select min(v) lo, (max(v) - min(v)) / 50 w from v), b as (select least(floor((v - lo) / w), 49)::int bin, lo, w from v, e)
select bin, round(lo + bin * w, 6) low, count(*) n, round(count(*) / ((select count(*) from b) * w), 6) density from b group by bin, lo, w"""
)
def er_histogram(spark, folder):
    return P.histogram(table(spark, folder, "tablea"), "price", 50, clip=500.0).select("bin", r6("low").alias("low"), "n", r6("density").alias("density"))


@query(
    f"""with {Q.SCORED}, e as (select min(s) lo, (max(s) - min(s)) / 40 w from scored), b as (select y, least(floor((s - lo) / w), 39)::int bin, lo, w from scored, e), t as (select y, count(*) n from b group by y)
select y, bin, round(lo + bin * w, 6) low, count(*) n, round(count(*) / (any_value(t.n) * w), 6) density from b join t using (y) group by y, bin, lo, w"""
)
def er_density_by_label(spark, folder):
    return P.histogram(scored(spark, folder), "s", 40, by="y").select("y", "bin", r6("low").alias("low"), "n", r6("density").alias("density"))


@query("select id, price from tablea where price is not null order by price desc, id limit 10")
def er_topk(spark, folder):
    return P.top_k(table(spark, folder, "tablea").where("price is not null").select("id", "price"), F.col("price"), 10, "id")


@query(
    f"""with {Q.SCORED}, d as (select pair_id, s, case when s >= 0.5 and y = 0 then 'fp' when s < 0.5 and y = 1 then 'fn' end kind from scored)
select kind, pair_id, s from (select *, row_number() over (partition by kind order by pair_id) k from d where kind is not null) where k <= 10"""
)
def er_error_samples(spark, folder):
    decided = scored(spark, folder).withColumn("pred", (F.col("s") >= 0.5).cast("int"))
    return P.error_samples(decided, "pair_id").select("kind", "pair_id", "s")


@query("select label, pair_id, ltable_id, rtable_id from (select *, row_number() over (partition by label order by pair_id) k from train where label is not null) where k <= 5")
def er_first_per_class(spark, folder):
    return P.first_per_class(table(spark, folder, "train").where("label is not null").select("label", "pair_id", "ltable_id", "rtable_id"), "label", 5, "pair_id")


@query("select id, title, manufacturer, price from tablea where id in (1, 2, 3, 5, 8, 13)")
def er_look_up(spark, folder):
    return P.look_up(table(spark, folder, "tablea"), "id", 1, 2, 3, 5, 8, 13).select("id", "title", "manufacturer", "price")


def _scored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    known = pairs(spark, folder, name).where("label is not null")
    return known.select("label", (F.floor(S.trigram_jaccard(F.col("title_norm_a"), F.col("title_norm_b")) * 100 + 1e-9) / 100).alias("trigram_jaccard"))


@query(
    "with "
    + ", ".join(
        Q.PAIRS.replace("\np as", f"\np_{s} as").replace("from train t", f"from {s} t") + f", y_{s} as (select label::double y, floor({Q.jaccard(Q.trigrams('norm_a'), Q.trigrams('norm_b'))} * 100 + 1e-9) / 100 s from p_{s} where label is not null)"
        for s in ("valid", "test")
    )
    + """, b as (select s, sum(y::bigint)::bigint pos, count(*) n from y_valid group by s), c as (select s, sum(pos) over (order by s desc) tp, sum(n) over (order by s desc) seen, sum(pos) over () every from b),
best as (select s threshold from c order by coalesce(2.0 * tp / nullif(seen + every, 0), 0) desc, s limit 1),
k as (select count_if(y = 1 and s >= threshold) tp, count_if(y = 0 and s >= threshold) fp, count_if(y = 1 and s < threshold) fn, any_value(threshold) threshold, count(*) n from y_test, best)
select threshold, round(tp / nullif(tp + fp, 0)::double, 6) "precision", round(tp / nullif(tp + fn, 0)::double, 6) recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) f1, n n_test from k"""
)
def er_naive_baseline(spark, folder):
    """One feature as the score: threshold from the validation split, figures on the test split."""
    from ..operators.model import evaluate_naive_baseline

    r = evaluate_naive_baseline(_scored(spark, folder, "test"), _scored(spark, folder, "valid"), "trigram_jaccard")
    return spark.createDataFrame([(float(r["threshold"]), *[round(r[k], 6) for k in ("precision", "recall", "f1")], r["n_test"])], "threshold double, precision double, recall double, f1 double, n_test long")


_MODEL_TEXT = """feature_names=trigram_jaccard length_ratio price_rel_diff

Tree=0
split_feature=0 2
threshold=0.4 0.25
decision_type=2 10
left_child=1 -2
right_child=-1 -3
leaf_value=0.75 -0.5 -0.25

Tree=1
split_feature=1
threshold=0.6
decision_type=2
left_child=-1
right_child=-2
leaf_value=-0.125 0.25

end of trees
"""


@query(
    f"""with {Q.PAIRS}, f as (select pair_id, {Q.jaccard(Q.trigrams("norm_a"), Q.trigrams("norm_b"))} j, case when greatest(length(norm_a), length(norm_b)) = 0 then 0.0 else least(length(norm_a), length(norm_b))::double / greatest(length(norm_a), length(norm_b)) end l,
  case when {_PRICED} then {PRICE["price_rel_diff"]} end d from p)
select pair_id, round(1 / (1 + exp(-((case when j <= 0.4 then case when d is null or d <= 0.25 then -0.5 else -0.25 end else 0.75 end) + (case when l <= 0.6 then -0.125 else 0.25 end)))), 6) probability from f"""
)
def er_model_text(spark, folder):
    """Pairs scored by a model in the text format."""
    from ..operators.trees import parse_trees, probability

    known = pairs(spark, folder).withColumns({"trigram_jaccard": S.trigram_jaccard(F.col("title_norm_a"), F.col("title_norm_b")), "length_ratio": S.length_ratio(F.col("title_norm_a"), F.col("title_norm_b"))} | X.price_features(F.col("price_a"), F.col("price_b")))
    return known.select("pair_id", r6(probability(*parse_trees(_MODEL_TEXT))).alias("probability"))


# model


@query()
def er_gbt_scores(spark, folder):
    """Test pairs with raw and calibrated probability and decision; the trees see training rows, calibration the validation rows."""
    from ..operators.model import calibrate, to_vectors, train_model

    parts = {s: to_vectors(stored(_features(spark, folder, s).where("label is not null"))) for s in ("train", "valid", "test")}
    model = train_model(parts["train"], parts["valid"], rounds=1000, patience=50)
    calibrated, threshold = calibrate(model, parts["valid"])
    out = calibrated.predict_proba(parts["test"])
    return out.select("pair_id", "label", "raw", "probability", (F.col("probability") >= threshold).cast("int").alias("pred"))
