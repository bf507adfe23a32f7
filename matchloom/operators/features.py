"""Twenty features of a pair of records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import cosine, jaro_winkler, string_similarities
from ..functions.text import normalize, present_number, present_text, serialize_record
from ..runtime import spread

# Names and order of the features.
FEATURE_NAMES = (
    "jaro_winkler_raw", "jaro_winkler_norm", "token_sort_ratio", "token_set_ratio", "partial_ratio", "levenshtein_norm",
    "trigram_jaccard", "numeric_token_overlap", "length_ratio", "emb_name_cosine", "emb_record_cosine", "price_abs_diff",
    "price_log_ratio", "price_rel_diff", "manufacturer_exact", "manufacturer_jw", "has_price_both",
    "has_manufacturer_both", "high_name_sim_price_mismatch", "disagreeing_fields",
)

#: Turns a list of texts into a list of vectors; called once per batch on the executors.
Encoder = Callable[[list[str]], list[list[float]]]


def hashed_grams(texts: list[str], dim: int = 64) -> list[list[float]]:
    """A small encoder that needs no model: signed counts of hashed character trigrams.  Not a trained sentence encoder."""
    import xxhash

    out = []
    for text in texts:
        v = [0.0] * dim
        t = f"  {text.lower()} "
        for i in range(len(t) - 2):
            h = xxhash.xxh64_intdigest(t[i : i + 3])
            v[h % dim] += 1.0 if h >> 32 & 1 else -1.0
        out.append(v)
    return out


#: Encoders by the name that settings give; others may be added.
ENCODERS: dict[str, Encoder] = {"hashed-trigrams": hashed_grams}


def embed(df: DataFrame, id_col: str, text: Column, out: str, encoder: Encoder = hashed_grams) -> DataFrame:
    """``(id, vector)``: each text encoded once, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], out: [[float(x) for x in v] for v in encoder([t or "" for t in frame["text"]])]})

    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))).mapInPandas(run, f"id long, {out} array<float>")


def precompute_embeddings(df: DataFrame, encoder: Encoder = hashed_grams, title: str = "title", manufacturer: str = "manufacturer", price: str = "price") -> DataFrame:
    """``(id, emb_name, emb_record)`` of every record: its title, and title, manufacturer and price written in one line."""
    record = serialize_record(F.col(title), F.col(manufacturer), F.col(price))
    return embed(df, "id", F.col(title), "emb_name", encoder).join(embed(df, "id", record, "emb_record", encoder), "id")


def price_features(pa: Column, pb: Column) -> dict[str, Column]:
    """Absolute, logarithmic and relative difference, null unless both prices are present."""
    both = present_number(pa) & present_number(pb)
    diff, floor = F.abs(pa - pb), F.lit(1e-6)
    return {
        "price_abs_diff": F.when(both, diff),
        "price_log_ratio": F.when(both, F.abs(F.log(F.greatest(pa, floor) / F.greatest(pb, floor)))),
        "price_rel_diff": F.when(both, diff / F.greatest(pa, pb, floor)),
        "has_price_both": both.cast("double"),
    }


def manufacturer_features(ma: Column, mb: Column, na: Column, nb: Column) -> dict[str, Column]:
    """Equality and Jaro-Winkler of the normalised names ``na``, ``nb``, null unless both are present."""
    both = present_text(ma) & present_text(mb)
    return {
        "manufacturer_exact": F.when(both, (na == nb).cast("double")),
        "manufacturer_jw": F.when(both, jaro_winkler(na, nb)),
        "has_manufacturer_both": both.cast("double"),
    }


def interaction_features() -> dict[str, Column]:
    """Alike names with prices far apart; number of fields that disagree."""
    rel, exact = F.col("price_rel_diff"), F.col("manufacturer_exact")
    return {
        "high_name_sim_price_mismatch": ((F.col("jaro_winkler_norm") > 0.9) & F.coalesce(rel > 0.5, F.lit(False))).cast("double"),
        "disagreeing_fields": F.coalesce(rel > 0.3, F.lit(False)).cast("double") + F.coalesce(exact < 1.0, F.lit(False)).cast("double"),
    }


def prepare_records(df: DataFrame, suffix: str) -> DataFrame:
    """What a pair needs of a record, worked out once per record instead of once per pair.

    A missing title is compared as the word ``nan``, which is how the feature set was defined.
    """
    title = F.coalesce(F.col("title"), F.lit("nan"))
    cols = {"title": title, "title_norm": normalize(title), "mfr": F.col("manufacturer"), "mfr_norm": normalize(F.col("manufacturer")), "price": F.col("price")}
    return df.select(F.col("id").alias(f"id_{suffix}"), *[c.alias(f"{k}_{suffix}") for k, c in cols.items()])


def dangling(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs ``(ltable_id, rtable_id)``, each once, that name a record which its table does not have, or none."""
    left = pairs.join(a.select(F.col("id").alias("ltable_id")), "ltable_id", "left_anti")
    right = pairs.join(b.select(F.col("id").alias("rtable_id")), "rtable_id", "left_anti")
    return left.select("ltable_id", "rtable_id").unionByName(right.select("ltable_id", "rtable_id")).distinct()


def refuse_broken(pairs: DataFrame, a: DataFrame, b: DataFrame) -> None:
    """``KeyError`` if a pair names a record that its table does not have, ``ValueError`` if a table has an id twice."""
    twice = [t.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(s).alias("what"), "id", F.lit(None).cast("long").alias("other")) for s, t in (("a", a), ("b", b))]
    lost = dangling(pairs.select("ltable_id", "rtable_id"), a, b).select(F.lit("pair").alias("what"), F.col("ltable_id").alias("id"), F.col("rtable_id").alias("other"))
    bad = twice[0].unionByName(twice[1]).unionByName(lost).head()
    if bad is not None and bad.what == "pair":
        raise KeyError(f"no such record: {bad.id}, {bad.other}")
    if bad is not None:
        raise ValueError(f"table {bad.what} has the id {bad.id} more than once")


def pair_features(pairs: DataFrame, a: DataFrame, b: DataFrame, emb_a: DataFrame | None = None, emb_b: DataFrame | None = None, check: bool = True) -> DataFrame:
    """``pairs`` with the twenty features; missing values are null.

    Records are joined by id.  Pairs of unknown records are a ``KeyError`` and repeated ids a ``ValueError``; without ``check`` the former
    are dropped and the latter multiply pairs.  Without embeddings the two cosines are null.
    """
    if check:
        refuse_broken(pairs, a, b)
    pairs = spread(pairs)
    both = pairs.join(prepare_records(a, "a"), F.col("ltable_id") == F.col("id_a")).join(prepare_records(b, "b"), F.col("rtable_id") == F.col("id_b"))
    cosines = {"emb_name_cosine": F.lit(None).cast("double"), "emb_record_cosine": F.lit(None).cast("double")}
    if emb_a is not None and emb_b is not None:
        for emb, s in ((emb_a, "a"), (emb_b, "b")):
            both = both.join(emb.select(F.col("id").alias(f"id_{s}"), F.col("emb_name").alias(f"name_{s}"), F.col("emb_record").alias(f"record_{s}")), f"id_{s}", "left")
        cosines = {f"emb_{k}_cosine": F.when(F.col(f"{k}_a").isNotNull() & F.col(f"{k}_b").isNotNull(), cosine(F.col(f"{k}_a"), F.col(f"{k}_b"))) for k in ("name", "record")}
    known = string_similarities(both.withColumns(cosines), "title_a", "title_b", "title_norm_a", "title_norm_b")
    known = known.withColumns(price_features(F.col("price_a"), F.col("price_b")) | manufacturer_features(F.col("mfr_a"), F.col("mfr_b"), F.col("mfr_norm_a"), F.col("mfr_norm_b")))
    return known.withColumns(interaction_features()).select(*[pairs[c] for c in pairs.columns], *FEATURE_NAMES)
