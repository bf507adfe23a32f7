"""SQL fragments that the queries' SQL is put together from."""

from __future__ import annotations

from ..functions.text import STOP_TOKENS

SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{SPACE}+'), lambda t: t <> '')"


def normalize(x: str) -> str:
    stop = ", ".join(f"'{t}'" for t in STOP_TOKENS)
    spaced = rf"regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_\s\x1c-\x1f\x{{85}}\p{{Z}}]', ' ', 'g')"
    parted = rf"regexp_replace(regexp_replace({spaced}, '(\p{{Nd}})([a-zA-Z])', '\1 \2', 'g'), '([a-zA-Z])(\p{{Nd}})', '\1 \2', 'g')"
    return f"array_to_string(list_filter({tokens(parted)}, lambda t: t not in ({stop})), ' ')"


def trigrams(x: str) -> str:
    return f"(case when length({x}) = 0 then []::varchar[] else list_distinct(list_transform(generate_series(1, greatest(length({x}) - 2, 1)), lambda i: substring({x}, i::int, 3))) end)"


def numbers(x: str) -> str:
    return rf"list_distinct(list_filter({tokens(x)}, lambda t: regexp_full_match(t, '\p{{Nd}}+')))"


def jaccard(x: str, y: str) -> str:
    union = f"len(list_distinct(list_concat({x}, {y})))"
    return f"(case when {union} = 0 then 0.0 else len(list_intersect({x}, {y}))::double / {union} end)"


def masks(a: str, b: str) -> str:
    """For every character of ``b`` its places in ``a``, as bits; ``a`` may have up to 120 characters."""
    return f"list_transform(generate_series(1, length({b})), lambda j: list_sum(list_transform(generate_series(1, length({a})), lambda i: case when substring({a}, i::int, 1) = substring({b}, j::int, 1) then 1::hugeint << (i - 1)::int else 0::hugeint end))::hugeint)"


def lcs_of(n: str, places: str) -> str:
    """Longest common subsequence of a text of ``n`` characters and one whose characters stand in it at ``places``."""
    full = f"((1::hugeint << ({n})::int) - 1)"
    return f"({n} - bit_count(list_reduce(list_prepend({full}, {places}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence of texts of up to 120 characters."""
    return f"(case when length({a}) = 0 or length({b}) = 0 then 0 else {lcs_of(f'length({a})', masks(a, b))} end)"


def indel_ratio(a: str, b: str) -> str:
    return f"(case when length({a}) + length({b}) = 0 then 1.0 else 2.0 * {lcs(a, b)} / (length({a}) + length({b})) end)"


def jaro_winkler(a: str, b: str) -> str:
    return f"(case when {a} = '' and {b} = '' then 1.0 else jaro_winkler_similarity({a}, {b}) end)"


def present_text(x: str) -> str:
    return f"({x} is not null and lower(regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')) not in ('', 'nan'))"


def present_number(x: str) -> str:
    return f"({x} is not null and not isnan({x}))"


def word_grams(x: str) -> str:
    return f"flatten(list_transform({tokens(x)}, lambda w: list_transform(generate_series(1, length(w)), lambda i: substring(' ' || w || ' ', i::int, 3))))"


#: Vectors of both tables' titles.
TFIDF = f"""
g as (
  select 'a' side, id, unnest({word_grams(normalize("title"))}) gram from tablea
  union all select 'b', id, unnest({word_grams(normalize("title"))}) from tableb
), c as (select side, id, gram, count(*) tf from g group by all),
n as (select (select count(*) from tablea) + (select count(*) from tableb) n),
d as (select gram, ln((1 + (select n from n)) / (1.0 + count(*))) + 1 idf from c group by gram),
r as (select side, id, gram, tf * idf w from c join d using (gram)),
v as (select side, id, gram, w / sqrt(sum(w * w) over (partition by side, id)) weight from r)"""


def candidates(threshold: float) -> str:
    return f"""{TFIDF}, k as (
  select a.id ltable_id, b.id rtable_id, sum(a.weight * b.weight) score from v a join v b on a.gram = b.gram and a.side = 'a' and b.side = 'b'
  group by all having sum(a.weight * b.weight) >= {threshold} - 1e-9)"""


#: Training pairs with both records and their normalised titles.
PAIRS = f"""
p as (
  select t.pair_id, t.ltable_id, t.rtable_id, t.label, coalesce(a.title, 'nan') title_a, coalesce(b.title, 'nan') title_b, {normalize("coalesce(a.title, 'nan')")} norm_a, {normalize("coalesce(b.title, 'nan')")} norm_b,
    a.manufacturer mfr_a, b.manufacturer mfr_b, a.price price_a, b.price price_b
  from train t join tablea a on a.id = t.ltable_id join tableb b on b.id = t.rtable_id)"""

#: Labels with a score that has ties.
SCORED = f"""{PAIRS}, scored as (select pair_id, label::double y, floor({jaccard(trigrams("norm_a"), trigrams("norm_b"))} * 100 + 1e-9) / 100 s from p where label is not null)"""
CUMULATIVE = f"""{SCORED}, bys as (select s, sum(y::bigint)::bigint pos, sum(1 - y::bigint)::bigint neg from scored group by s),
cum as (select s, pos, neg, sum(pos) over w tp, sum(neg) over w fp, sum(pos) over () all_pos, sum(neg) over () all_neg from bys window w as (order by s desc rows unbounded preceding))"""
