"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs, ~langid.held_out()))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .attribution import sections

    return sections(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import removed

    return removed(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import classes

    return classes(table(spark, sf_dir, "documents"), width=3, percent=90)


#: The rules of the URL query, (verdict, host, path).
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    return assign(table(spark, sf_dir, "documents"), 24)


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .onebit import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_best_fit_packing, op3_url_filter, op4_ngram_jaccard, op5_sharding, op6_nearest_vectors, op7_substring_dedup, op8_quality_rules, op9_token_counts, op10_sentencepiece)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Links by shared shingles, components by reachability.
_JACCARD_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
      else list_transform(range(1, len(words) - 1), lambda p: array_to_string(list_slice(words, p, p + 2), ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
          group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) as component_id
from w left join n using (doc_id) left join reach on reach.a = w.doc_id group by w.doc_id, n.n"""

#: Every window spelled out.
_SUBSTRING_SQL = rf"""
with w as (select doc_id, {_WORDS} as words from documents),
win as (select doc_id, p, array_to_string(list_slice(words, p, p + 49), ' ') as g from (select doc_id, words, unnest(range(1, len(words) - 48)) as p from w where len(words) >= 50)),
f as (select g, min(doc_id) as least from win group by g),
gone as (select distinct doc_id, p + o as k from (select doc_id, p from win join f using (g) where doc_id > least), range(50) t(o)),
each as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as k from w),
kept as (select e.doc_id, string_agg(word, ' ' order by k) as text, count(*) as n from each e anti join gone using (doc_id, k) group by e.doc_id)
select w.doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are tested against brute force."""
    return {"op4_ngram_jaccard": _JACCARD_SQL, "op7_substring_dedup": _SUBSTRING_SQL}
