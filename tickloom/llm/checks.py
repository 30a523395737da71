"""The parts of operators' results that SQL can state, as queries of their own over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import lm_score, phrase_print, url_filter


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: host, path, rule, and the verdict where a rule decides."""
    return url_filter.op1(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


URL_RULES = r"""
with rests as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), cut as (
  select page_id, regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1) as raw, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from rests
), parts as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from cut
), rules(rule, verdict) as (
  values ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')
), fitting as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as rule_verdict from parts, rules
  where (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, strpos(rule, '/'))) group by page_id
)
select page_id, host, path, rule, rule_verdict from parts left join fitting using (page_id)
"""


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the fold, the counts and the base, for which no model is trained."""
    return lm_score.op2(spark, sf_dir, lm_score.counted).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


LM_BASE = r"""
with steps as (
  select list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)
), fold as (
  select doc_id, text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 1 as held_out from documents, steps
), tokens as (
  select doc_id, held_out, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ')) as token from fold
), counts as (
  select token, count(*)::bigint as c from tokens where not held_out group by token
), total as (
  select sum(c)::bigint as n, count(*)::bigint as v from counts
)
select doc_id, any_value(held_out) as held_out, count(*) as n_tokens, count(c) as n_known, any_value(n) as train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) as base_score
from tokens left join counts using (token), total group by doc_id
"""


def text_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the lengths and the edited texts' digests."""
    return phrase_print.op3(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


TEXT_EDITS = """
with pairs as (
  select doc_id, coalesce(text, '') as text, coalesce(lead(text) over w, first_value(text) over (order by doc_id desc), '') as following from documents window w as (order by doc_id desc)
)
select doc_id, length(text)::bigint as n_chars, sha256(substr(text, 1, (length(text) - length(text) // 3)::bigint) || substr(following, 1, (length(text) // 3)::bigint)) as edited_sha256 from pairs
"""

QUERIES = {"url_rules": url_rules, "lm_base": lm_base, "text_edits": text_edits}
ORACLE_SQL = {"url_rules": URL_RULES, "lm_base": LM_BASE, "text_edits": TEXT_EDITS}
