"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from termweave.llm.html import op6_html
from termweave.llm.licenses import op8_licenses
from termweave.llm.mixing import op5_mixing
from termweave.llm.neardup import op3_neardup
from termweave.llm.packing import op2_packing
from termweave.llm.quality import op1_quality
from termweave.llm.suffixes import op7_suffixes
from termweave.llm.toxicity import op9_toxicity
from termweave.llm.urls import GLOBS, RULES, op4_urls
from termweave.llm.vectors import op10_vectors

QUERIES = {f.__name__: f for f in (op1_quality, op2_packing, op3_neardup, op4_urls, op5_mixing, op6_html, op7_suffixes, op8_licenses, op9_toxicity, op10_vectors)}


def _rule_case(result: str) -> str:
    out = []
    for rule, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash + rest}')"
        out.append(f"WHEN {fits} THEN '{rule if result == 'rule' else verdict}'")
    return "CASE " + " ".join(out) + " END"


_GLOB_CASE = "CASE " + " ".join(f"WHEN canonical GLOB '{g}' THEN '{g}'" for g in GLOBS) + " END"

ORACLE_SQL = {
    "op4_urls": rf"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^?#]*(\?[^#]*)', 1), '') AS query
  FROM pages),
canonical AS (
  SELECT page_id, host, path, lower(regexp_replace(host, '\.?(:80|:443)?$', '') || path || query) AS canonical FROM parts),
judged AS (
  SELECT page_id, host, path, {_rule_case("rule")} AS rule, {_rule_case("verdict")} AS ruled, {_GLOB_CASE} AS pattern FROM canonical)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern FROM judged
"""
}
