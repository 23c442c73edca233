"""op11: every source of a language against its other sources and the language, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import table
from quarry.llm.divergence import UNIT, audit
from quarry.llm.importance import CAPITALS


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def oracle(docs: str = "documents", least: int = 10, top: int = 10) -> str:
    share = f"1 + {UNIT}::HUGEINT * ({{n}} + 2) // ({{whole}} + 2 * v)"
    far = "((p - q) * (p - q) // (p + q))"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}') AS text FROM {docs}),
tokens AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT id) >= {least}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS whole FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS whole FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, {share.format(n="coalesce(c.n, 0)", whole="s.whole")} AS p, {share.format(n="k.n", whole="l.whole")} AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
found AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, {far} FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= {top}"""


QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLES = {"op11_source_divergence": oracle()}
