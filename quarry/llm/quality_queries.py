"""op5: the quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import table
from quarry.llm.quality import CAPITALS, FEATURES, PAIRS, N, QualityRules, judge


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle(docs: str = "documents", r: QualityRules = QualityRules()) -> str:
    """The same rules as one statement: statistics by window functions over unnested words, then the concentration steps
    of all starts, unrolled."""
    x = FEATURES
    factor: list[str] = []  # Cholesky: each column may name those before it
    for i in range(N):
        for j in range(i + 1):
            rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            factor.append(f"sqrt(greatest({rest}, 1e-12)) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    solved = ", ".join(f"({x[i]} - m{i}" + "".join(f" - l{i}{j} * y{j}" for j in range(i)) + f") / l{i}{i} AS y{i}" for i in range(N))
    far = " + ".join(f"y{i} * y{i}" for i in range(N))
    moments = ", ".join([f"avg({f}) AS m{i}" for i, f in enumerate(x)] + [f"{{k}} * (avg({x[i]} * {x[j]}) - avg({x[i]}) * avg({x[j]})) + {r.floors[i] ** 2 if i == j else 0} AS c{i}{j}" for i, j in PAIRS])
    det = "round(" + " + ".join(f"ln(l{i}{i})" for i in range(N)) + ", 6) AS det"

    def estimate(source: str, keys: str, consistency: float) -> str:
        return f"SELECT *, {', '.join(factor)}, {det} FROM (SELECT {keys}, {moments.format(k=consistency)} FROM {source} GROUP BY {keys})"

    def half(source: str) -> str:
        return f"""(SELECT *, count(*) OVER (PARTITION BY g, start ORDER BY bin) - count(*) OVER (PARTITION BY g, start, bin) AS before, count(*) OVER (PARTITION BY g, start) AS whole
      FROM (SELECT *, floor({r.bins} * ln(d + 1e-3)) AS bin FROM {source}) QUALIFY 2 * before < whole)"""

    mids = ", ".join(f"quantile_disc({f}, 0.5) AS med{i}" for i, f in enumerate(x))
    spreads = ", ".join(f"quantile_disc(abs({f} - med{i}), 0.5) AS mad{i}" for i, f in enumerate(x))
    plain = " + ".join(f"pow(({f} - med{i}) / {r.floors[i]}, 2)" for i, f in enumerate(x))
    scaled = " + ".join(f"pow(({f} - med{i}) / (mad{i} + {r.floors[i]}), 2)" for i, f in enumerate(x))
    steps = f"""d0 AS (SELECT fit.*, 0 AS start, {plain} AS d FROM fit JOIN med USING (g) UNION ALL SELECT fit.*, 1, {scaled} FROM fit JOIN med USING (g) JOIN mad USING (g)
  UNION ALL SELECT g, {', '.join(x)}, 2, {far} FROM (SELECT fit.*, {solved} FROM fit JOIN everyone USING (g))),
p0 AS ({estimate(half('d0'), 'g, start', r.consistency)}),
"""
    for k in range(1, r.steps):
        steps += f"d{k} AS (SELECT g, {', '.join(x)}, start, {far} AS d FROM (SELECT fit.*, start, {solved} FROM fit JOIN p{k - 1} USING (g))),\np{k} AS ({estimate(half(f'd{k}'), 'g, start', r.consistency)}),\n"
    every = " UNION ALL ".join(f"SELECT *, {k} AS step FROM p{k}" for k in range(r.steps))
    of = lambda g: f"SELECT id, {far} AS d FROM (SELECT id, {solved} FROM stats JOIN best ON g = {g})"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text FROM {docs}),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs),
windows AS (SELECT id, i, list_slice(ws, i, i + {r.window - 1}) AS win FROM split, LATERAL (SELECT unnest(range(1, len(ws) - {r.window - 2})) AS i)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT id, count(DISTINCT i + j) AS n FROM twice, range(0, {r.window}) t(j) GROUP BY id),
counted AS (
  SELECT s.id, doc_id, lang, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, length(text) - length(translate(text, '{CAPITALS}', '')) AS capitals
  FROM split s LEFT JOIN repeats r USING (id)),
stats AS (
  SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed,
         round(ln(greatest(word_chars, 1) / greatest(n_words, 1)) * 10000) / 10000 AS x1, round(ln(1 + n_symbols / greatest(n_words, 1)) * 10000) / 10000 AS x2,
         round(capitals / greatest(word_chars, 1) * 10000) / 10000 AS x3, round(n_repeat_words / greatest(n_words, 1) * 10000) / 10000 AS x4,
         round(n_dup_lines / greatest(n_lines, 1) * 10000) / 10000 AS x5, ['f', lang, source] AS fine, ['c', lang] AS coarse FROM counted),
levels AS (SELECT unnest([fine, coarse, ['a']]) AS g, {', '.join(x)} FROM stats WHERE NOT base_failed),
fit AS (SELECT * FROM levels QUALIFY count(*) OVER (PARTITION BY g) >= {r.min_group} OR g = ['a']),
med AS (SELECT g, {mids} FROM fit GROUP BY g),
mad AS (SELECT g, {spreads} FROM fit JOIN med USING (g) GROUP BY g),
everyone AS ({estimate('fit', 'g', 1.0)}),
{steps}best AS (SELECT * FROM ({every}) QUALIFY row_number() OVER (PARTITION BY g ORDER BY det, start, step) = 1),
near AS ({of('fine')}), wide AS ({of('coarse')}), whole AS ({of("['a']")})
SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed, NOT s.base_failed AND coalesce(near.d, wide.d, whole.d) <= {r.cutoff} AS kept
FROM stats s LEFT JOIN near USING (id) LEFT JOIN wide USING (id) LEFT JOIN whole USING (id)"""


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {"op5_quality_rules": _oracle()}
