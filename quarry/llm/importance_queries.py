"""op12: all documents resampled towards the benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import table
from quarry.llm.importance import CAPITALS, Resampling, resample


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def oracle(docs: str = "documents", target: str = "benchmark", r: Resampling = Resampling()) -> str:
    """For runs of one word. The checksum's table by its rule: eight halvings of each byte, with 0xEDB88320 where a bit falls out."""
    halved = "c"
    for _ in range(8):
        halved = f"list_transform({halved}, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    words = f"list_filter(regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    octets = "list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)"
    return f"""
WITH crc AS (SELECT {halved} AS of FROM (SELECT range(0, 256) AS c)),
docs AS (SELECT row_number() OVER () AS id, doc_id, {words} AS ws FROM {docs}),
source AS (SELECT id, unnest(ws) AS word FROM docs),
target AS (SELECT unnest({words}) AS word FROM {target}),
every AS (SELECT DISTINCT word FROM (SELECT word FROM source UNION ALL SELECT word FROM target)),
octets AS (SELECT word, {octets} AS bs FROM (SELECT word, hex(encode(word)) AS h FROM every)),
buckets AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, b: xor(c >> 8, crc.of[(xor(c, b) & 255) + 1])), 4294967295) % {r.buckets} AS bucket FROM octets, crc),
s AS (SELECT bucket, count(*) AS s FROM source JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN buckets USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (SELECT count(*) + {r.buckets} FROM source)::DOUBLE / ((s + 1)::DOUBLE * (SELECT count(*) + {r.buckets} FROM target)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT id, sum(gain)::BIGINT AS weight FROM source JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY id),
scored AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{r.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN weights USING (id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {r.least_words} ORDER BY score DESC, doc_id NULLS FIRST) AS nth FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {r.least_words} AND nth <= (SELECT count(*) * {r.percent} // 100 FROM scored WHERE n_features >= {r.least_words}) THEN nth END AS rank FROM placed"""


QUERIES = {"op12_importance_resampling": op12_importance_resampling}
ORACLES = {"op12_importance_resampling": oracle()}
