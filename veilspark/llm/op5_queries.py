"""Query of benchmark decontamination and its check SQL."""

from pyspark.sql import functions as F

from veilspark.llm import decontaminate as dc
from veilspark.llm.common import sha256_hex, table
from veilspark.llm.registry import query

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d JOIN sizes ON len(w) >= n),
hit AS (SELECT doc_id, item_id, di.n, i FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di) di
        JOIN bw ON bw.n = di.n AND bw.g = di.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op5_decontamination", SQL)
def op5_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = dc.matches(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).select("doc_id", "leak")
    return found.select(
        "doc_id", F.col("leak.n_words").alias("n_words"), dc.n_hit().alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        sha256_hex(F.array_join(F.sort_array("leak.items"), ",")).alias("items_sha256"),
        dc.contaminated().alias("contaminated"),
    )
