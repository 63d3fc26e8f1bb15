"""Query of the secret scan and its check SQL."""

from pyspark.sql import functions as F

from veilspark.llm import secrets
from veilspark.llm.common import table
from veilspark.llm.registry import query


def _sql_rule(rank: int, r: secrets.Rule) -> str:
    pattern = r.pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {str(r.base).lower()} AS base,
           list_sum([length(x) FOR x IN p[:i - 1]])::bigint AS s, list_sum([length(x) FOR x IN p[:i]])::bigint AS e, p[i] AS m
    FROM (SELECT doc_id, p, unnest(generate_series(2, len(p), 2)) AS i
          FROM (SELECT doc_id, regexp_split_to_array(
                  regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), '[\\x01\\x02]') AS p FROM d))
    WHERE length(regexp_extract(p[i], '{pattern}', {r.group})) >= {r.least}"""


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
m AS ({" UNION ALL ".join(_sql_rule(i, r) for i, r in enumerate(secrets.RULES))}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (base) AS b,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS a FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)
"""


@query("op10_secret_scan", SQL)
def op10_secret_scan(spark, sf_dir):
    ledger = secrets.fresh_ledger(spark)
    paths = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"), ledger)
    return secrets.summary(secrets.per_path(paths, ledger)).withColumnRenamed("path", "doc_id")
