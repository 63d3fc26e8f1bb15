"""Query of the licence scan and its check SQL."""

from veilspark.llm import license_scan
from veilspark.llm.common import table
from veilspark.llm.registry import query


def _sql_canon(text: str, keep: str) -> str:
    """The canonical form as a DuckDB expression."""
    out = f"regexp_replace(lower({text}), '(?m)^[^\\p{{L}}\\p{{N}}\\n]*(?:copyright|\\(c\\)|©|all rights reserved)[^\\n]*$', '', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}{keep}]+', ' ', 'g')"
    return out


def _sql_same(out: str) -> str:
    for spelling, word in license_scan.SAME_WORD:
        out = f"regexp_replace({out}, '\\b{spelling}\\b', '{word}', 'g')"
    return out


_KNOWN = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in license_scan.KNOWN)
_WORDS = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
SQL = f"""
WITH known AS (SELECT DISTINCT license_id, sha256({_sql_same(_WORDS.format(_sql_canon('text', '')))}) AS digest
               FROM (VALUES {_KNOWN}) AS v(license_id, text)),
canon AS (SELECT doc_id, {_sql_canon("coalesce(text, '')", '\\n')} AS c FROM documents),
whole AS (SELECT doc_id, c, {_WORDS.format('c')} AS w FROM canon),
units AS (SELECT DISTINCT doc_id, unnest([w] || [trim(x) FOR x IN string_split(c, chr(10))]
              || [{_WORDS.format('x')} FOR x IN regexp_split_to_array(c, '\\n[ \\n]*\\n')]) AS unit FROM whole),
same AS (SELECT DISTINCT doc_id, sha256({_sql_same('unit')}) AS digest FROM units WHERE unit <> ''),
d AS (SELECT doc_id, sha256({_sql_same('w')}) AS text_digest FROM whole)
SELECT doc_id, text_digest, min(license_id) FILTER (digest = text_digest) AS whole_license,
       coalesce(string_agg(DISTINCT license_id, ',' ORDER BY license_id), '') AS licenses, count(license_id) AS n_matches
FROM d LEFT JOIN (same JOIN known USING (digest)) USING (doc_id) GROUP BY doc_id, text_digest
"""


@query("op2_license_scan", SQL)
def op2_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"), license_scan.known_digests(spark)).withColumnRenamed("id", "doc_id")
