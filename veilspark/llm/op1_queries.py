"""Query of the WARC round trip and its check SQL."""

from pyspark.sql import functions as F

from veilspark.llm import warc
from veilspark.llm.common import table
from veilspark.llm.registry import query
from veilspark.session import materialise

SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, h, CASE WHEN strlen(h) >= {warc.LEAST_SHARED} THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS f FROM p)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f < page_id THEN f END AS refers_to
FROM r
"""


def _page(address: str):
    return F.nullif(F.substring(address, len(warc.ADDRESS) + 1, 40), F.lit("")).cast("long")


@query("op1_warc", SQL)
def op1_warc(spark, sf_dir):
    folder = warc.fresh_folder(spark)
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    manifest = warc.write(warc.with_originals(pages, "page_id", "html"), folder)
    records = warc.read(spark, warc.archives(spark, f"{folder}/archives", manifest))
    found = warc.pages_of(materialise(warc.digested(records), "warc-records"))
    return found.select(
        _page("address").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"),
        F.col("type").alias("record_type"), _page("refers_to").alias("refers_to"),
    )
