"""Queries over element tables: context, classes, tokens, vault."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import patterns as P
from veilspark.operators import classify as C
from veilspark.operators import elements as E
from veilspark.operators import vault as V
from veilspark.plans import derived as D
from veilspark.plans import sqlparts as Q
from veilspark.plans.registry import query
from veilspark.session import materialise

_PAGE = ["page_id"]


def tagged(spark, sf_dir):
    """Elements with their own detection and that of their selector; written
    once, since numbering, substitution and checks all read it."""
    done = V.attach_detection(C.with_detection(D.form_elements(spark, sf_dir)), _PAGE)
    return materialise(done, "tagged")


@query(
    "element_context",
    Q.with_ctes(
        Q.FORM,
        select=f"""SELECT page_id, pos, tag, nullif(type, '') AS type, selector,
        coalesce(nullif(label, ''), nullif(placeholder, ''), nullif(text, '')) AS label,
        nullif(substr(text, 1, {fixed.TEXT_CHARS}), '') AS text, nullif(role, '') AS role, x + y + w + h AS box_sum
        FROM form_elements WHERE visible AND w >= 2 AND h >= 2
        AND (tag IN {Q._in(fixed.INTERACTIVE_TAGS)} OR coalesce(role, '') IN {Q._in(fixed.INTERACTIVE_ROLES)})""",
    ),
)
def element_context(spark, sf_dir):
    ctx = E.interactive_context(D.form_elements(spark, sf_dir), *_PAGE)
    r = F.col("rect")
    return ctx.withColumn("box_sum", (r["x"] + r["y"] + r["width"] + r["height"]).cast("long")).drop("rect")


@query(
    "classify_elements",
    Q.with_ctes(
        Q.FORM,
        Q.CLASSIFIED,
        select="""SELECT page_id, pos, selector, pii_type, confidence, evidence, mode, token_kind, 'dom' AS source, tag
        FROM classified WHERE det0 IS NOT NULL""",
    ),
)
def classify_elements(spark, sf_dir):
    found = C.detections(C.with_detection(D.form_elements(spark, sf_dir)), "page_id")
    return found.drop("box")


@query(
    "scan_stats",
    Q.with_ctes(
        Q.FORM,
        Q.CLASSIFIED,
        select=f"""SELECT page_id, count(*) AS scanned, count(*) FILTER (WHERE shown AND
        (tag IN {Q._in(fixed.INTERACTIVE_TAGS)} OR coalesce(role, '') IN {Q._in(fixed.INTERACTIVE_ROLES)})) AS interactive,
        count(*) FILTER (WHERE det0 IS NOT NULL) AS pii FROM classified GROUP BY page_id""",
    ),
)
def scan_stats(spark, sf_dir):
    return E.scan_stats(C.with_detection(D.form_elements(spark, sf_dir)), "page_id")


def _rule_case(out: int) -> str:
    arms = []
    for p, rx, t, c in fixed.KEYWORD_RULES:
        cond, _ = Q._keyword(rx, "ctx")
        arms.append(f"WHEN {cond} THEN {[p, repr(t), f'CAST({c} AS DOUBLE)'][out]}")
    return "CASE " + " ".join(arms) + " END"


@query(
    "classify_rule_join",
    Q.with_ctes(
        Q.FORM,
        select=f"""SELECT * FROM (SELECT page_id, pos, {_rule_case(0)} AS priority, {_rule_case(1)} AS pii_type,
        {_rule_case(2)} AS confidence FROM (SELECT *, {Q.DETECTOR_CTX} AS ctx FROM form_elements))
        WHERE priority IS NOT NULL""",
    ),
)
def classify_rule_join(spark, sf_dir):
    return C.classify_by_rule_table(D.form_elements(spark, sf_dir), C.rule_table(spark), "page_id")


@query(
    "classify_many_rules",
    Q.with_ctes(
        Q.FORM,
        select=f"""SELECT page_id, pos, coalesce({_rule_case(0)}, part.priority) AS priority,
            coalesce({_rule_case(1)}, 'sensitive') AS pii_type, coalesce({_rule_case(2)}, 0.5) AS confidence
        FROM (SELECT *, {Q.DETECTOR_CTX} AS ctx FROM form_elements) f
        LEFT JOIN (SELECT 100 + p_partkey AS priority, p_partkey FROM part) part ON f.id = 'orderref' AND part.p_partkey = 21
        WHERE {_rule_case(0)} IS NOT NULL OR part.priority IS NOT NULL""",
    ),
)
def classify_many_rules(spark, sf_dir):
    """The keyword rules and one more per part; of these, one speaks of order references."""
    k = F.col("p_partkey")
    word = F.when(k == 21, F.lit(r"order\s+reference")).otherwise(F.concat(F.lit(r"(?:no|serial)\s*ref"), k.cast("string"), F.lit(r"\b|order-"), k.cast("string")))
    more = D.load(spark, sf_dir, "part").select(
        (k + 100).cast("int").alias("priority"), F.concat(F.lit("(?i)"), word).alias("pattern"), F.lit("sensitive").alias("pii_type"), F.lit(0.5).alias("confidence")
    )
    return C.classify_by_rule_table(D.form_elements(spark, sf_dir), C.rule_table(spark).unionByName(more), "page_id")


@query(
    "mode_lookup",
    Q.with_ctes(
        Q.FORM,
        Q.CLASSIFIED,
        select="""SELECT mode, coalesce(token_kind, '-') AS token_kind, count(*) AS n, round(avg(confidence), 6) AS mean_confidence
        FROM classified WHERE det0 IS NOT NULL GROUP BY ALL""",
    ),
)
def mode_lookup(spark, sf_dir):
    found = C.detections(C.with_detection(D.form_elements(spark, sf_dir)), "page_id")
    return found.groupBy("mode", F.coalesce("token_kind", F.lit("-")).alias("token_kind")).agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence")
    )


@query(
    "label_resolution",
    Q.with_ctes(
        Q.FORM,
        f"form_labels AS ({D.FORM_LABELS_SQL})",
        """first_label AS (SELECT page_id, for_id AS id, min_by(trim(text), pos) AS associated
           FROM form_labels GROUP BY ALL)""",
        select="""SELECT page_id, f.pos, coalesce(substr(nullif(associated, ''), 1, 80),
        substr(nullif(trim(CASE WHEN page_id % 4 = 1 THEN ' in ' || label END), ''), 1, 80),
        substr(nullif(aria_label, ''), 1, 80), substr(nullif(placeholder, ''), 1, 80), nullif(name, '')) AS resolved_label
        FROM form_elements f LEFT JOIN first_label USING (page_id, id)""",
    ),
)
def label_resolution(spark, sf_dir):
    elements = D.form_elements(spark, sf_dir)
    fields = elements.select(
        "page_id", "pos", "id", "aria_label", "placeholder", "name",
        F.when(F.col("page_id") % 4 == 1, F.concat(F.lit(" in "), "label")).alias("enclosing_label"),
    )
    done = E.resolve_labels(fields, D.form_labels(elements), "page_id")
    return done.select("page_id", "pos", "resolved_label")


@query(
    "server_field_kind",
    Q.with_ctes(Q.FORM, Q.AUDIT_KINDS, select="SELECT page_id, pos, field_kind, fill FROM audited"),
)
def server_field_kind(spark, sf_dir):
    return C.with_audit_kind(D.form_elements(spark, sf_dir)).select(
        "page_id", "pos", "field_kind", C.fill_value().alias("fill")
    )


@query(
    "tokenize_elements",
    Q.with_ctes(
        Q.FORM, Q.CLASSIFIED, Q.TOKENISED, select="SELECT session_id, step, pos, selector, value FROM sanitised"
    ),
)
def tokenize_elements(spark, sf_dir):
    t = tagged(spark, sf_dir)
    return V.sanitised_elements(t, V.tokens(t)).select("session_id", "step", "pos", "selector", "value")


@query(
    "vault_table",
    Q.with_ctes(
        Q.FORM, Q.CLASSIFIED, Q.TOKENISED,
        select="SELECT session_id, token, kind, seq, sha256(raw_value) AS raw_sha256 FROM vault",
    ),
)
def vault_table(spark, sf_dir):
    rows = V.vault_rows(V.tokens(tagged(spark, sf_dir)))
    return rows.withColumn("raw_sha256", F.sha2("raw_value", 256)).drop("raw_value")


@query(
    "token_counts",
    Q.with_ctes(
        Q.FORM, Q.CLASSIFIED, Q.TOKENISED,
        select=rf"""SELECT session_id, count(*) FILTER (WHERE regexp_matches(value, '{fixed.TOKEN_WHOLE}')) AS tokens,
        count(*) FILTER (WHERE value IS NOT NULL) AS filled, count(*) AS elements FROM sanitised GROUP BY session_id""",
    ),
)
def token_counts(spark, sf_dir):
    t = tagged(spark, sf_dir)
    return V.sanitised_elements(t, V.tokens(t)).groupBy("session_id").agg(
        V.well_formed_token_count(F.col("value")).alias("tokens"),
        F.count("value").alias("filled"),
        F.count("*").alias("elements"),
    )


@query(
    "named_tokens",
    Q.with_ctes(
        Q.FORM, Q.CLASSIFIED, Q.TOKENISED,
        select=rf"""SELECT page_id, len(t) AS tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (
            SELECT page_id, regexp_extract_all(string_agg(coalesce(value, ''), ' ' ORDER BY pos), '{fixed.TOKEN_NAMED}') AS t
            FROM sanitised GROUP BY page_id)""",
    ),
)
def named_tokens(spark, sf_dir):
    """Tokens of the known kinds in the joined values of a page, left to right."""
    t = tagged(spark, sf_dir)
    values = V.sanitised_elements(t, V.tokens(t)).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("value", F.lit("")).alias("value")))).alias("v")
    )
    found = P.named_tokens(F.array_join(F.col("v.value"), " "))
    return values.select("page_id", F.size(found).cast("long").alias("tokens"), F.md5(F.array_join(found, " ")).alias("tokens_md5"))


_REQUESTS_SQL = """requests AS (
    SELECT page_id, session_id, pos,
           CASE (page_id + pos) % 4 WHEN 0 THEN fill WHEN 1 THEN concat(' ', fill, ' ')
                WHEN 2 THEN replace(fill, '_1]', '_2]') ELSE replace(fill, '_1]', '_77]') END AS value
    FROM audited WHERE field_kind IS NOT NULL)"""


def requests(spark, sf_dir):
    """Type requests of the planner, some with other token numbers or blanks."""
    planned = C.with_audit_kind(D.form_elements(spark, sf_dir)).filter(F.col("field_kind").isNotNull())
    fill, turn = F.col("_fill"), (F.col("page_id") + F.col("pos")) % 4
    value = (
        F.when(turn == 0, fill)
        .when(turn == 1, F.concat(F.lit(" "), fill, F.lit(" ")))
        .when(turn == 2, F.replace(fill, F.lit("_1]"), F.lit("_2]")))
        .otherwise(F.replace(fill, F.lit("_1]"), F.lit("_77]")))
    )
    return planned.withColumn("_fill", C.fill_value()).select("page_id", "session_id", "pos", value.alias("value"))


_DEFAULTS = f"defaults AS ({D.default_values_sql()})"


@query(
    "token_resolution",
    Q.with_ctes(
        Q.FORM, Q.CLASSIFIED, Q.TOKENISED, Q.AUDIT_KINDS, _REQUESTS_SQL, _DEFAULTS,
        select=rf"""SELECT r.page_id, r.pos, md5(CASE WHEN NOT tok THEN r.value ELSE coalesce(v.raw_value, d.raw_value,
            (SELECT min_by(k.raw_value, k.ord) FROM defaults k WHERE starts_with(k.token_name, r.base || '_'))) END) AS resolved_md5
        FROM (SELECT *, regexp_matches(trim(value), '{fixed.TOKEN_WHOLE}') AS tok,
                     regexp_replace(trim(value), '[\[\]]', '', 'g') AS name,
                     regexp_replace(regexp_replace(trim(value), '[\[\]]', '', 'g'), '_\d+$', '') AS base FROM requests) r
        LEFT JOIN vault v ON v.session_id = r.session_id AND v.token = trim(r.value)
        LEFT JOIN defaults d ON d.token_name = r.name""",
    ),
)
def token_resolution(spark, sf_dir):
    vault = V.vault_rows(V.tokens(tagged(spark, sf_dir)))
    done = V.resolve_tokens(requests(spark, sf_dir), vault, D.default_values(spark))
    return done.select("page_id", "pos", F.md5("resolved").alias("resolved_md5"))


@query(
    "known_tokens",
    Q.with_ctes(
        Q.FORM, Q.CLASSIFIED, Q.TOKENISED, Q.AUDIT_KINDS, _REQUESTS_SQL, _DEFAULTS,
        select=r"""SELECT page_id, pos, value FROM requests r
        WHERE EXISTS (SELECT 1 FROM vault v WHERE v.session_id = r.session_id AND v.token = r.value)
           OR regexp_replace(r.value, '[\[\]]', '', 'g') IN (SELECT token_name FROM defaults)""",
    ),
)
def known_tokens(spark, sf_dir):
    vault = V.vault_rows(V.tokens(tagged(spark, sf_dir)))
    return V.known_tokens(requests(spark, sf_dir), vault, D.default_values(spark)).select("page_id", "pos", "value")


