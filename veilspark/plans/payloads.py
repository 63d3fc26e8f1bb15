"""Queries over outgoing payloads: leak check, audit, contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import patterns as P
from veilspark.operators import flow as W
from veilspark.operators import quality as K
from veilspark.operators import scan as S
from veilspark.operators import vault as V
from veilspark.operators.containment import too_short
from veilspark.plans import derived as D
from veilspark.plans import sqlparts as Q
from veilspark.plans.forms import tagged
from veilspark.plans.registry import query
from veilspark.session import WORK_ROWS, materialise, spread

_TASK = "CASE WHEN page_id % 12 = 0 THEN concat('mail user', cast(page_id AS {s}), '@example.com') ELSE 'Fill the form' END"


def outgoing_elements(spark, sf_dir, raw_every: int = 10) -> tuple[DataFrame, DataFrame]:
    """(elements to send, tokenised rows); every tenth page is sent raw on
    purpose, so that the checks have something to find."""
    t = tagged(spark, sf_dir)
    tokenised = materialise(V.tokens(t), "tokens")  # read for the payloads and for the vault
    clean = V.sanitised_elements(t, tokenised)
    raw = t.select(*clean.columns)
    sent = clean.filter(F.col("page_id") % raw_every != 0).unionByName(raw.filter(F.col("page_id") % raw_every == 0))
    return sent, tokenised


def payloads(sent: DataFrame) -> DataFrame:
    return W.payload_bodies(sent, F.expr(_TASK.format(s="string")))


_SENT = f"""sent AS (
    SELECT session_id, page_id, step, pos, tag, type, id, name, selector, text, label, aria_label, autocomplete, role, value
    FROM sanitised WHERE page_id % 10 <> 0
    UNION ALL
    SELECT session_id, page_id, step, pos, tag, type, id, name, selector, text, label, aria_label, autocomplete, role, value
    FROM tagged WHERE page_id % 10 = 0),
payloads AS (
    SELECT session_id, page_id, step, CAST(to_json({{'task': {_TASK.format(s='varchar')},
        'dom_elements': list({{'pos': pos, 'tag': tag, 'type': type, 'id': id, 'name': name, 'selector': selector,
            'text': text, 'label': label, 'aria_label': aria_label, 'autocomplete': autocomplete, 'role': role,
            'value': value}} ORDER BY pos), 'step_index': step, 'session_id': concat('s', session_id)}}) AS VARCHAR) AS body
    FROM sent GROUP BY session_id, page_id, step)"""

_ALLOWED = "sample.user@example.com"


@query(
    "payload_leaks",
    Q.with_ctes(
        Q.FORM, Q.CLASSIFIED, Q.TOKENISED, _SENT,
        select=rf"""SELECT * FROM (
        SELECT p.page_id, 'raw vault value present' AS reason, min_by(v.token, (t.step, t.pos)) AS what,
               concat(substr(v.raw_value, 1, 2), '***') AS hint, count(*) AS n
        FROM payloads p JOIN tokenised t ON t.session_id = p.session_id AND t.step <= p.step
        JOIN vault v ON v.session_id = t.session_id AND v.token = t.token
        WHERE length(v.raw_value) >= 4 AND contains(p.body, v.raw_value) GROUP BY p.page_id, v.raw_value
        UNION ALL
        SELECT page_id, 'PII pattern in payload', pii_type, concat(substr(value, 1, 3), '***'), 1
        FROM ({Q.findings(r"(SELECT page_id, regexp_replace(body, '" + fixed.TOKEN_BRACKETED + r"', '[]', 'g') AS body FROM payloads)", 'body', 'page_id')})
        WHERE value <> '{_ALLOWED}')""",
    ),
)
def payload_leaks(spark, sf_dir):
    sent, tokenised = outgoing_elements(spark, sf_dir)
    out = materialise(payloads(sent), "payloads")
    vault_leaks = W.vault_leaks(out, tokenised).select(
        "page_id",
        F.lit("raw vault value present").alias("reason"),
        F.col("token").alias("what"),
        P.masked(F.col("raw_value"), 2).alias("hint"),
        F.col("tokens").alias("n"),
    )
    allow = spark.sql(f"SELECT '{_ALLOWED}' AS value")
    pattern = S.pattern_leaks(spread(out, "page_id"), "body", ["page_id"], allow)
    return vault_leaks.unionByName(pattern.select("page_id", "reason", F.col("pii_type").alias("what"), "hint", F.lit(1).cast("long").alias("n")))


_ON_ITS_OWN = r"[^\p{L}\p{N}]"


@query(
    "payload_short_leaks",
    Q.with_ctes(
        Q.FORM, Q.CLASSIFIED, Q.TOKENISED, _SENT.replace("page_id % 10", "page_id % 3"),
        select=rf"""SELECT p.page_id, min_by(v.token, (t.step, t.pos)) AS token, md5(v.raw_value) AS raw_md5, count(*) AS n
        FROM payloads p JOIN tokenised t ON t.session_id = p.session_id AND t.step <= p.step
        JOIN vault v ON v.session_id = t.session_id AND v.token = t.token
        WHERE length(v.raw_value) < 4 AND regexp_matches(p.body, concat('(^|{_ON_ITS_OWN})', v.raw_value, '($|{_ON_ITS_OWN})'))
        GROUP BY p.page_id, v.raw_value""",
    ),
)
def payload_short_leaks(spark, sf_dir):
    """Values of one to three characters, like a card's check number, that a payload shows on their own."""
    sent, tokenised = outgoing_elements(spark, sf_dir, raw_every=3)
    short = tokenised.where(F.length("value") < fixed.MIN_PROTECTED_CHARS)
    found = W.vault_leaks(materialise(payloads(sent), "payloads"), short, least=1)
    return found.select("page_id", "token", F.md5("raw_value").alias("raw_md5"), F.col("tokens").alias("n"))


@query(
    "vault_too_short",
    Q.with_ctes(
        Q.FORM, Q.CLASSIFIED, Q.TOKENISED,
        select="""SELECT session_id, count(*) FILTER (WHERE length(raw_value) < 4) AS too_short, 0 AS too_short_for_one
        FROM vault GROUP BY session_id""",
    ),
)
def vault_too_short(spark, sf_dir):
    """How many values of each session the leak check passes over with its usual least length, and with a least of one."""
    t = tagged(spark, sf_dir)
    vault = materialise(V.vault_rows(V.tokens(t)), "vault-lengths")
    usual, one = (too_short(vault, "raw_value", ["session_id"], n) for n in (fixed.MIN_PROTECTED_CHARS, 1))
    return usual.join(one.withColumnRenamed("too_short", "too_short_for_one"), "session_id")


@query(
    "leak_verdict",
    Q.with_ctes(
        Q.FORM, Q.CLASSIFIED, Q.TOKENISED, _SENT,
        rf"""shown AS (SELECT page_id, count(*) AS n FROM
            ({Q.findings(r"(SELECT page_id, regexp_replace(body, '" + fixed.TOKEN_BRACKETED + r"', '[]', 'g') AS body FROM payloads)", 'body', 'page_id')})
            WHERE value <> '{_ALLOWED}' GROUP BY page_id),
        raw AS (SELECT p.page_id, count(DISTINCT v.raw_value) AS n
            FROM payloads p JOIN tokenised t ON t.session_id = p.session_id AND t.step <= p.step
            JOIN vault v ON v.session_id = t.session_id AND v.token = t.token
            WHERE length(v.raw_value) >= 4 AND contains(p.body, v.raw_value) GROUP BY p.page_id)""",
        select="""SELECT p.page_id, coalesce(s.n, 0) AS pattern_leaks, coalesce(r.n, 0) AS vault_leaks,
            coalesce(s.n, 0) + coalesce(r.n, 0) = 0 AS ok
        FROM payloads p LEFT JOIN shown s USING (page_id) LEFT JOIN raw r USING (page_id)""",
    ),
)
def leak_verdict(spark, sf_dir):
    """Every payload, with its leaks of both kinds; it is fine only without any."""
    found = payload_leaks(spark, sf_dir)
    of_vault = F.col("reason") == "raw vault value present"
    counts = found.groupBy("page_id").agg(
        F.count_if(~of_vault).alias("pattern_leaks"), F.count_if(of_vault).alias("vault_leaks")
    )
    pages = tagged(spark, sf_dir).select("page_id").distinct()
    return pages.join(counts, "page_id", "left").na.fill(0, ["pattern_leaks", "vault_leaks"]).withColumn(
        "ok", F.col("pattern_leaks") + F.col("vault_leaks") == 0
    )


_VIOLATIONS = rf"""element_hits AS (
    SELECT page_id, concat('dom_elements[', coalesce(nullif(selector, ''), tag), '].value') AS place, 'password' AS pii_type, value
    FROM sent WHERE value IS NOT NULL AND NOT regexp_matches(value, '{fixed.TOKEN_WHOLE}') AND lower(coalesce(type, '')) = 'password'
    UNION ALL
    SELECT page_id, place, pii_type, value FROM ({Q.findings(rf'''(SELECT page_id,
        concat('dom_elements[', coalesce(nullif(selector, ''), tag), '].value') AS place, value AS body FROM sent
        WHERE value IS NOT NULL AND NOT regexp_matches(value, '{fixed.TOKEN_WHOLE}'))''', 'body', 'page_id', 'place')})
    UNION ALL
    SELECT page_id, place, pii_type, value FROM ({Q.findings('''(SELECT page_id,
        concat('dom_elements[', coalesce(nullif(selector, ''), tag), '].text') AS place, text AS body FROM sent
        WHERE text IS NOT NULL)''', 'body', 'page_id', 'place')})
    UNION ALL
    SELECT page_id, place, pii_type, value FROM ({Q.findings(f'''(SELECT DISTINCT page_id, 'task' AS place,
        {_TASK.format(s='varchar')} AS body FROM sent)''', 'body', 'page_id', 'place')})),
violations AS (
    SELECT page_id, place AS "where", pii_type, {Q.case_of('pii_type', fixed.AUDIT_REASON)} AS reason,
           {Q.audit_hint('pii_type', 'value')} AS hint FROM element_hits)"""


def audit(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    sent, _ = outgoing_elements(spark, sf_dir)
    tasks = spread(D.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id")), "page_id", rows=WORK_ROWS).select(
        "page_id", F.lit("task").alias("where"), F.expr(_TASK.format(s="string")).alias("task")
    )
    found = S.element_violations(sent, "page_id").unionByName(S.violations(tasks, "task", "where", "page_id"))
    return sent, found


@query(
    "payload_violations",
    Q.with_ctes(Q.FORM, Q.CLASSIFIED, Q.TOKENISED, _SENT, _VIOLATIONS, select="SELECT * FROM violations"),
)
def payload_violations(spark, sf_dir):
    return audit(spark, sf_dir)[1]


@query(
    "payload_compliance",
    Q.with_ctes(
        Q.FORM, Q.CLASSIFIED, Q.TOKENISED, _SENT, _VIOLATIONS,
        select=rf"""SELECT s.page_id, dom_elements, sensitive_fields, tokenized_values, coalesce(n, 0) AS violations,
        coalesce(n, 0) = 0 AS compliant
        FROM (SELECT page_id, count(*) AS dom_elements, count(*) FILTER (WHERE lower(coalesce(type, '')) = 'password'
                  OR coalesce(autocomplete, '') LIKE 'cc-%' OR autocomplete = 'one-time-code') AS sensitive_fields,
                  count(*) FILTER (WHERE regexp_matches(value, '{fixed.TOKEN_WHOLE}')) AS tokenized_values
              FROM sent GROUP BY page_id) s
        LEFT JOIN (SELECT page_id, count(*) AS n FROM violations GROUP BY page_id) v USING (page_id)""",
    ),
)
def payload_compliance(spark, sf_dir):
    sent, found = audit(spark, sf_dir)
    stats = sent.groupBy("page_id").agg(
        F.count("*").alias("dom_elements"),
        F.count_if(K.is_sensitive_field()).alias("sensitive_fields"),
        V.well_formed_token_count(F.col("value")).alias("tokenized_values"),
    )
    return S.compliance(stats, found, ["page_id"])


@query(
    "payload_quality",
    """SELECT conv_id, turn, (length(text) BETWEEN 1 AND 2000 AND turn - 1 >= 0) AS valid,
        length(to_base64(encode(text))) > 128 AS has_screenshot,
        round_even(length(to_base64(encode(text))) / 1024, 1) AS kb
    FROM conversations""",
)
def payload_quality(spark, sf_dir):
    turns = spread(D.load(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    shot = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "")
    return turns.select(
        "conv_id",
        "turn",
        K.payload_is_valid(F.col("text"), F.col("conv_id").cast("string"), F.col("turn") - 1).alias("valid"),
        K.has_screenshot(shot).alias("has_screenshot"),
        K.kilobytes(shot).alias("kb"),
    )


_ACTIONS_SQL = """actions AS (
    SELECT event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'scroll' WHEN 'purchase' THEN 'type'
           WHEN 'signup' THEN 'finish' ELSE 'hover' END AS action,
           CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('#f', event_id % 7) END AS selector,
           CASE WHEN event_id % 5 <> 0 THEN event_type END AS value,
           CASE event_id % 3 WHEN 0 THEN 'down' WHEN 1 THEN 'left' END AS direction,
           CAST(floor(value * 100) AS BIGINT) AS distance, value / 50 AS confidence FROM events)"""


def actions(spark, sf_dir) -> DataFrame:
    e = spread(D.load(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id")
    k = F.col("event_id")
    name = (
        F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "view", "scroll")
        .when(F.col("event_type") == "purchase", "type").when(F.col("event_type") == "signup", "finish").otherwise("hover")
    )
    return e.select(
        "event_id",
        name.alias("action"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("#f"), (k % 7).cast("string"))).alias("selector"),
        F.when(k % 5 != 0, F.col("event_type")).alias("value"),
        F.when(k % 3 == 0, "down").when(k % 3 == 1, "left").alias("direction"),
        F.floor(F.col("value") * 100).alias("distance"),
        (F.col("value") / 50).alias("confidence"),
    )


@query(
    "action_quality",
    Q.with_ctes(
        _ACTIONS_SQL,
        select="""SELECT event_id, c AS client_ok, c AND NOT (action = 'type' AND value IS NULL)
            AND coalesce(direction IN ('up', 'down'), true) AND coalesce(distance BETWEEN 0 AND 10000, true) AS server_ok
        FROM (SELECT *, action IN ('click', 'type', 'scroll', 'finish') AND NOT (action IN ('click', 'type') AND selector = '')
                     AND confidence BETWEEN 0 AND 1 AS c FROM actions)""",
    ),
)
def action_quality(spark, sf_dir):
    return actions(spark, sf_dir).select(
        "event_id", K.action_ok_for_client().alias("client_ok"), K.action_ok_for_server().alias("server_ok")
    )


_RESPONSE = """CASE event_id % 9
    WHEN 0 THEN concat('{{"action":"', act, '","selector":"#f', cast(event_id AS {s}), '","value":"v","confidence":0.5}}')
    WHEN 1 THEN concat('```json\n{{"action":"click","selector":"#', event_type, '"}}\n```')
    WHEN 2 THEN concat('Sure, here it is: {{"action":"type","selector":"#x"}} - done ', event_type)
    WHEN 3 THEN concat('no json at all ', event_type)
    WHEN 4 THEN concat('{{"action":"', event_type, '","selector":null}}')
    WHEN 5 THEN '[1, 2, 3]'
    WHEN 6 THEN ''
    WHEN 7 THEN concat('{{"selector":"#y","value":"', event_type, '","confidence":', cast(event_id % 3 AS {s}), '}}')
    ELSE concat('{{"action":"click","selector":""}} ', event_type) END"""
_ACT = "CASE event_type WHEN 'purchase' THEN 'type' WHEN 'click' THEN 'click' ELSE 'scroll' END"


@query(
    "action_json_repair",
    Q.with_ctes(
        f"""r AS (SELECT event_id, {_RESPONSE.format(s='varchar').replace(chr(10) + '{', chr(10) + '{')} AS response
            FROM (SELECT *, {_ACT} AS act FROM events))""",
        """t AS (SELECT event_id, trim(regexp_replace(trim(response), '(?m)^```(?:json)?|```$', '', 'g'), chr(10) || ' ') AS t FROM r)""",
        r"""p AS (SELECT *, CASE WHEN json_valid(t) THEN CAST(t AS JSON)
                WHEN json_valid(regexp_extract(t, '(?s)\{.*\}')) AND regexp_extract(t, '(?s)\{.*\}') <> ''
                THEN CAST(regexp_extract(t, '(?s)\{.*\}') AS JSON) END AS j FROM t)""",
        """f AS (SELECT *, json_type(j) = 'OBJECT' AS o,
              CASE WHEN json_extract_string(j, '$.action') IN ('click', 'type', 'scroll', 'finish')
                   THEN json_extract_string(j, '$.action') ELSE 'finish' END AS a,
              coalesce(json_extract_string(j, '$.selector'), '') AS s, json_extract_string(j, '$.value') AS v,
              coalesce(TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0.8::DOUBLE) AS c,
              coalesce(json_extract_string(j, '$.reasoning'), '') AS why,
              coalesce(json_type(j, '$.selector'), 'NULL') NOT IN ('VARCHAR', 'NULL') OR coalesce(json_type(j, '$.value'), 'NULL') NOT IN ('VARCHAR', 'NULL')
              OR coalesce(json_type(j, '$.reasoning'), 'NULL') NOT IN ('VARCHAR', 'NULL')
              OR coalesce(json_type(j, '$.confidence'), 'NULL') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT', 'NULL') AS wrong FROM p)""",
        select="""SELECT event_id, CASE WHEN o THEN a END AS action, CASE WHEN o THEN s END AS selector, CASE WHEN o THEN why END AS reasoning,
            CASE WHEN o THEN CASE WHEN a = 'type' AND v IS NULL THEN '' ELSE v END END AS value,
            CASE WHEN t = '' THEN 'empty response' WHEN j IS NULL THEN 'no JSON' WHEN NOT o THEN 'not an object'
                 WHEN wrong THEN 'wrong type'
                 WHEN (a IN ('click', 'type') AND s = '') OR NOT c BETWEEN 0 AND 1 THEN 'invalid action' END AS error
            FROM f""",
    ),
)
def action_json_repair(spark, sf_dir):
    e = spread(D.load(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    responses = e.withColumn("act", F.expr(_ACT)).withColumn("response", F.expr(_RESPONSE.format(s="string")))
    return K.repaired_actions(responses, "response", "event_id").select("event_id", "action", "selector", "value", "reasoning", "error")
