"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.operators import sessions as T
from veilspark.plans import derived as D
from veilspark.plans import sqlparts as Q
from veilspark.plans.evaluation import _LAT
from veilspark.plans.payloads import _TASK as _MAIL_TASK
from veilspark.plans.planning import _PLAN, plans
from veilspark.plans.registry import query
from veilspark.session import WORK_ROWS, materialise, shared_dir, tasks
from veilspark.streaming import jobs as J
from veilspark.streaming import stateful as S

_PLANTED = "CASE WHEN turn % 3 = 1 THEN concat(text, ' mail user', cast(conv_id AS {s}), '@example.com or 4111 1111 1111 1111 now') ELSE text END"


@query(
    "stream_sanitize",
    f"""WITH p AS (SELECT conv_id, turn, {_PLANTED.format(s='varchar')} AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN length(t) > 0 THEN 'clean' ELSE 'invalid' END AS status,
           CASE WHEN length(t) > 0 THEN md5({Q.redacted('t')}) END AS clean_md5 FROM p""",
)
def stream_sanitize(spark, sf_dir):
    turns = J.table_stream(spark, sf_dir, "conversations")
    planted = turns.select("conv_id", "turn", F.expr(_PLANTED.format(s="string")).alias("text"))
    out = shared_dir(spark, "sanitised")
    J.run_available(J.sanitise(planted, "text", "conv_id", "turn"), J.sanitise_sink(out))
    return spark.read.parquet(out).select("conv_id", "turn", "status", F.md5("clean_text").alias("clean_md5"))


_KINDS = ("USER_EMAIL", "CARD_NUMBER", "USER_OTP", "ADDRESS")


def secrets(events: DataFrame) -> DataFrame:
    """Sensitive values in event order; some rows reset their session, some ask for the value of a token."""
    asks = (F.col("event_id") % 7 == 3) & (F.col("event_type") == "click")
    return events.select(
        "event_id",
        F.col("user_id").alias("session_id"),
        F.expr(f"element_at(array{_KINDS}, cast(event_id % 4 AS int) + 1)").alias("kind"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("raw_value"),
        ((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0)).alias("is_reset"),
        F.when(asks, F.col("event_id") % 9 + 1).alias("asked"),
    )


_SECRETS = """s AS (SELECT event_id, user_id AS session_id, ['USER_EMAIL', 'CARD_NUMBER', 'USER_OTP', 'ADDRESS'][event_id % 4 + 1] AS kind,
    concat('v', event_id) AS raw_value, event_type = 'error' AND event_id % 50 = 0 AS is_reset,
    CASE WHEN event_type = 'click' AND event_id % 7 = 3 THEN event_id % 9 + 1 END AS asked FROM events),
e AS (SELECT *, sum(CASE WHEN is_reset THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_id) AS epoch FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, epoch, kind ORDER BY event_id) AS seq FROM e WHERE NOT is_reset AND asked IS NULL)"""


def _vault_stream(spark, sf_dir) -> DataFrame:
    out = shared_dir(spark, "stream-vault")
    records = secrets(J.table_stream(spark, sf_dir, "events"))
    J.run_available(S.vault_stream(records, ["event_id"], _KINDS), J.batch_sink(out, lambda rows: rows))
    return spark.read.parquet(out)


@query(
    "stream_vault",
    f"WITH {_SECRETS} SELECT event_id, session_id, epoch, concat('[', kind, '_', seq, ']') AS token, md5(raw_value) AS raw_md5 FROM n",
)
def stream_vault(spark, sf_dir):
    rows = _vault_stream(spark, sf_dir).where("NOT is_reset AND asked IS NULL")
    return rows.select("event_id", "session_id", "epoch", "token", F.md5("raw_value").alias("raw_md5"))


@query(
    "stream_reset",
    f"""WITH {_SECRETS}, l AS (SELECT session_id, max(epoch) AS epoch FROM e GROUP BY session_id)
    SELECT session_id, epoch, kind, count(*) AS tokens, max(seq) AS last_seq FROM n JOIN l USING (session_id, epoch) GROUP BY ALL""",
)
def stream_reset(spark, sf_dir):
    live = S.current_vault(_vault_stream(spark, sf_dir))
    return live.groupBy("session_id", "epoch", "kind").agg(F.count("*").alias("tokens"), F.max("seq").alias("last_seq"))


@query(
    "stream_resolve",
    f"""WITH {_SECRETS}
    SELECT a.event_id, a.session_id, concat('[', a.kind, '_', a.asked, ']') AS token, md5(n.raw_value) AS held_md5
    FROM e a LEFT JOIN n ON n.session_id = a.session_id AND n.epoch = a.epoch AND n.kind = a.kind AND n.seq = a.asked AND n.event_id < a.event_id
    WHERE a.asked IS NOT NULL AND NOT a.is_reset""",
)
def stream_resolve(spark, sf_dir):
    """What each asked token stood for when it was asked for."""
    rows = _vault_stream(spark, sf_dir).where("asked IS NOT NULL AND NOT is_reset")
    return rows.select("event_id", "session_id", "token", F.md5("held_value").alias("held_md5"))


@query(
    "stream_cursor",
    Q.with_ctes(
        Q.FORM, Q.AUDIT_KINDS, _PLAN,
        "c AS (SELECT event_id AS call_id, user_id AS session_id, ts, CASE WHEN event_id % 6 = 0 THEN 0 ELSE 1 END AS step FROM events)",
        f"""f AS (SELECT *, CASE WHEN step = 0 OR lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL {fixed.SESSION_IDLE_SECONDS} SECOND
            THEN 1 ELSE 0 END AS fresh FROM c WINDOW w AS (PARTITION BY session_id ORDER BY ts, call_id))""",
        "r AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, call_id) AS run FROM f)",
        "k AS (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY ts, call_id) - 1 AS n FROM r)",
        "sizes AS (SELECT page_id, count(*) AS len FROM plan GROUP BY page_id)",
        select="""SELECT call_id, run, fresh = 1 AS fresh, coalesce(p.action, 'finish') AS action, coalesce(p.selector, '') AS selector, p.value
        FROM k LEFT JOIN sizes z ON z.page_id = k.session_id LEFT JOIN pages g ON g.page_id = k.session_id
        LEFT JOIN plan p ON p.page_id = k.session_id AND p.step = n % len AND (n < len OR has_empty)""",
    ),
)
def stream_cursor(spark, sf_dir):
    calls = J.table_stream(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 6 == 0, 0).otherwise(1).alias("step"),
    )
    pages = materialise(plans(spark, sf_dir), "plans").withColumnRenamed("page_id", "session_id")
    out = shared_dir(spark, "stream-cursor")
    answers = S.cursor_stream(calls.join(pages, "session_id", "left"), "ts", ["ts", "call_id"])
    J.run_available(answers, J.batch_sink(out, lambda rows: rows))
    return spark.read.parquet(out).select("call_id", "run", "fresh", "action", "selector", "value")


_STEP_TASK = f"CASE WHEN page_id % 15 = 0 THEN '' ELSE {_MAIL_TASK} END"
_STEP_VERIFIED = "CASE WHEN page_id % 21 = 0 THEN NULL ELSE page_id % 14 <> 0 END"


@query(
    "stream_step",
    Q.with_ctes(
        Q.FORM, Q.CLASSIFIED, Q.TOKENISED,
        f"""payloads AS (
        SELECT session_id, page_id, step, CAST(to_json({{'task': {_STEP_TASK.format(s='varchar')},
            'dom_elements': list({{'pos': pos, 'tag': tag, 'type': type, 'id': id, 'name': name, 'selector': selector,
                'text': text, 'label': label, 'aria_label': aria_label, 'autocomplete': autocomplete, 'role': role,
                'value': value}} ORDER BY pos), 'step_index': step, 'session_id': concat('s', session_id)}}) AS VARCHAR) AS body
        FROM sanitised GROUP BY session_id, page_id, step)""",
        rf"""shown AS (SELECT page_id, count(*) AS n FROM
            ({Q.findings(r"(SELECT page_id, regexp_replace(body, '" + fixed.TOKEN_BRACKETED + r"', '[]', 'g') AS body FROM payloads)", 'body', 'page_id')})
            GROUP BY page_id),
        raw AS (SELECT p.page_id, count(DISTINCT v.raw_value) AS n
            FROM payloads p JOIN tokenised t ON t.session_id = p.session_id AND t.step <= p.step
            JOIN vault v ON v.session_id = t.session_id AND v.token = t.token
            WHERE length(v.raw_value) >= 4 AND contains(p.body, v.raw_value) GROUP BY p.page_id),
        verdicts AS (SELECT p.*, coalesce(r.n, 0) AS vault_leaks, coalesce(s.n, 0) AS pattern_leaks,
            CASE WHEN NOT coalesce({_STEP_VERIFIED}, false) THEN 'unverified image' WHEN r.n > 0 THEN 'vault leak'
                 WHEN s.n > 0 THEN 'pattern leak' WHEN {_STEP_TASK.format(s='varchar')} = '' THEN 'invalid' ELSE 'sent' END AS status
            FROM payloads p LEFT JOIN shown s USING (page_id) LEFT JOIN raw r USING (page_id))""",
        select="""SELECT page_id, status, vault_leaks, pattern_leaks, CASE WHEN status = 'sent' THEN md5(body) END AS body_md5
        FROM verdicts""",
    ),
)
def stream_step(spark, sf_dir):
    """Every page of a stream as one step: classes, tokens, payload, leak checks, verdict. Blocked steps send nothing."""
    customers = J.table_stream(spark, sf_dir, "customer").select("c_custkey", "c_name")
    # A file of keys is one split, whatever work its rows make; they are dealt out before the classes are found.
    customers = customers.repartition(tasks(D.load(spark, sf_dir, "customer"), WORK_ROWS), "c_custkey")
    elements = D.form_elements(spark, sf_dir, customers).withColumns({
        "task": F.expr(_STEP_TASK.format(s="string")), "verified": F.expr(_STEP_VERIFIED),
    })
    out = shared_dir(spark, "stream-steps")
    J.run_available(J.step_stream(elements), J.step_sink(out))
    steps = spark.read.parquet(f"{out}/steps")
    return steps.select("page_id", "status", "vault_leaks", "pattern_leaks", F.md5("body").alias("body_md5"))


@query(
    "stream_telemetry",
    Q.with_ctes(
        f"tel AS (SELECT *, {_LAT} AS total_ms FROM ({D.TELEMETRY_SQL}))",
        select=f"""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS steps,
        round(sum(total_ms), 3) AS sum_ms, max(total_ms) AS worst_ms,
        count(*) FILTER (WHERE total_ms > {fixed.SLOW_STEP_MS}) AS slow_steps FROM tel GROUP BY ALL""",
    ),
)
def stream_telemetry(spark, sf_dir):
    out = shared_dir(spark, "telemetry")
    steps = D.telemetry(spark, sf_dir, J.table_stream(spark, sf_dir, "events"))
    J.run_available(steps, J.batch_sink(out, J.window_deltas))
    return J.merged_windows(spark.read.parquet(out)).select(
        F.unix_micros("start").alias("start_us"), "event_type", "steps", F.round("sum_ms", 3).alias("sum_ms"),
        "worst_ms", "slow_steps",
    )


@query(
    "stream_sessions",
    f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {fixed.SESSION_IDLE_SECONDS} SECOND THEN 0 ELSE 1 END AS fresh
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS events FROM n GROUP BY user_id, no""",
)
def stream_sessions(spark, sf_dir):
    """All sessions so far, open ones too, from the slots that the stream has written."""
    events = J.table_stream(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = shared_dir(spark, "slots")
    J.run_available(events, J.batch_sink(out, lambda rows: T.activity_slots(rows, "user_id", "ts")))
    rows = T.sessions_of_slots(spark.read.parquet(out), "user_id")
    return rows.select(
        "user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "events"
    )
