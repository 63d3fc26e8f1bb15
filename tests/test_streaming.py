import datetime

import pytest
from pyspark.sql import functions as F
from veilspark.session import shared_dir
from veilspark.sources import html as H
from veilspark.streaming import jobs as J
from veilspark.streaming import stateful as S


class Feed:
    """A folder that gets one file after the other, and a stream that takes one file to a micro-batch."""

    def __init__(self, spark, ddl):
        self.spark, self.ddl, self.path, self.progress, self.out = spark, ddl, *(shared_dir(spark, x) for x in ("feed", "progress", "out"))

    def add(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.ddl).coalesce(1).write.mode("append").parquet(self.path)
        return self

    def run(self, build, sink=None):
        stream = self.spark.readStream.schema(self.ddl).option("maxFilesPerTrigger", 1).parquet(self.path)
        J.run_available(build(stream), sink or J.batch_sink(self.out, lambda rows: rows), progress=self.progress)
        return self.spark.read.parquet(self.out)


def test_blocked_records_keep_no_text(spark):
    feed = Feed(spark, "session string, step int, text string").add(
        [("s", 0, "mail a@b.co"), ("s", -1, "mail a@b.co"), (None, 7, "no session")],
        [("s", 1, ""), ("s", 2, "x" * 2001), ("s", 3, "fine"), ("s", None, "no step"), ("s", 4, None)],
    )
    rows = feed.run(lambda s: J.sanitise(s, "text", "session", "step"), J.sanitise_sink(feed.out)).collect()
    assert {(r.step, r.clean_text) for r in rows if r.status == "clean"} == {(0, "mail [USER_EMAIL]"), (2, "x" * 2001), (3, "fine")}
    assert sorted((str(r.step), r.status, r.clean_text) for r in rows if r.status != "clean") == [
        ("-1", "invalid", None), ("1", "invalid", None), ("4", "invalid", None), ("7", "invalid", None), ("None", "invalid", None)]


# ---------------------------------------------------------------------------
KINDS = ("ADDRESS", "CVV")
RECORDS = "event_id bigint, session_id string, kind string, raw_value string, is_reset boolean, asked bigint"


def _records(ids):
    return [(i, None if i % 7 == 5 else "hot" if i % 3 else f"s{i % 5}", "ADDRESS" if i % 2 else "CVV", f"v{i}", i in (40, 41, 90),
             i % 4 + 1 if i % 11 == 6 else None) for i in ids]


def _numbered(batches):
    """What the vault stream should give, from rows in order of arrival."""
    epoch, held, want = {}, {}, {}
    for batch in batches:
        for i, s, kind, value, reset, asked in sorted(batch):
            e = epoch.get(s, 0)
            if reset:
                epoch[s] = e + 1
                want[i] = (e + 1, None, None)
                continue
            values = held.setdefault((s, e, kind), [])
            if asked:
                want[i] = (e, f"[{kind}_{asked}]", values[asked - 1] if asked <= len(values) else None)
            else:
                values.append(value)
                want[i] = (e, f"[{kind}_{len(values)}]", value)
    return want


@pytest.mark.parametrize("size", [120, 25])
def test_vault_numbers_in_order_of_arrival(spark, size):
    ids = list(range(120))
    ids[100:104], ids[3:7] = ids[3:7], ids[100:104]  # late rows and early ones
    batches = [_records(ids[i: i + size]) for i in range(0, 120, size)]
    feed = Feed(spark, RECORDS).add(*batches)
    rows = feed.run(lambda s: S.vault_stream(s, ["event_id"], KINDS))
    got = rows.collect()
    assert len(got) == 120
    want = _numbered(batches)
    assert {r.event_id: (r.epoch, None if r.is_reset else r.token, r.held_value) for r in got} == want
    last = {}
    for r in got:
        last[r.session_id] = max(last.get(r.session_id, 0), r.epoch)
    live = {r.event_id for r in S.current_vault(rows).collect()}
    assert live == {r.event_id for r in got if not r.is_reset and r.asked is None and r.epoch == last[r.session_id]}


def test_vault_goes_on_after_a_restart(spark):
    feed = Feed(spark, RECORDS).add(_records(range(30)))
    feed.run(lambda s: S.vault_stream(s, ["event_id"], KINDS))
    got = feed.add(_records(range(30, 60))).run(lambda s: S.vault_stream(s, ["event_id"], KINDS)).collect()
    want = _numbered([_records(range(30)), _records(range(30, 60))])
    assert {r.event_id: (r.epoch, None if r.is_reset else r.token, r.held_value) for r in got} == want


def test_in_order_arrival_equals_one_batch(spark):
    one = Feed(spark, RECORDS).add(_records(range(60))).run(lambda s: S.vault_stream(s, ["event_id"], KINDS))
    many = Feed(spark, RECORDS).add(*[_records(range(i, i + 20)) for i in (0, 20, 40)]).run(lambda s: S.vault_stream(s, ["event_id"], KINDS))
    one, many = one.drop("batch"), many.drop("batch")
    assert one.exceptAll(many).count() == 0 and one.count() == many.count()


# ---------------------------------------------------------------------------
ACTION = "struct<action:string,selector:string,value:string,reasoning:string,confidence:double>"
CALLS = f"call_id bigint, session_id string, ts timestamp, step int, has_empty boolean, plan array<{ACTION}>"


def _plan(*selectors):
    return [("type", s, None, "r", 0.9) for s in selectors]


def _at(minute):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minute)


def test_cursor_restarts_expires_and_plans_anew(spark):
    p, q = _plan("#a", "#b"), _plan("#c")
    batches = [
        [(1, "s", _at(0), 0, True, p), (2, "s", _at(1), 1, True, q), (3, "s", _at(2), 2, True, q)],  # the first plan is kept
        [(4, "s", _at(32), 3, True, p), (5, "s", _at(63), 4, True, p)],  # 30 minutes: still there; 31: forgotten
        [(6, "s", _at(64), 0, True, q), (7, "s", _at(65), 1, False, q), (8, None, None, 5, None, None), (9, "t", _at(3), 1, True, None)],
        [(10, "s", _at(60), 2, True, p)],  # a late call comes next
    ]
    feed = Feed(spark, CALLS).add(*batches)
    got = {r.call_id: (r.run, r.fresh, r.selector) for r in feed.run(lambda s: S.cursor_stream(s, "ts", ["ts", "call_id"])).collect()}
    assert got == {
        1: (1, True, "#a"), 2: (1, False, "#b"), 3: (1, False, "#c"),  # finished, fields empty: planned from the page of call 3
        4: (1, False, "#a"), 5: (2, True, "#a"),
        6: (3, True, "#c"), 7: (3, False, ""),  # nothing empty: finish
        8: (1, True, ""), 9: (1, True, ""), 10: (3, False, "#a"),
    }


def test_silent_sessions_are_removed(spark):
    import time

    feed = Feed(spark, CALLS).add([(1, "s", _at(0), 1, False, _plan("#a", "#b"))])
    build = lambda s: S.cursor_stream(s, "ts", ["ts", "call_id"], forget_ms=1)
    feed.run(build)
    time.sleep(2)
    feed.add([(2, "other", _at(0), 1, False, _plan("#a"))]).run(build)  # moves the time of arrival on
    time.sleep(2)
    got = {r.call_id: r.run for r in feed.add([(3, "s", _at(1), 1, False, _plan("#a", "#b"))]).run(build).collect()}
    assert got == {1: 1, 2: 1, 3: 1}  # the third call found no session


# ---------------------------------------------------------------------------
COLUMNS = (
    "page_id bigint, session_id string, step int, pos int, tag string, type string, id string, name string, classes array<string>, "
    "selector string, text string, label string, placeholder string, aria_label string, autocomplete string, role string, "
    "value string, is_img boolean, img_hints string, alt string, visible boolean, "
    "rect struct<x:double,y:double,width:double,height:double>, task string, verified boolean"
)


def _page(page_id, session, step, *elements, task="Fill", verified=True):
    return [
        (page_id, session, step, i, "input", kind, name, None, [], f"#{name}", None, None, None, None, None, None, value, False, None, None,
         True, (0.0, 0.0, 9.0, 9.0), task, verified)
        for i, (kind, name, value) in enumerate(elements)
    ]


def test_steps_fail_closed(spark):
    mail, secret, shows = ("email", "m", "ann@mail.example"), ("password", "pw", "hunter2 x"), ("text", "n", "my hunter2 x")
    first = [
        *_page(1, "a", 0, mail, secret),
        *_page(2, "b", 0, mail, verified=False),
        *_page(3, "c", 0, mail, verified=None),
        *_page(4, "d", 0, ("text", "n", "x"), task="call 987-65-4321 now"),
        *_page(5, "e", 0, secret, shows),
        *_page(6, "f", 0, mail, task=""),
        *_page(7, None, 0, mail),
        *_page(8, "g", -1, mail),
        *_page(None, "h", 0, secret, shows),
    ]
    second = [*_page(11, "a", 1, mail, shows), *_page(12, "b", 1, mail), *_page(13, "z", 1, shows)]
    feed = Feed(spark, COLUMNS).add(first, second)
    sink = J.step_sink(feed.out)
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(feed.path)
    J.run_available(J.step_stream(stream), sink)
    rows = {r.page_id: r for r in spark.read.parquet(f"{feed.out}/steps").collect()}
    assert {k: r.status for k, r in rows.items()} == {
        1: "sent", 2: "unverified image", 3: "unverified image", 4: "pattern leak", 5: "vault leak", 6: "invalid", 7: "invalid",
        8: "invalid", None: "invalid", 11: "vault leak", 12: "sent", 13: "sent"}
    assert all((r.body is not None) == (r.status == "sent") for r in rows.values())
    assert "[USER_EMAIL_1]" in rows[1].body and "[USER_EMAIL_2]" in rows[12].body  # numbers go on in a later batch
    assert spark.read.parquet(f"{feed.out}/work").count() == 0


def test_steps_are_numbered_without_a_state_operator(spark):
    feed = Feed(spark, COLUMNS).add(_page(1, "a", 0, ("email", "m", "ann@mail.example")))
    stream = spark.readStream.schema(COLUMNS).parquet(feed.path)
    q = J.step_stream(stream).writeStream.foreachBatch(J.step_sink(feed.out)).option("checkpointLocation", feed.progress).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"] == [] and spark.read.parquet(f"{feed.out}/steps").first().status == "sent"


def _step_rows(spark, batches):
    feed = Feed(spark, COLUMNS).add(*batches)
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(feed.path)
    J.run_available(J.step_stream(stream), J.step_sink(feed.out))
    return feed, {(r.page_id, r.status, r.vault_leaks, r.pattern_leaks, r.body) for r in spark.read.parquet(f"{feed.out}/steps").collect()}


def test_steps_in_many_batches_equal_one(spark):
    pages = [
        _page(i, None if i % 5 == 4 else f"s{i % 2}", i, ("email", "m", f"u{i}@mail.example" if i % 3 else ""), ("password", "pw", f"secret {i // 2}"),
              ("text", "n", f"says secret {i - 3}" if i % 2 else "call 987-65-4321 now"))
        for i in range(5)
    ]
    feed, many = _step_rows(spark, pages)
    _, one = _step_rows(spark, [sum(pages, [])])
    assert many == one and len(one) == 5 and {r[1] for r in one} >= {"sent", "vault leak", "invalid"}
    # after five batches those of 0 to 3 are in one segment; two fields of each page are sensitive, and three values look personal
    from veilspark.streaming import vaults as U

    assert U.segments(5) == [(0, 4), (4, 5)] and U.segments(7) == [(0, 4), (4, 6), (6, 7)] and U.segments(0) == []
    assert sum(spark.read.parquet(f"{feed.out}/vault/{a}-{b}").count() for a, b in U.segments(5)) == 2 * 5 + 3


def test_a_repeated_batch_of_steps_gives_the_same(spark):
    first, second = _page(1, "a", 0, ("email", "m", "ann@mail.example")), _page(2, "a", 1, ("email", "m", "bob@mail.example"))
    out = shared_dir(spark, "out")
    sink = J.step_sink(out)
    for batch, rows in ((0, first), (1, second), (1, second)):
        sink(J.step_stream(spark.createDataFrame(rows, COLUMNS)), batch)
    bodies = {r.page_id: r.body for r in spark.read.parquet(f"{out}/steps").collect()}
    assert "[USER_EMAIL_1]" in bodies[1] and "[USER_EMAIL_2]" in bodies[2]


def test_late_events_are_kept(spark):
    zero = (1.0,) * 6
    ddl = "ts timestamp, event_type string, " + ", ".join(f"{c} double" for c in ("capture_ms", "dom_ms", "perception_ms", "redaction_ms", "network_ms", "exec_ms"))
    feed = Feed(spark, ddl).add([(_at(600), "x", *zero)], [(_at(1), "x", *zero), (_at(2), "x", *zero)], [(None, "x", *zero)])
    rows = J.merged_windows(feed.run(lambda s: s, J.batch_sink(feed.out, J.window_deltas))).collect()
    assert {(r.start, r.steps) for r in rows} == {(_at(600), 1), (_at(0), 2), (None, 1)}
    assert all(r.worst_ms == 6.0 and r.slow_steps == 0 for r in rows)


HTML = """<html><head><title> A &amp; B </title><script>var a = '<input id="no">';</script></head><body>
<!-- <input id="commented"> --><label for="em"> Your <b>mail</b></label>
<input id="em" TYPE='email' class=" a  b " value="x@y.zz" data-type="zzz" style="left:5px; width:100px;height:20px">
<input type=file value="secret.txt"><input aria-hidden="true" name=plain>
<select name="s"><option value="1">One</option><option selected value="2">Two</option></select>
<textarea placeholder="say &quot;hi&quot;">a > b</textarea><div role="button" hidden>Press  me</div><div role="main">no</div>
<a href="/x?y=1">Go &amp; see</a><a name="anchor">no</a><span contenteditable="true" style="display: none">e</span>
<img src="p.png" id="me" alt="Profile photo"><canvas></canvas><button style="width:1px;height:30px">tiny</button></body></html>"""


def test_html_snapshot(spark):
    pages = spark.createDataFrame([(1, HTML), (2, "no markup"), (3, None)], "page_id bigint, html string")
    rows = H.snapshot_elements(pages).orderBy("pos").collect()
    assert [(r.page_id, r.pos, r.tag) for r in rows] == [(1, i, t) for i, t in enumerate(
        ["label", "input", "input", "input", "select", "textarea", "div", "a", "span", "img", "canvas", "button"])]
    e = {r.pos: r for r in rows}
    assert e[0].for_id == "em" and e[0].label_text == "Your mail"
    assert (e[1].type, e[1].classes, e[1].value, e[1].selector, tuple(e[1].rect)) == ("email", ["a", "b"], "x@y.zz", "#em", (5, 0, 100, 20))
    assert e[2].value is None and e[3].label == "plain" and not e[3].visible and e[3].value == ""
    assert e[4].value == "2" and e[5].value == "a > b" and e[5].label == 'say "hi"'
    assert (e[6].text, e[6].role, e[6].visible) == ("Press me", "button", False)
    assert (e[7].text, e[7].href) == ("Go & see", "/x?y=1") and not e[8].visible
    assert e[9].is_img and e[9].img_hints == "me Profile photo" and e[10].is_img and not e[11].visible
    assert H.snapshot_elements(pages, limit=3).count() == 3
    assert pages.filter("page_id = 1").select(H.page_title(F.col("html"))).first()[0] == "A & B"
    assert [(r.for_id, r.text) for r in H.snapshot_labels(H.snapshot_elements(pages)).collect()] == [("em", "Your mail")]
