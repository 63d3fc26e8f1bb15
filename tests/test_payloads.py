import pytest
from pyspark.sql import functions as F

from tests.test_forms import table
from veilspark import fixed
from veilspark.operators import classify as C
from veilspark.operators import planning as L
from veilspark.operators import quality as K
from veilspark.operators import scan as S
from veilspark.operators.containment import containment


def leaks(spark, body, raws=(), allow=()):
    texts = spark.createDataFrame([("p", body)], "p string, body string")
    items = spark.createDataFrame([(r,) for r in raws], "raw string")
    direct = containment(texts, ["p"], "body", items, ["raw"], "raw").count()
    allowed = spark.createDataFrame([(a,) for a in allow], "value string") if allow else None
    return direct + S.pattern_leaks(texts, "body", ["p"], allowed).count()


@pytest.mark.parametrize("body,raws,allow,n", [
    ('{"value":"[USER_PASSWORD_1]"}', ["Pw@2026#Demo"], [], 0),
    ('{"value":"Pw@2026#Demo"}', ["Pw@2026#Demo"], [], 1),
    ('{"value":"ravi.kumar@example.com"}', [], [], 1),
    ('{"value":"ravi.kumar@example.com"}', [], ["ravi.kumar@example.com"], 0),
    ('{"text":"pay with 4111111111111111 now"}', [], [], 1 + 0),
    ('{"cvv":"123"}', ["123"], [], 0),                       # under four characters: never checked
    ('{"value":"a\\\\"b-secret"}', ['a"b-secret'], [], 0),   # escaped in JSON: not seen
    ('{"value":"[4111111111111111]"}', [], [], 0),           # bracketed digits count as a token
])
def test_leak_cases(spark, body, raws, allow, n):
    assert leaks(spark, body, raws, allow) == n


def audit(spark, rows, task="Fill the form"):
    found = S.element_violations(table(spark, rows), "page_id")
    tasks = spark.createDataFrame([("p", "task", task)], "page_id string, where string, task string")
    return {(r.where, r.pii_type, r.hint) for r in found.unionByName(S.violations(tasks, "task", "where", "page_id")).collect()}


def test_audit_clean_payload(spark):
    rows = [dict(tag="input", type="password", selector="#pw", value="[USER_PASSWORD_1]"),
            dict(tag="input", type="text", selector="#ref", value="1234567812345678"), dict(tag="button", text="Go")]
    assert audit(spark, rows) == set()


def test_audit_violations(spark):
    rows = [dict(tag="input", type="password", selector="#pw", value="open sesame"),
            dict(tag="input", type="text", selector="", value="4111-1111-1111-1111"),
            dict(tag="button", selector="#b", text="call 9876543210"),
            dict(tag="input", type="text", selector="#l", label="mail me at a@b.co", value="")]  # labels are not scanned
    assert audit(spark, rows, "write to x@y.org") == {
        ("dom_elements[#pw].value", "password", "op***"), ("dom_elements[input].value", "credit_card", "4111****"),
        ("dom_elements[#b].text", "phone", "987***"), ("task", "email", "x@y***")}


def test_compliance_lists_clean_payloads(spark):
    pages = spark.createDataFrame([("a",), ("b",)], "page_id string")
    found = spark.createDataFrame([("b", "x"), ("b", "y")], "page_id string, w string")
    got = {r.page_id: (r.violations, r.compliant) for r in S.compliance(pages, found, ["page_id"]).collect()}
    assert got == {"a": (0, True), "b": (2, False)}


def test_payload_constraints(spark):
    df = spark.createDataFrame([("x", "s", 0), ("", "s", 0), ("x" * 2001, "s", 0), ("x", "", 0), ("x", "s" * 129, 0), ("x", "s", -1), ("x", None, 0)],
                               "task string, s string, step int")
    assert [r[0] for r in df.select(K.payload_is_valid(F.col("task"), F.col("s"), F.col("step"))).collect()] == [True] + [False] * 6


LOGIN = [dict(tag="input", type="email", selector="#email", label="Email", value="[USER_EMAIL_1]", rect=(0, 100, 50, 30)),
         dict(tag="input", type="password", selector="#password", label="Password", value="[USER_PASSWORD_1]", rect=(0, 150, 50, 30)),
         dict(tag="input", type="text", selector="#captcha", label="Captcha", value="", rect=(0, 200, 50, 30)),
         dict(tag="button", type="button", selector="#help", text="Help", rect=(0, 240, 50, 30)),
         dict(tag="button", type="submit", selector="#go", text="Sign in", rect=(0, 300, 50, 30))]


def plan(spark, rows):
    return [(a["action"], a["selector"], a["value"]) for a in L.page_plans(table(spark, rows), ["page_id"]).first()["plan"]]


def test_plan_of_a_login_page(spark):
    assert plan(spark, LOGIN) == [("type", "#email", "[USER_EMAIL_1]"), ("type", "#password", "[USER_PASSWORD_1]"),
                                  ("type", "#captcha", "A7X3"), ("click", "#go", None), ("finish", "", None)]


def test_plan_below_the_fold_scrolls_first(spark):
    rows = [dict(LOGIN[0], rect=(0, 700, 50, 30))]
    assert [a[0] for a in plan(spark, rows)] == ["scroll", "type", "finish"]
    assert [a[0] for a in plan(spark, [dict(tag="img", selector="#i")])] == ["finish"]


def test_plan_dedupes_selectors_in_visual_order(spark):
    rows = [dict(LOGIN[0], rect=(0, 300, 50, 30)), dict(LOGIN[1], rect=(60, 100, 50, 30)), dict(LOGIN[0], rect=(0, 100, 50, 30)),
            dict(tag="button", selector="#a", text="A"), dict(tag="button", selector="#z", text="Z")]
    assert plan(spark, rows) == [("type", "#email", "[USER_EMAIL_1]"), ("type", "#password", "[USER_PASSWORD_1]"), ("click", "#z", None), ("finish", "", None)]


def test_calls_after_the_end(spark):
    plans = L.page_plans(table(spark, [dict(r, page_id=p, value="x" if p == "full" else "") for p in ("full", "open") for r in LOGIN[:1]]), ["page_id"])
    calls = spark.createDataFrame([(p, n) for p in ("full", "open") for n in range(4)], "page_id string, n int")
    got = {(r.page_id, r.n): (r.action, r.reasoning) for r in L.answer_calls(calls, plans, ["page_id"], "n").collect()}
    assert [got[("open", n)][0] for n in range(4)] == ["type", "finish", "type", "finish"]
    assert [got[("full", n)][0] for n in range(4)] == ["type", "finish", "finish", "finish"]
    assert got[("full", 3)][1] == fixed.PLAN_TEXT["idle"]


def test_summary_and_empty_summary(spark):
    rows = [dict(r, pos=i) for i, r in enumerate(LOGIN)] + [dict(tag="a", selector=f"#l{i}", pos=i) for i in range(5, 80)]
    lines = L.page_summary(table(spark, rows), "page_id").first().summary.split("\n")
    assert len(lines) == 60
    assert lines[0] == "  input #email type=email label=Email value=[USER_EMAIL_1] at=(0,100)"
    late = L.page_summary(table(spark, [dict(tag="a", pos=70)]), "page_id").first().summary
    assert late == fixed.EMPTY_SUMMARY


def test_action_contract_differs_between_sides(spark):
    rows = [("type", "#a", None, 0.5, None, None), ("click", "", "v", 0.5, None, None), ("scroll", "", None, None, "left", 5),
            ("scroll", "", None, 1.0, "up", 10001), ("fly", "#a", "v", 0.5, None, None), ("finish", None, None, 1.1, None, None),
            ("type", "#a", "", 0.0, None, None)]
    df = spark.createDataFrame(rows, "action string, selector string, value string, confidence double, direction string, distance int")
    got = [(r[0], r[1]) for r in df.select(K.action_ok_for_client(), K.action_ok_for_server()).collect()]
    assert got == [(True, False), (False, False), (True, False), (True, False), (False, False), (False, False), (True, True)]


@pytest.mark.parametrize("text,action,selector,value,error", [
    ('{"action":"click","selector":"#a"}', "click", "#a", None, None),
    ('```json\n{"action":"type","selector":"#a"}\n```', "type", "#a", "", None),
    ('Here: {"action":"scroll"} ok', "scroll", "", None, None),
    ('{"action":"dance"}', "finish", "", None, None),
    ('{}', "finish", "", None, None),
    ('{"action":"click"}', "click", "", None, "invalid action"),
    ('{"action":"finish","confidence":2}', "finish", "", None, "invalid action"),
    ('[1]', None, None, None, "not an object"),
    ('nothing', None, None, None, "no JSON"),
    ('  ', None, None, None, "empty response"),
])
def test_response_repair(spark, text, action, selector, value, error):
    df = spark.createDataFrame([(1, text)], "i int, r string")
    r = K.repaired_actions(df, "r", "i").first()
    assert (r.action, r.selector, r.value, r.error) == (action, selector, value, error)


def test_targets(spark):
    page = table(spark, [dict(tag="input", selector="#x", id="x", name="first"), dict(tag="div", selector=".y", id="y"),
                         dict(tag="button", selector="#b", text=" Sign In "), dict(tag="input", type="submit", selector="#s", value="Pay"),
                         dict(tag="div", selector="#t", text="Sign in")])
    asked = ["#x", "#y", "first", "text=sign in", "text= PAY ", "#gone", "gone"]
    actions = spark.createDataFrame([("p", i, s) for i, s in enumerate(asked)], "page_id string, a int, selector string")
    got = {r.a: (r.way, r.target_pos) for r in L.action_targets(actions, page, ["page_id"], "a").collect()}
    assert got == {0: ("selector", 0), 1: ("id", 1), 2: ("name", 0), 3: ("text", 2), 4: ("text", 3), 5: (None, None), 6: (None, None)}
    assert {r.a for r in L.dangling(actions, page, "page_id").collect()} == {1, 2, 3, 4, 5, 6}



def test_targets_of_odd_actions(spark):
    """Repeated and missing ids, no selector, pages without elements or key: each action row stays, with its page's elements only."""
    page = table(spark, [dict(tag="div", selector="#x", id="x"), dict(tag="div", selector="#x", name="x")])
    asked = [("p", 1, "#x"), ("p", 1, "x"), ("p", 2, None), ("q", 3, "#x"), (None, 4, "#x"), ("p", None, "#x")]
    actions = spark.createDataFrame(asked, "page_id string, a int, selector string")
    both = page.unionByName(page.withColumn("page_id", F.lit(None).cast("string")))
    got = [tuple(r) for r in L.action_targets(actions, both, ["page_id"], "a", tasks=3).collect()]
    found = {("p", 1): ("selector", 0)}
    assert sorted(got, key=str) == sorted([(*r, *found.get(r[:2], (None, None))) for r in asked], key=str)


def test_form_checks(spark):
    base = dict(form=None, otp=None, captcha=None, fullname=None, phone=None, card=None, expiry=None, cvv=None, address=None,
                dob=None, idnum=None, consent=None)
    rows = [dict(base, form="login", otp="426000", captcha=" A7X3 "), dict(base, form="login", otp="4260", captcha="no"),
            dict(base, form="checkout", fullname="A", phone="+91 98765 43210", card="4111 1111 1111 1111", expiry="12/28", cvv="123", address="x"),
            dict(base, form="checkout", card="1234567812345678", expiry="13/28", cvv="12"),
            dict(base, form="kyc", fullname="Ana", dob="1996-04-17", idnum="2345 6789 0123", address="x", consent=True),
            dict(base, form="kyc", fullname="An", idnum="ABCDE1234F", consent=False)]
    ddl = ", ".join(f"{k} {'boolean' if k == 'consent' else 'string'}" for k in base)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ddl)
    got = [(r.valid, len(r.errors)) for r in K.form_errors(df).collect()]
    assert got == [(True, 0), (False, 2), (True, 0), (False, 6), (True, 0), (False, 4)]


def test_textual_gate(spark):
    df = table(spark, [dict(tag="input", type=t) for t in ("", "date", "checkbox")] + [dict(tag="textarea"), dict(tag="select")])
    assert [r[0] for r in df.select(C.is_textual_for_audit()).collect()] == [True, True, False, True, False]


def test_candidates_stay_near_the_hits_when_values_share_a_shape(spark):
    """One hot session: the anchors of values of one shape differ, so few texts meet a value that they lack."""
    from veilspark.operators.containment import anchors, candidates

    ratio = []
    for n in (100, 1000):
        values = [("hot", f"Customer#{i * 7919 % 10**9:09d}") for i in range(n)] + [("hot", f"user{i}@example.com") for i in range(n)]
        items = spark.createDataFrame(values, "s string, raw string")
        texts = spark.createDataFrame(
            [("hot", i, f"order of {values[i][1]} and {values[n + i][1]} done") for i in range(n)], "s string, p int, body string"
        )
        anchored = anchors(items, "raw", ["s"])
        assert anchored.count() == len(values)
        ratio.append(candidates(texts, ["s", "p"], "body", anchored, "raw", ["s"]).distinct().count() / (2 * n))
        hits = containment(texts, ["s", "p"], "body", items, ["s", "raw"], "raw", scope=["s"])
        assert hits.count() >= 2 * n
    assert max(ratio) < 12


def test_short_strings_on_their_own(spark):
    import random
    import re

    from veilspark.operators.containment import containment, too_short

    rnd = random.Random(3)
    alphabet = list("01aé-. \"€")
    texts = [(i, i % 3, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))) for i in range(120)] + [(500, 0, None), (501, 0, "")]
    items = [(i, i % 3, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 6)))) for i in range(90)] + [(900, 0, None), (901, 0, "")]
    t = spark.createDataFrame(texts, "text_id int, s int, body string")
    v = spark.createDataFrame(items, "item_id int, s int, secret string")

    def shows(body, secret):
        if len(secret) >= 4:
            return secret in body
        first, last = (r"(?<![^\W_])" if secret[0].isalnum() else ""), (r"(?![^\W_])" if secret[-1].isalnum() else "")
        return re.search(first + re.escape(secret) + last, body) is not None

    for scoped in (True, False):
        keys = (["text_id", "s"], ["item_id", "s"], ["s"]) if scoped else (["text_id"], ["item_id"], [])
        left, right = (t, v) if scoped else (t.drop("s"), v.drop("s"))
        for least in (1, 3, 4):
            got = {(r.text_id, r.item_id) for r in containment(left, keys[0], "body", right, keys[1], "secret", keys[2], least).collect()}
            assert got == {(a, b) for a, s, x in texts for b, z, y in items
                           if (s == z or not scoped) and x is not None and y and len(y) >= least and shows(x, y)}
    assert {r.too_short for r in too_short(v, "secret", least=1).collect()} == {1}  # the empty one


def test_strings_that_share_their_anchor_are_matched_together(spark, monkeypatch):
    import random

    from veilspark.operators import containment as M

    rnd = random.Random(9)
    secrets = [(i, i % 2, f"same shape {i % 7} of every text {i}") for i in range(60)] + [(i, i % 2, f"Z{i:02}0000000") for i in range(60, 99)] + [(200, 0, "aaaa"), (201, 0, "aaaaa")]
    texts = [(i, i % 2, " ".join(rnd.choice(secrets)[2] for _ in range(4)) + " Z0000000000 aaaaaa") for i in range(40)] + [(99, 0, None), (98, 1, "")]
    t, v = spark.createDataFrame(texts, "text_id int, s int, body string"), spark.createDataFrame(secrets, "item_id int, s int, secret string")
    for share, block in ((0, 1), (0, 7), (2, 20_000), (1000, 20_000)):
        monkeypatch.setattr(M, "BLOCK", block)
        for scoped in (True, False):
            keys = (["text_id", "s"], ["item_id", "s"], ["s"]) if scoped else (["text_id"], ["item_id"], [])
            left, right = (t, v) if scoped else (t.drop("s"), v.drop("s"))
            got = sorted((r.text_id, r.item_id) for r in containment(left, keys[0], "body", right, keys[1], "secret", keys[2], share=share).collect())
            assert got == sorted((a, b) for a, s, x in texts for b, z, y in secrets if (s == z or not scoped) and x and y in x)


def test_pages_without_elements(spark):
    from veilspark.operators import elements as E
    from veilspark.operators import flow as W

    rows = table(spark, [dict(tag="input", type="text", pos=0, page_id="a", rect=(0.0, 900.0, 9.0, 9.0))])
    pages = spark.createDataFrame([("a", 2000.0), ("b", None), ("b", None)], "page_id string, tall double")
    whole = E.on_all_pages(rows, pages, "page_id").join(pages.distinct(), "page_id")
    plans = L.page_plans(whole, ["page_id"], "tall")
    got = {r.page_id: [a["action"] for a in r.plan] for r in plans.collect()}
    assert got["b"] == ["finish"] and "scroll" not in got["a"]
    assert "(0 fields, submit=no)" in [r for r in plans.collect() if r.page_id == "b"][0].plan[0]["reasoning"]
    calls = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), ("gone", 0)], "page_id string, n int")
    answers = {(r.page_id, r.n): r.action for r in L.answer_calls(calls, plans, ["page_id"], "n").collect()}
    assert answers[("b", 0)] == answers[("b", 1)] == answers[("gone", 0)] == "finish"
    assert {r.page_id: r.summary for r in L.page_summary(whole, "page_id").collect()}["b"] == fixed.EMPTY_SUMMARY
    bodies = W.payload_bodies(whole.withColumns({"session_id": F.lit("s"), "step": F.lit(0)}), F.lit("t"))
    assert '"dom_elements":[]' in {r.page_id: r.body for r in bodies.collect()}["b"]


def test_newest_steps(spark):
    from veilspark.operators import sessions as T

    rows = [(s, None if i == 3 else i, i) for s in ("a", "b", None) for i in range(60)]
    got = T.newest(spark.createDataFrame(rows, "s string, ts int, id int"), "s", ["ts", "id"], 5).collect()
    assert sorted((str(r.s), r["rank"], r.ts) for r in got) == sorted((str(s), k + 1, 59 - k) for s in ("a", "b", None) for k in range(5))


def test_a_failing_provider_says_why(spark):
    from veilspark.operators import providers as R

    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "k int, prompt string")

    def raising():
        def run(texts):
            raise TimeoutError("no answer")
        return run

    for load, failure in ((raising, "TimeoutError: no answer"), (lambda: lambda texts: ["x"] * 5, None)):
        rows = R.provider_actions(prompts, "prompt", load, "k").collect()
        assert [r.action for r in rows] == [None, None] and all(r.error == "empty response" for r in rows)
        assert all(r.failure == failure if failure else r.failure.startswith("ValueError: 5 answers") for r in rows)
