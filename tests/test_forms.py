import json

import pytest
from pyspark.sql import functions as F

from tests import fixture_pages as X
from veilspark import fixed
from veilspark.functions import patterns as P
from veilspark.operators import boxes as B
from veilspark.operators import classify as C
from veilspark.operators import elements as E
from veilspark.operators import matching as M
from veilspark.operators import scoring as S
from veilspark.operators import vault as V
from veilspark.sources import sinks
from veilspark.sources.snapshots import read_ground_truth, read_snapshots

COLUMNS = ("tag", "type", "id", "name", "classes", "selector", "text", "label", "placeholder", "aria_label", "autocomplete",
           "role", "value", "is_img", "img_hints", "alt", "visible", "rect")
DDL = ("page_id string, session_id string, step int, pos int, tag string, type string, id string, name string, "
       "classes array<string>, selector string, text string, label string, placeholder string, aria_label string, "
       "autocomplete string, role string, value string, is_img boolean, img_hints string, alt string, visible boolean, "
       "rect struct<x:double,y:double,width:double,height:double>")


def table(spark, rows):
    """Element rows from dicts; position is the list order, one page unless given."""
    out = []
    for i, r in enumerate(rows):
        box = r.get("rect", (10, 10, 100, 30))
        values = {**r, "rect": None if box is None else tuple(map(float, box))}
        out.append((r.get("page_id", "p"), r.get("session_id", "s"), r.get("step", 0), r.get("pos", i),
                    *[values.get(c, False if c == "is_img" else True if c == "visible" else None) for c in COLUMNS]))
    return spark.createDataFrame(out, DDL)


@pytest.fixture(scope="module")
def truth(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("gt")
    for page in X.PAGES:
        (folder / f"{page['page']}.json").write_text(json.dumps(page))
    return read_ground_truth(spark, str(folder))


@pytest.fixture(scope="module")
def pages(truth):
    source, _, _ = truth
    return source.withColumn("session_id", F.col("page_id")).withColumn("step", F.lit(0)).cache()


def test_ground_truth_source_drops_verdicts_and_spans(truth):
    source, judged, faces = truth
    assert {"sensitive", "piiType", "mode", "hint"}.isdisjoint(source.columns)
    assert source.filter("tag = 'span'").count() == 0 and source.count() == 28
    assert judged.filter("sensitive").count() == 17 and faces.count() == 1


def test_snapshot_source(spark, tmp_path):
    snap = {"url": "http://x/y", "title": "T", "viewport": {"width": 1280, "height": 800, "dpr": 1}, "elements": [
        {"tag": "input", "ariaLabel": "A", "selector": "#a", "rect": X.rect(1, 2, 3, 4)}, {"tag": "img", "isImg": True}]}
    (tmp_path / "one.json").write_text(json.dumps(snap))
    rows = read_snapshots(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.page_id, r.pos, r.tag, r.aria_label, r.is_img) for r in rows] == [("one", 0, "input", "A", False), ("one", 1, "img", None, True)]


def test_golden_detections(pages):
    found = C.detections(C.with_detection(pages), "page_id").collect()
    assert {(r.page_id, r.selector): (r.pii_type, r.confidence, r.mode) for r in found} == X.DETECTED


def test_golden_context_size(pages):
    assert E.interactive_context(pages, "page_id").count() == 24


def test_golden_tokens_and_untouched_values(pages):
    tagged = V.attach_detection(C.with_detection(pages), ["page_id"])
    tokens = V.tokens(tagged)
    clean = V.sanitised_elements(tagged, tokens)
    values = {(r.page_id, r.selector): r.value for r in clean.collect()}
    for key, token in {**X.TOKENS, **X.UNTOUCHED}.items():
        assert values[key] == token
    assert "placeholder" not in clean.columns
    vault = V.vault_rows(tokens)
    assert vault.filter("session_id = 'login'").count() == 2  # the empty field has a token but no row
    raw = {r.raw_value for r in vault.collect()}
    assert raw.isdisjoint(values.values())


def test_golden_boxes_and_scores(spark, truth, pages):
    _, judged, faces = truth
    found = C.detections(C.with_detection(pages), "page_id").select(
        "page_id", "pos", "selector", "box", "confidence", "pii_type", "mode")
    vision = spark.createDataFrame(
        [("kyc", 1000, None, (388.0, 132.0, 112.0, 124.0), 0.81, "face", "blur")], found.schema)
    every = found.unionByName(vision)
    applied = B.redaction_boxes(B.merged(every, "page_id"), 1280.0, 800.0).withColumnRenamed("grp", "pos")
    got = {}
    for r in applied.orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.box.x, r.box.y, r.box.width, r.box.height))
    assert {p: sorted(b) for p, b in got.items()} == {p: sorted(map(lambda t: tuple(map(float, t)), b)) for p, b in X.APPLIED.items()}
    photo = applied.filter("mode = 'blur'").first()
    assert (photo.block, photo.pii_type, photo.members) == (28, "face", 2)

    wanted = judged.filter("sensitive AND visible")
    expected = judged.filter("visible AND tag NOT IN ('img', 'span')")
    context = E.interactive_context(pages, "page_id")
    m1 = M.with_scores(M.match_counts(M.set_match(expected, context, ["page_id"], "selector"), "page_id")).filter("page_id IS NULL").first()
    assert (m1.tp, m1.fp, m1.fn, m1.f1) == (24, 0, 0, 1.0)
    faces = faces.withColumnRenamed("box", "face_box")
    m2 = M.with_scores(S.class_match_counts(wanted, faces, every, ["page_id"])).first()
    assert (m2.tp, m2.fp, m2.fn) == (18, 0, 0)
    regions = wanted.select("page_id", F.col("pos").alias("gt_pos"), F.col("rect").alias("gt_box"))
    gates = spark.createDataFrame([("login", True), ("kyc", True)], "page_id string, ok boolean")
    m3 = S.redaction_summary(regions, applied, gates, ["page_id"]).first()
    assert m3.mean_iou == pytest.approx(0.7919611703922791)
    assert m3.mean_coverage == 1.0
    assert m3.overmask == pytest.approx(0.03635394456289979)
    assert m3.score == pytest.approx(90.63825266765257)
    closed = spark.createDataFrame([("login", True), ("kyc", False)], "page_id string, ok boolean")
    assert S.redaction_summary(regions, applied, closed, ["page_id"]).first().score == 0.0


def test_classifier_unit_cases(spark):
    rows = table(spark, [
        dict(tag="input", type="text", selector="#order", label="Order reference", value="1234567812345678"),
        dict(tag="input", type="text", selector="#card", label="Card", value="4111 1111 1111 1111"),
        dict(tag="input", type="text", selector="#captcha", label="Captcha code", value=""),
        dict(tag="button", selector="#go", text="Sign in"),
        dict(tag="input", type="text", selector="#h", label="Password", value="X1", visible=False),
        dict(tag="input", type="text", selector="#small", label="Password", rect=(0, 0, 1, 30)),
        dict(tag="input", type="text", selector="#none", label="Password", rect=None),                # an unknown box hides nothing
        dict(tag="a", selector="#forgot", label="Forgot password?"),                     # keyword rules have no textual gate
        dict(tag="button", selector="#mail", label="Email us"),                          # gated rules do
        dict(tag="input", type="text", selector="#n", id="n", label="Name"),             # ^name only at the start
        dict(tag="input", type="text", selector="#x", name="name"),
        dict(tag="input", type="text", selector="#t1", label="token"),
        dict(tag="input", type="text", selector="#t2", label="token name"),
        dict(tag="input", type="file", selector="#f", label="File", value="a@b.co"),
        dict(tag="img", selector="#logo", is_img=True, alt="logo"),
        dict(tag="canvas", selector="#sig", is_img=True, img_hints="selfie shot"),
        dict(tag="img", selector="#pw", is_img=True, label="password"),                  # images fall back to field rules
        dict(tag="input", type="TEXT", selector="#up", autocomplete="CC-NUMBER"),
        dict(tag="input", type="text", selector="#cct", autocomplete="cc-type", label="Kind"),
    ])
    got = {r.selector: (r.pii_type, r.confidence, r.token_kind) for r in C.detections(C.with_detection(rows), "page_id").collect()}
    assert got == {
        "#card": ("credit_card", 0.96, "CARD_NUMBER"),
        "#none": ("password", 0.99, "USER_PASSWORD"),
        "#forgot": ("password", 0.99, "USER_PASSWORD"),
        "#x": ("name", 0.80, "USER_NAME"),
        "#t1": ("sensitive", 0.75, "USER_SECRET"),
        "#sig": ("photo", 0.80, None),
        "#pw": ("password", 0.99, "USER_PASSWORD"),
        "#up": ("credit_card", 0.97, "CARD_NUMBER"),
    }
    everything = C.with_detection(rows.filter("selector = '#h'"), include_invisible=True).first()
    assert everything.det.pii_type == "password"


def test_rules_as_data_agree_with_the_case(spark, pages):
    by_table = C.classify_by_rule_table(pages, C.rule_table(spark), "page_id").collect()
    keyword = {(r.page_id, r.pos): r.pii_type for r in by_table}
    assert keyword[("checkout", 4)] == "otp" and keyword[("kyc", 6)] == "sensitive"
    extra = spark.createDataFrame([(0, "(?i)order reference", "account_number", 0.5)], C.rule_table(spark).schema)
    more = C.classify_by_rule_table(pages, C.rule_table(spark).unionByName(extra), "page_id")
    assert more.filter("pii_type = 'account_number' AND priority = 0").count() == 1


def test_tokenise_wipes_and_drops(spark):
    rows = table(spark, [
        dict(tag="input", type="password", selector="#pwd", label="Password", placeholder="...", value="S3cret#1"),
        dict(tag="input", type="hidden", selector="#nick", label="Nickname", value="ravi@example.com", visible=False),
        dict(tag="input", type="hidden", selector="#plain", label="Nick", value="Mumbai", visible=False),
        dict(tag="input", type="text", selector="#hid", label="Password", value="hunter2", visible=False),
    ])
    tagged = V.attach_detection(C.with_detection(rows), ["page_id"])
    clean = {r.selector: r.value for r in V.sanitised_elements(tagged, V.tokens(tagged)).collect()}
    # a hidden secret that is not PII-shaped passes; a PII-shaped one is wiped
    assert clean == {"#pwd": "[USER_PASSWORD_1]", "#nick": "", "#plain": "Mumbai", "#hid": "hunter2"}


def test_same_value_gets_two_tokens_and_numbers_run_over_steps(spark):
    rows = table(spark, [dict(tag="input", type="email", selector=f"#m{s}{p}", value="a@b.co", page_id=f"p{s}", step=s, pos=p)
                         for s in range(3) for p in range(2)])
    tagged = V.attach_detection(C.with_detection(rows), ["page_id"])
    got = [r.token for r in V.tokens(tagged).orderBy("step", "pos").collect()]
    assert got == [f"[USER_EMAIL_{i}]" for i in range(1, 7)]


def test_shared_selector_uses_the_first_detection(spark):
    rows = table(spark, [dict(tag="input", type="text", selector="#a", label="Plain", value="v0"),
                         dict(tag="input", type="email", selector="#a", value="x@y.zz"),
                         dict(tag="input", type="tel", selector="#a", value="1")])
    tagged = V.attach_detection(C.with_detection(rows), ["page_id"])
    got = {r.pos: r.value for r in V.sanitised_elements(tagged, V.tokens(tagged)).collect()}
    assert got == {0: "[USER_EMAIL_1]", 1: "[USER_EMAIL_2]", 2: "[USER_EMAIL_3]"}


def test_resolution(spark):
    vault = spark.createDataFrame([("s", "[USER_PASSWORD_1]", "SecretPass123")], "session_id string, token string, raw_value string")
    defaults = spark.createDataFrame([(1, "USER_OTP_1", "426000"), (2, "ADDRESS_1", "1 Road"), (3, "USER_EMAIL_1", "d@e.fr")],
                                     "ord int, token_name string, raw_value string")
    asked = spark.createDataFrame([("s", v) for v in ("[USER_PASSWORD_1]", "[USER_OTP_1]", "[ADDRESS_2]", "Mumbai", " [USER_EMAIL_1] ",
                                                      "[NOPE_1]", None)] + [("t", "[USER_PASSWORD_1]")], "session_id string, value string")
    got = {(r.session_id, r.value): r.resolved for r in V.resolve_tokens(asked, vault, defaults).collect()}
    assert got == {("s", "[USER_PASSWORD_1]"): "SecretPass123", ("s", "[USER_OTP_1]"): "426000", ("s", "[ADDRESS_2]"): "1 Road",
                   ("s", "Mumbai"): "Mumbai", ("s", " [USER_EMAIL_1] "): "d@e.fr", ("s", "[NOPE_1]"): None, ("s", None): None,
                   ("t", "[USER_PASSWORD_1]"): None}
    known = {(r.session_id, r.value) for r in V.known_tokens(asked, vault, defaults).collect()}
    assert known == {("s", "[USER_PASSWORD_1]"), ("s", "[USER_OTP_1]")}


def test_label_sources(spark):
    fields = spark.createDataFrame([("p", i, f"f{i}", e, a, ph, n) for i, (e, a, ph, n) in enumerate(
        [(None, "aria", "ph", "n"), (" in ", "aria", None, None), (None, None, "ph", "n"), (None, None, None, "n"), (None,) * 4])],
        "page_id string, pos int, id string, enclosing_label string, aria_label string, placeholder string, name string")
    labels = spark.createDataFrame([("p", "f0", 5, "later"), ("p", "f0", 1, " First "), ("p", "f2", 0, "  "), ("p", "f2", 1, "second")],
                                   "page_id string, for_id string, pos int, text string")
    got = {r.pos: r.resolved_label for r in E.resolve_labels(fields, labels, "page_id").collect()}
    assert got == {0: "First", 1: "in", 2: "ph", 3: "n", 4: None}


def test_sinks_refuse_vault_columns(spark, tmp_path):
    bad = spark.createDataFrame([("s", "x")], "session_id string, raw_value string")
    with pytest.raises(ValueError):
        sinks.write_sanitised(bad, str(tmp_path / "no"))
    good = spark.createDataFrame([("a b/c", 0, "t"), ("a b/c", 1, "u")], "session_id string, step_index int, task string")
    for _ in range(2):  # a repeated run leaves one copy
        sinks.write_payload_log(good, str(tmp_path / "log"))
    back = spark.read.json(str(tmp_path / "log"))
    assert {r.session_id for r in back.collect()} == {"a_b_c"} and back.count() == 2
    sinks.write_results({"context": good}, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res" / "context")).count() == 2
    sinks.write_metrics(good, str(tmp_path / "metrics"))
    sinks.write_vault(bad, str(tmp_path / "vault"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2


def test_url_classes_cap(spark):
    df = spark.createDataFrame([("http://a/b?x=1#y", "  a  b c d e f g h i "), ("http://a/b#y?z", None)], "u string, c string")
    rows = df.select(E.strip_url(F.col("u")).alias("u"), E.class_list(F.col("c")).alias("c")).collect()
    assert [r.u for r in rows] == ["http://a/b", "http://a/b"]
    assert rows[0].c == list("abcdefgh") and rows[1].c == []
    many = table(spark, [dict(tag="a", pos=i) for i in range(410)])
    assert E.capped(many, "page_id").count() == 400


def test_audit_kind_differs_from_the_detector(spark):
    rows = table(spark, [
        dict(tag="select", selector="#c", label="City"),           # address without a textual gate
        dict(tag="button", selector="#e", text="E-mail me"),       # text is part of the context
        dict(tag="input", type="text", selector="#p", classes=["password"]),  # classes are not
        dict(tag="input", type="text", selector="#cap", label="Captcha"),
        dict(tag="input", type="text", selector="#s", label="State"),
        dict(tag="input", type="text", selector="#ctry", label="Country"),
    ])
    got = {r.selector: (r.field_kind, r.fill) for r in
           C.with_audit_kind(rows).select("selector", "field_kind", C.fill_value().alias("fill")).collect()}
    assert got == {"#c": ("address", "Mumbai"), "#e": ("email", "[USER_EMAIL_1]"), "#p": (None, "demo_value"),
                   "#cap": (None, "A7X3"), "#s": ("address", "Maharashtra"), "#ctry": (None, "India")}


def test_lookup_gives_null_for_unknown(spark):
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    assert [r[0] for r in df.select(P.lookup(F.col("k"), {"a": "1"})).collect()] == ["1", None]


def test_snapshot_ids_are_paths(spark, tmp_path):
    from veilspark.sources import snapshots

    for folder in ("a", "b/c"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "elements.json").write_text('{"url": "u", "elements": [{"tag": "a"}]}')
    rows = snapshots.read_snapshots(spark, str(tmp_path)).collect()
    assert {r.page_id for r in rows} == {"a/elements", "b/c/elements"}


def test_literals_are_sought_before_patterns_and_change_nothing(spark):
    patterns = [r[1] for r in fixed.KEYWORD_RULES + fixed.AUDIT_KEYWORD_RULES] + [r[0] for r in fixed.GATED_RULES]
    patterns += [fixed.PHOTO_WORDS, fixed.BIRTH_HINT, fixed.AUDIT_EMAIL, fixed.AUDIT_NAME, fixed.AUDIT_ADDRESS, fixed.AUDIT_ZIP]
    words = "", "PassWORD", "pasword", "E-Mail", "e mail", "M code", "m code", "API-KEY", "apİ key", "toKen", "toKen TOKEN", "x pin", "pinned", "acc.", \
        "ACC #", "Driver's licence", "drivers license", "born on", "first\nName", "İzip", "ZIṖ", "Straße street", "handle", "username", "user id", "photo", \
        "profile pic", "CTC", "one-time code", "One Time PASSWORD", "name", "my name", "ſtate STATE", "dob", "token for the id"
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert all("contains(" in C._rlike("t", p) for p in patterns)
    plain = [F.rlike("t", F.lit(P.java_regex(p, ignore_case=True))) for p in patterns]
    tried = [F.expr(C._rlike("t", p)) for p in patterns]
    for row in df.select("t", F.array(*plain).alias("a"), F.array(*tried).alias("b")).collect():
        assert row.a == row.b, row.t
