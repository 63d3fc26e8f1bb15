import random
import time

from veilspark.sources import html as H
from veilspark.sources import markup as M


def _told(source):
    return [(e["tag"], e["inner"], e["value"], e["associated"], e["enclosing"]) for e in M.elements(source)]


def test_enclosing_and_associated_labels():
    assert _told('<label>Card <b>no</b> <input></label><input>') == [
        ("label", "Card no", None, None, None), ("input", "", "", "Card no", "Card no"), ("input", "", "", None, None)]
    # a label for another field encloses, but is not associated
    rows = _told('<label for="x">One <input id="y"></label><input id="x">')
    assert rows[1][3:] == (None, "One") and rows[2][3:] == ("One", None)
    # the first associated label counts, and only the first element of an id
    rows = _told('<input id="a"><label for="a"> </label><label for="a">Two</label><input id="a">')
    assert rows[0][3] == "" and rows[3][3] is None


def test_nested_and_unclosed_elements():
    assert _told("<button>Pay <div>now <i>please</i></div></button>")[0][1] == "Pay now please"
    assert [r[1] for r in _told("<form><button>open</form>after<button>last")] == ["open", "last"]
    assert [r[1] for r in _told("<a href=1>one<a href=2>two</a>three")] == ["one", "two"]
    assert _told('<div role="button"><div>in</div> out</div> beyond')[0][1] == "in out"
    assert _told("</button></div><button>x</b></button>")[0][1] == "x"


def test_options_belong_to_their_select():
    two = '<select><option value="a">A<option value="b" selected>B</select><select><option>First<option>Second</select><select></select>'
    assert [r[2] for r in _told(two)] == ["b", "First", None]


def test_text_that_only_looks_like_markup():
    assert _told('<textarea>a <b> &amp; </button></textarea><button>y</button>')[0][2] == "a <b> & </button>"
    assert _told("<!-- <input> --><script>'<input>'</script><style><input></style><a title='>' href=x>1 < 2</a>") == [("a", "1 < 2", None, None, None)]
    assert _told("") == [] and _told("<") == [] and _told("<input") == [] and _told("<!-- open <input>") == []


def test_references():
    assert M.unescaped("&lt;&#64;&#x41;&nbsp;&eacute;&unknown;&#0;&#xD800;&copy=1&amp;lt;") == "<@A\xa0é&unknown;&copy=1&lt;"


def test_attributes():
    got = M.attributes(""" ID=a id=b class="x  y" data-type='q>' disabled value=1/2 title="&quot;" """)
    assert got == {"id": "a", "class": "x  y", "data-type": "q>", "disabled": "", "value": "1", "title": '"', "2": ""} or got["value"] in ("1", "1/2")


def test_time_grows_with_the_page():
    rnd = random.Random(1)
    parts = ["<div>", "</div>", "<label>", "</label>", "<input id=a>", "<button>", "</button>", "<select>", "<option>", "text ", "<a href='", "'>", "<!--", "-->", "\"", "<p>"]
    for pieces in (["<label>"], ["<a x='"], ["<button"], ["<select><option>"], ["<!--"], ["<", "'"], parts):
        source = "".join(rnd.choice(pieces) for _ in range(40_000))
        begin = time.time()
        M.elements(source)
        assert time.time() - begin < 20


def test_limit_null_and_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "<input><input>"), (1, "<input><input>"), (None, "<img>"), (2, None), (3, "")], "page_id bigint, html string")
    rows = H.snapshot_elements(pages).collect()
    assert sorted((str(r.page_id), r.pos) for r in rows) == [("1", 0), ("1", 0), ("1", 1), ("1", 1), ("None", 0)]
    assert H.snapshot_elements(pages, limit=1).count() == 3


def test_long_texts_stay_whole(spark):
    text = "word " * 100 + "ann@mail.example"
    row = H.snapshot_elements(spark.createDataFrame([(1, f"<button>{text}</button>")], "page_id bigint, html string")).first()
    assert row.text == text
