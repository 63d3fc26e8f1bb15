import base64
import hashlib
import random
import zlib

from veilspark.llm import warc


def _page(key, payload=b"p" * 50, first=None):
    return warc.page_record(key, payload, hashlib.sha256(payload).hexdigest(), first)


def _kinds(data):
    return [("gap", x.start, x.end) if isinstance(x, warc.Gap) else x.headers["warc-target-uri"] for x in warc.salvage(data, partial=False)]


def test_reads_members_and_plain_records():
    parts = [warc.member(_page(1)), _page(2), warc.member(_page(3))]
    assert _kinds(b"".join(parts)) == ["urn:page:1", "urn:page:2", "urn:page:3"]
    assert _kinds(b"") == []


def test_salvages_after_damage():
    good = [warc.member(_page(k, bytes([65 + k]) * 3000)) for k in range(5)]
    flipped = bytearray(good[1])
    flipped[len(flipped) // 2] ^= 0xFF
    cut = good[3][: len(good[3]) // 2]
    data = good[0] + bytes(flipped) + good[2] + cut + b"noise" + good[4]
    a, b = len(good[0]), len(good[0]) + len(flipped)
    c = b + len(good[2])
    assert _kinds(data) == ["urn:page:0", ("gap", a, b), "urn:page:2", ("gap", c, c + len(cut) + 5), "urn:page:4"]


def test_salvages_plain_records():
    bad = _page(2).replace(b"pppp", b"pqpp", 1)
    data = b"junk" + _page(1) + bad + _page(3) + _page(4)[:-3]
    n = [len(_page(k)) for k in (1, 2, 3)]
    got = _kinds(data)
    assert got[0] == ("gap", 0, 4) and got[1] == "urn:page:1"
    assert got[2] == ("gap", 4 + n[0], 4 + n[0] + n[1]) and got[3] == "urn:page:3"
    assert got[4] == ("gap", 4 + sum(n), len(data))


def test_a_version_line_inside_a_broken_record():
    broken = _page(1, b"x" * 20 + _page(7) + b"y" * 20).replace(b"xx", b"xz", 1)
    assert "urn:page:7" in _kinds(broken) and _kinds(broken)[0][0] == "gap"
    whole = _page(1, b"x" * 20 + _page(7))
    assert _kinds(whole) == ["urn:page:1"]  # a record that passes hides what its block looks like


def test_extra_bytes_in_a_member():
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = pack.compress(_page(1) + b"more") + pack.flush()
    assert _kinds(data) == [("gap", 0, len(data))]


def test_round_trip_in_spark(spark, tmp_path):
    same = "<html>é" + "s" * 200
    rows = [(1, same), (2, same), (3, None), (4, ""), (5, "short"), (6, "short"), (7, "L" * 400_000), (None, "n"), (8, same), (8, same),
            (None, same)]
    pages = spark.createDataFrame([(k, h, "d") for k, h in rows], "page_id long, html string, digest string")
    folder = f"file:{tmp_path}/warc"
    manifest = warc.write(warc.with_originals(pages, "page_id", "html"), folder)
    assert manifest.selectExpr("sum(records)").first()[0] == len(rows)
    records = warc.digested(warc.read(spark, warc.archives(spark, f"{folder}/archives", manifest)))
    out = warc.pages_of(records).collect()
    got = sorted((r.address, r.type, r.refers_to or "", r.bytes, r.sha) for r in out)

    def row(k, h):
        body = (h or "").encode()
        revisit = h == same and k != 1
        key = "urn:page:" + ("" if k is None else str(k))
        # A row without a key that repeats a payload refers to the least key that has one.
        return (key, "revisit" if revisit else "response", "urn:page:1" if revisit else "", len(body), hashlib.sha256(body).hexdigest())

    assert got == sorted(row(k, h) if k is not None or h != same else
                         ("urn:page:", "revisit", "urn:page:1", len(same.encode()), hashlib.sha256(same.encode()).hexdigest()) for k, h in rows)


def test_files_outside_the_manifest_and_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a")], "page_id long, html string")
    folder = f"file:{tmp_path}/one"
    manifest = warc.write(warc.with_originals(pages, "page_id", "html"), folder)
    (tmp_path / "one/archives/lost.warc.gz").write_bytes(warc.member(_page(9)))
    assert warc.read(spark, warc.archives(spark, f"{folder}/archives", manifest)).count() == 1
    none = warc.write(warc.with_originals(pages.limit(0), "page_id", "html"), f"file:{tmp_path}/none")
    assert none.count() == 0


def _partial(data):
    return [("gap", x.start, x.end) if isinstance(x, warc.Gap) else x.headers["warc-target-uri"] for x in warc.salvage(data)]


def test_members_of_several_records():
    pages = [_page(k, bytes(range(256)) * 9 + hashlib.sha256(bytes([k])).digest() * 40) for k in range(6)]
    whole = warc.member(b"".join(pages[:4]))
    assert _kinds(whole + warc.member(pages[4])) == [f"urn:page:{k}" for k in range(5)]
    stray = warc.member(pages[0] + b"more")
    assert _partial(stray + whole) == ["urn:page:0", ("gap", 0, len(stray)), *(f"urn:page:{k}" for k in range(4))]
    middle = warc.member(pages[0] + b"more" + pages[1])
    assert _partial(middle) == ["urn:page:0", "urn:page:1", ("gap", 0, len(middle))]


def test_cut_and_broken_members_yield_their_whole_records(spark, tmp_path):
    rng = random.Random(0)
    pages = [_page(k, rng.randbytes(50_000)) for k in range(4)]
    whole = warc.member(b"".join(pages))
    cut = whole[: len(whole) - 20_000]
    assert _partial(cut) == ["urn:page:0", "urn:page:1", "urn:page:2", ("gap", 0, len(cut))]
    bad = whole[:-8] + b"\0" * 8  # the checksum alone is wrong; each record has passed its own digest
    last = warc.member(pages[3])
    got = _partial(bad + last)
    assert [x for x in got if x[0] != "gap"] == ["urn:page:0", "urn:page:1", "urn:page:2", "urn:page:3", "urn:page:3"]
    assert ("gap", 0, len(bad)) in got
    files = spark.createDataFrame([("f", cut)], "path string, content binary")
    assert sorted(str(r.address) for r in warc.read(spark, files).collect()) == ["None", "urn:page:0", "urn:page:1", "urn:page:2"]


def test_declared_digests_of_both_kinds():
    body = b"hello"

    def record(**headers):
        lines = ["WARC/1.0", "WARC-Type: resource", "WARC-Target-URI: x", *(f"WARC-{k}-Digest: {v}" for k, v in headers.items())]
        return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"

    sha1 = hashlib.sha1(body)
    for good in ("sha1:" + base64.b32encode(sha1.digest()).decode(), "sha1:" + sha1.hexdigest(), "md5:unknown"):
        for kind in ("Block", "Payload"):
            data = record(**{kind: good})
            assert _kinds(data) == ["x"]
            broken = data.replace(b"hello", b"hallo")
            assert _kinds(broken) == (["x"] if good.startswith("md5") else [("gap", 0, len(data))])
