import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import geometry as G
from veilspark.functions import raster as R
from veilspark.operators import images as I

DET = f"image_id bigint, pos bigint, box {G.BOX}, confidence double, pii_type string, mode string"


def oval(w, h):
    y, x = np.mgrid[0:h, 0:w]
    img = np.empty((h, w, 4), dtype=np.uint8)
    img[...] = (15, 23, 42, 255)
    img[((x - w / 2) / (w * 0.35)) ** 2 + ((y - h / 2) / (h * 0.42)) ** 2 < 1] = (232, 181, 140, 255)
    return img


def frame(spark, *images):
    return spark.createDataFrame([(i, a.shape[1], a.shape[0], bytearray(a.tobytes())) for i, a in enumerate(images)], I.IMAGE)


def detections(spark, *rows):
    return spark.createDataFrame([(i, p, tuple(map(float, b)), c, "face", m) for i, p, b, c, m in rows], DET)


def test_face_and_no_face(spark):
    dark = np.full((100, 100, 4), (20, 26, 40, 255), dtype=np.uint8)
    rows = I.faces(frame(spark, oval(200, 200), dark)).collect()
    assert [r.image_id for r in rows] == [0]
    assert rows[0].box.width > 80 and rows[0].box.height > 100 and (rows[0].pii_type, rows[0].mode) == ("face", "blur")


def test_model_tier_and_fallback(spark):
    images = frame(spark, oval(200, 200))

    def model():
        return lambda image: [(1, 2, 30, 40, 0.7)]

    def broken():
        raise RuntimeError("no model file")

    def silent():
        return lambda image: []

    assert [(r.tier, r.source, r.box.width) for r in I.face_candidates(images, load_model=model).collect()] == [("model", "vision-model", 30.0)]
    for load in (broken, silent, None):
        assert [r.tier for r in I.face_candidates(images, load_model=load).collect()] == ["heuristic"]
    assert I.face_candidates(images, load_model=broken).first().failure == "RuntimeError: no model file"
    assert I.face_candidates(images, load_model=model).first().failure is None


def test_screenshot_figures(spark):
    shots = frame(spark, np.zeros((16, 24, 4), np.uint8), np.full((16, 24, 4), 200, np.uint8))
    rows = I.to_pam(shots).select(F.col("image_id").cast("string").alias("k"), F.base64("pam").alias("shot")).collect()
    odd = [("none", None), ("empty", ""), ("text", "not base64 at all! " * 20), ("broken", "QUJD" * 50)]
    df = spark.createDataFrame([(r.k, r.shot) for r in rows] + odd, "k string, shot string")
    got = {r.k: r.screenshot for r in I.screenshot_stats(df, "shot").collect()}
    assert (got["0"].present, got["0"].width, got["0"].height, got["0"].black_ratio, got["0"].problem) == (True, 24, 16, 1.0, None)
    assert got["1"].black_ratio == 0.0
    assert not got["none"].present and not got["empty"].present and got["empty"].problem is None
    assert got["text"].present and got["text"].problem == "not base64" and got["broken"].problem is not None


def test_blackout_blur_merge_and_negative_control(spark):
    images = frame(spark, oval(120, 120), oval(200, 200), oval(200, 200), oval(50, 50))
    found = detections(spark, (0, 0, (20, 20, 60, 40), 0.9, "blackout"), (1, 0, (30, 30, 140, 140), 0.9, "blur"),
                       (2, 0, (40, 40, 120, 120), 0.9, "blur"), (2, 1, (70, 70, 60, 60), 0.7, "blur"))
    applied = I.applied_boxes(images, found)
    out = {r.image_id: r for r in I.redact_images(images, applied).collect()}
    first = R.decode(bytes(out[0].data), 120, 120)
    assert tuple(first[40, 50]) == (0, 0, 0, 255) and tuple(first[100, 60]) == tuple(oval(120, 120)[100, 60])
    assert all(out[i].verified for i in range(4))
    assert (out[0].blackouts, out[1].blurs, out[2].boxes) == (1, 1, 1)
    assert out[3].boxes == 0 and out[3].checked == 0 and bytes(out[3].data) == oval(50, 50).tobytes()
    box = tuple(int(v) for v in applied.filter("image_id = 1").first().box)
    block = applied.filter("image_id = 1").first().block
    assert not R.is_destroyed(oval(200, 200), box, "blur", block)  # an untouched image must fail
    assert not R.is_destroyed(oval(120, 120), (16, 16, 68, 48), "blackout", None)


def naive_components(mask):
    seen, out = set(), []
    h, w = mask.shape
    for y in range(h):
        for x in range(w):
            if mask[y, x] and (y, x) not in seen:
                todo, cells = [(y, x)], []
                seen.add((y, x))
                while todo:
                    cy, cx = todo.pop()
                    cells.append((cy, cx))
                    for ny, nx in ((cy + 1, cx), (cy - 1, cx), (cy, cx + 1), (cy, cx - 1)):
                        if 0 <= ny < h and 0 <= nx < w and mask[ny, nx] and (ny, nx) not in seen:
                            seen.add((ny, nx))
                            todo.append((ny, nx))
                ys, xs = zip(*cells)
                out.append((min(xs), min(ys), max(xs), max(ys), len(cells)))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_components_and_dilation(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((rng.integers(1, 25), rng.integers(1, 25))) < 0.45
    assert R.components(mask) == naive_components(mask)
    h, w = mask.shape
    want = np.array([[mask[max(0, y - 1):y + 2, max(0, x - 1):x + 2].any() for x in range(w)] for y in range(h)])
    assert (R.dilate(mask) == want).all()


@pytest.mark.parametrize("seed", range(4))
def test_pixelate_and_blur_against_loops(seed):
    rng = np.random.default_rng(seed)
    img = rng.integers(0, 256, (40, 50, 4), dtype=np.uint8)
    box, block, radius = (3, 5, 31, 27), 7, 2
    x0, y0, w, h = box
    want = img.astype(int)
    for by in range(y0, y0 + h, block):
        for bx in range(x0, x0 + w, block):
            part = want[by:min(by + block, y0 + h), bx:min(bx + block, x0 + w), :3]
            part[...] = np.floor(part.reshape(-1, 3).mean(axis=0) + 0.5)
    got = img.copy()
    R.pixelate(got, box, block)
    assert (got[..., :3] == want[..., :3]).all()
    for _ in range(2):
        tmp = np.zeros((h, w, 3), dtype=np.float32)
        for y in range(h):
            for x in range(w):
                tmp[y, x] = sum(want[y0 + y, x0 + min(max(x + k, 0), w - 1), :3] for k in range(-radius, radius + 1)) / (2 * radius + 1)
        for y in range(h):
            for x in range(w):
                s = sum(tmp[min(max(y + k, 0), h - 1), x].astype(np.float64) for k in range(-radius, radius + 1))
                want[y0 + y, x0 + x, :3] = np.floor(s / (2 * radius + 1) + 0.5)
    R.blur(got, box, radius)
    assert (got[..., :3] == want[..., :3]).all()


def test_mutation_black_share_and_data_url(spark):
    a = oval(64, 64)
    b = a.copy()
    R.blackout(b, (16, 16, 32, 32))
    assert R.mutation(a, a, (0, 0, 64, 64)) == 0 and R.mutation(a, b, (16, 16, 32, 32)) > 20
    assert R.black_share(b) == 16 / 64
    df = I.to_data_url(frame(spark, a), "data", "image/png")
    assert df.first().url.startswith("data:image/png;base64,")
    assert I.from_data_url(df, "url", "copy").filter(F.col("copy") == F.col("data")).count() == 1


def test_whole_step_blocks_what_is_not_verified(spark):
    from veilspark.operators.flow import audit_sent, run_step
    from tests.test_forms import table

    pages = [dict(tag="input", type="email", selector="#e", label="Email", value="ana@example.com", rect=(20, 20, 60, 20)),
             dict(tag="input", type="text", selector="#n", label="Note", value="free text", rect=(20, 60, 60, 20))]
    rows = [dict(p, page_id=str(i), session_id=str(i), pos=k) for i in range(3) for k, p in enumerate(pages)]
    # page 2 repeats the value of its e-mail field in a place that is not a value
    rows[5] = dict(rows[5], label="Note for ana@example.com")
    elements = table(spark, rows).withColumn("page_id", F.col("page_id").cast("bigint")).withColumn("session_id", F.col("session_id").cast("bigint"))
    images = frame(spark, oval(160, 200), oval(160, 200), oval(160, 200)).filter("image_id <> 1")  # page 1 has no capture
    step = run_step(elements, images, (160.0, 200.0), F.lit("Fill the form"))
    got = {r.page_id: (r.status, r.detections, r.vault_leaks > 0) for r in step.verdicts.collect()}
    assert got[0] == ("sent", 2, False)
    assert got[1][0] == "unverified image"
    assert got[2][0] == "leak" and got[2][2]
    assert {r.page_id for r in step.payloads.collect()} == {0}
    assert audit_sent(step).count() == 0
    assert step.vault.filter("token = '[USER_EMAIL_1]'").count() == 3


def test_whole_step_neither_writes_nor_shuffles_pixels(spark, monkeypatch):
    import pyarrow as pa

    from veilspark.operators import flow
    from tests.test_forms import table

    pictures = {i: oval(160, 200).tobytes() for i in range(3)}

    def load(batch):
        return pa.array([pictures[i] for i in batch.column("image_id").to_pylist()], pa.binary())

    rows = [dict(tag="input", type="email", selector="#e", label="Email", value=f"ana{i}@example.com", rect=(20, 20, 60, 20), page_id=str(i), session_id="1", pos=0)
            for i in range(4)]
    elements = table(spark, rows).withColumn("page_id", F.col("page_id").cast("bigint")).withColumn("session_id", F.col("session_id").cast("bigint"))
    whole = frame(spark, *[oval(160, 200)] * 3)
    places = spark.createDataFrame([(i, 160, 200) for i in pictures], "image_id bigint, width int, height int")
    written, keep = [], flow.materialise
    monkeypatch.setattr(flow, "materialise", lambda df, purpose: (written.append((purpose, df)), keep(df, purpose))[1])
    steps = [flow.run_step(elements, images, (160.0, 200.0), F.lit("Fill the form"), opened)
             for images, opened in ((places, load), (whole, None))]
    told = [{(r.page_id, r.status, r.detections, r.boxes, r.verified) for r in s.verdicts.collect()} for s in steps]
    assert told[0] == told[1] and len(told[0]) == 4 and {r[1] for r in told[0]} == {"sent", "unverified image"}
    assert all("binary" not in {t for _, t in df.dtypes} for _, df in written)
    with_load = [df for purpose, df in written if purpose == "verified"][0]
    assert "data#" not in with_load._jdf.queryExecution().optimizedPlan().toString()
    images = [{r.image_id: (bytes(r.data), r.boxes, r.verified) for r in s.images.collect()} for s in steps]
    assert images[0] == images[1] and all(ok and data != pictures[i] for i, (data, _, ok) in images[0].items())
    assert [{(r.page_id, r.value) for r in s.sanitised.collect()} for s in steps] == [{(i, f"[USER_EMAIL_{i + 1}]") for i in range(4)}] * 2


def test_images_of_a_batch_are_redacted_together(spark):
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 256, (h, w, 4), dtype=np.uint8) for w, h in [(40, 30), (64, 48), (40, 30), (40, 30), (9, 8)]]
    boxes = {0: [((2, 3, 20, 18), "blur", 6), ((10, 9, 25, 20), "blackout", None), ((5, 5, 20, 18), "blur", 6)], 1: [((0, 0, 64, 48), "blur", 9)],
             2: [((2, 4, 20, 18), "blur", 6), ((1, 1, 1, 9), "blackout", None)], 4: [((3, 1, 6, 7), "blackout", None)]}
    rows = [
        (i, n, tuple(map(float, b)), mode, block, "name") for i, of in boxes.items() for n, (b, mode, block) in enumerate(of)
    ]
    applied = spark.createDataFrame(rows, f"image_id bigint, grp int, box {G.BOX}, mode string, block int, pii_type string")
    got = {r.image_id: r for r in I.redact_images(frame(spark, *images).coalesce(1), applied, black=True).collect()}
    sure = {r.image_id: (r.checked, r.verified) for r in I.verify_images(frame(spark, *images), applied).collect()}
    for i, before in enumerate(images):
        after, of = before.copy(), boxes.get(i, [])
        for box, mode, block in of:
            R.destroy(after, box, mode, block)
        big = [(b, m, n) for b, m, n in of if min(b[2:]) >= 2]
        changes = [R.mutation(before, after, b) for b, _, _ in of]
        r = got[i]
        assert (bytes(r.data), r.boxes, r.blackouts) == (after.tobytes(), len(of), sum(m == "blackout" for _, m, _ in of))
        assert (r.checked, r.verified) == (len(big), all(R.is_destroyed(after, *b) for b in big))
        assert sure[i] == (len(big), all(R.is_destroyed(before, *b) for b in big))
        assert r.least_change == (pytest.approx(min(changes)) if changes else None)
        assert r.black_share == pytest.approx(R.black_share(after))


def test_faces_of_a_stack_are_those_of_each_image():
    images = np.stack([np.roll(oval(120, 100), s, axis=1) for s in (0, 17, 60)])
    at, boxes, confidence = R.face_stack(images)
    for i, image in enumerate(images):
        assert R.face_boxes(image) == [(*b, c) for n, b, c in zip(at, boxes.tolist(), confidence.tolist()) if n == i]
