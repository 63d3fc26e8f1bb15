"""One perception step for any number of pages, from elements and images to a
verdict per page.  Whatever fails a check is blocked and sends nothing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import patterns as P
from veilspark.operators import boxes as B
from veilspark.operators import classify as C
from veilspark.operators import images as I
from veilspark.operators import scan as S
from veilspark.operators import vault as V
from veilspark.operators.containment import containment
from veilspark.operators.ranking import running_total
from veilspark.session import WORK_ROWS, grows, materialise, spread, tasks


@dataclass
class Step:
    detections: DataFrame
    applied: DataFrame
    images: DataFrame
    sanitised: DataFrame
    vault: DataFrame
    payloads: DataFrame
    verdicts: DataFrame


ELEMENT_ROWS = 10 * WORK_ROWS
"""Elements to a task that makes payloads and scans them."""


def payload_bodies(sanitised: DataFrame, task: Column, also: Sequence[str] = ()) -> DataFrame:
    """Serialised payload per page; the elements of one page form one row. ``also``: columns of the page to keep."""
    # Texts are whole up to here, for detection and audit; a payload carries their beginnings.
    text, label = (F.substring(c, 1, n).alias(c) for c, n in (("text", fixed.TEXT_CHARS), ("label", fixed.LABEL_CHARS)))
    element = F.struct(
        "pos", "tag", "type", "id", "name", "selector", text, label, "aria_label", "autocomplete", "role", "value"
    )
    grouped = sanitised.groupBy("session_id", "page_id", "step", *also).agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), element))).alias("dom_elements")
    )
    body = F.struct(
        task.alias("task"),
        "dom_elements",
        F.col("step").alias("step_index"),
        F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("session_id"),
    )
    return grouped.select(
        "session_id", "page_id", "step", *also, F.to_json(body, {"ignoreNullFields": "false"}).alias("body")
    )


def shown_values(payloads: DataFrame, registered: DataFrame, least: int = fixed.MIN_PROTECTED_CHARS) -> DataFrame:
    """Raw values a payload shows although its session had registered them by that step: (session_id, page_id, step,
    raw_value, known_from, token).

    ``registered``: session_id, token, step, pos, raw_value. A value may have been registered many times; the search
    runs on distinct values, each with its first token.
    """
    values = materialise(
        registered.groupBy("session_id", "raw_value").agg(
            F.min("step").alias("known_from"), F.min_by("token", F.struct("step", "pos")).alias("token")
        ),
        "vault",
    )
    return containment(
        spread(payloads, "session_id", "page_id"), ["session_id", "page_id", "step"], "body", values, ["session_id", "token", "known_from"], "raw_value",
        scope=["session_id"], least=least, since=("known_from", "step"),
    )


def vault_leaks(payloads: DataFrame, tokenised: DataFrame, least: int = fixed.MIN_PROTECTED_CHARS) -> DataFrame:
    """Raw values a payload shows although its session had registered them by
    that step: (session_id, page_id, step, raw_value, token, tokens).

    How many tokens a value had by the step of the payload is a running total over
    its registrations, so registrations and payloads of a busy session are never
    paired; registrations of values that no payload shows are left out of it. Values
    under ``least`` characters are not looked for (``containment.too_short`` counts
    them per session).
    """
    registered = tokenised.filter(F.coalesce("value", F.lit("")) != "").select(
        "session_id", "token", "step", "pos", F.col("value").alias("raw_value")
    )
    leaks = materialise(shown_values(payloads, registered, least), "leaks")
    shown = grows(registered).join(grows(leaks.select("session_id", "raw_value")), ["session_id", "raw_value"], "left_semi")
    timeline = leaks.select(
        "session_id", "raw_value", "page_id", "step", "token", F.lit(1).alias("after"), F.lit(0).alias("amount")
    ).unionByName(
        shown.select(
            "session_id", "raw_value", F.lit(None).cast(leaks.schema["page_id"].dataType).alias("page_id"), "step", "token",
            F.lit(0).alias("after"), F.lit(1).alias("amount"),
        )
    )
    counted = running_total(
        timeline, ["session_id", "raw_value"], F.floor(F.col("step") / V.STEP_BUCKET), ["step", "after"], F.col("amount"), "tokens"
    )
    return counted.filter(F.col("after") == 1).drop("after", "amount")


_CARRIED = (
    "session_id", "page_id", "step", "pos", "tag", "type", "id", "name", "selector", "text", "label", "aria_label", "autocomplete", "role", "value",
)


def run_step(elements: DataFrame, images: DataFrame, viewport: tuple[float, float], task: Column, load: I.Load | None = None) -> Step:
    """``elements`` (page_id, session_id, step, pos, ...), ``images`` keyed by
    ``image_id`` = page_id, of any capture size; with ``load`` they are references,
    and pixels are opened where they are read and never shuffled.

    Only what several branches read is written. The redacted images and the sanitised
    elements are made as they are read; each image has the verdict on its own pixels.
    """
    tagged = materialise(V.attach_detection(C.with_detection(elements), ["page_id"]), "tagged")
    dom = C.detections(tagged.drop("hit"), "page_id").select(
        F.col("page_id").alias("image_id"), F.col("pos").cast("long").alias("pos"), "box", "confidence", "pii_type", "mode"
    )
    frames = images.select(
        "image_id", F.col("width").cast("double").alias("image_width"), F.col("height").cast("double").alias("image_height"),
        F.lit(viewport[0]).alias("viewport_width"), F.lit(viewport[1]).alias("viewport_height"),
    )
    in_pixels = B.fused(dom, frames, "image_id").select(*dom.columns)
    vision = I.faces(images, load=load).select("image_id", (F.col("pos") + 1_000_000).alias("pos"), *dom.columns[2:])
    every = materialise(in_pixels.unionByName(vision), "detections")
    applied = I.applied_boxes(images, every)
    verified = materialise(
        I.redact_images(images, applied, change=False, load=load, pixels=False).select("image_id", "boxes", "verified"), "verified"
    )

    # What payloads do not carry is not shuffled to be numbered.
    carried = tagged.select(*_CARRIED, F.when(F.col("hit").isNotNull(), F.struct("hit.token_kind")).alias("hit"))
    tokenised = materialise(V.tokens(carried), "tokens")  # read for the payloads and for the vault
    sanitised = V.sanitised_elements(carried, tokenised).repartition(tasks(tagged, ELEMENT_ROWS), "page_id")
    payloads = materialise(P.count_leaks(payload_bodies(sanitised, task), "body", "pattern_leaks"), "payloads")
    leaks = vault_leaks(payloads, tokenised).groupBy("page_id").agg(F.sum("tokens").alias("vault_leaks"))
    counted = every.groupBy(F.col("image_id").alias("page_id")).agg(F.count("*").alias("detections"))
    verdicts = (
        grows(payloads.drop("body"))
        .join(verified.select(F.col("image_id").alias("page_id"), "boxes", "verified"), "page_id", "left")
        .join(grows(leaks), "page_id", "left")
        .join(grows(counted), "page_id", "left")
        .na.fill(0, ["vault_leaks", "detections", "boxes"])
        .withColumn(
            "status",
            F.when(~F.coalesce("verified", F.lit(False)), "unverified image")
            .when((F.col("vault_leaks") > 0) | (F.col("pattern_leaks") > 0), "leak")
            .otherwise("sent"),
        )
    )
    sent = payloads.drop("pattern_leaks").join(verdicts.filter(F.col("status") == "sent").select("page_id"), "page_id", "left_semi")
    redacted = I.redact_images(images, applied, change=False, load=load)
    return Step(every, applied, redacted, V.sanitised_elements(tagged, V.tokens(tagged)), V.vault_rows(tokenised), sent, verdicts)


def audit_sent(step: Step) -> DataFrame:
    """Independent re-scan of what was sent: pattern findings per payload body."""
    return S.pattern_leaks(step.payloads, "body", ["page_id"])
