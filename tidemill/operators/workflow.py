"""The attachment workflow: steps that patch a task's state, each a projection.

A step is a function from the state's columns to a patch, a mapping of columns to
new values; null leaves a column as it was.  Every step names itself in
``current_step``, and the names are kept in ``steps``.  Tasks move through all
steps in one pass without a shuffle; recognition is tried up to ``attempts`` times,
and what fails every time, or may not be let in, is quarantined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attachments, drafts

Step = Callable[[], dict[str, Column]]

# Names of steps and messages, types that are recognized from the picture.
IMAGES = ["image/png", "image/jpeg", "image/gif", "image/bmp", "image/tiff"]
ATTEMPTS = 3
CONFIDENCE = 0.85

_STATE = {
    "current_step": "string", "error_message": "string", "needs_ocr": "boolean", "extracted_text": "string", "ocr_text": "string", "ocr_confidence": "double",
    "attempts": "int", "storage_key": "string", "compliance_checks": "array<string>", "quarantined": "boolean",
}


def apply(state: DataFrame, step: Step) -> DataFrame:
    """``state`` after a step: the last value that is not null stands."""
    patch = step()
    unknown = set(patch) - set(_STATE)
    if unknown:
        raise ValueError(f"a patch may not set {sorted(unknown)}")
    new = {c: F.coalesce(v.cast(_STATE[c]), F.col(c)) for c, v in patch.items()}
    return state.withColumns(new).withColumn("steps", F.concat("steps", F.array(F.col("current_step"))))


def _closed() -> Column:
    return F.coalesce(F.col("quarantined"), F.lit(False))


def _text() -> Column:
    return F.coalesce(F.nullif(F.col("ocr_text"), F.lit("")), F.nullif(F.col("extracted_text"), F.lit("")))


def mine(allowed: list[str], largest: int) -> Step:
    def step():
        kind = F.coalesce(F.col("mimetype").isin(allowed), F.lit(False))
        small = F.coalesce(F.col("size_bytes") <= largest, F.lit(False))
        return {
            "current_step": F.when(kind & small, "attachment_validated").otherwise("attachment_rejected"),
            "error_message": F.when(~kind, F.concat(F.lit("Unsupported mimetype: "), F.coalesce("mimetype", F.lit("none")))).when(~small, "Invalid attachment"),
            "needs_ocr": F.when(kind & small, F.col("mimetype").isin(IMAGES)),
            "quarantined": F.when(~(kind & small), True),
        }

    return step


def extract() -> dict[str, Column]:
    """``native_text`` is what the extractor of the type read; null if it failed."""
    poor = attachments.needs_ocr(F.col("native_text").isNotNull(), F.col("native_text"))
    read = ~_closed() & ~F.col("needs_ocr") & ~poor
    return {
        "current_step": F.when(_closed(), "extraction_skipped").when(F.col("needs_ocr"), "ocr_required").when(poor, "ocr_fallback").otherwise("text_extracted"),
        "extracted_text": F.when(read, F.col("native_text")),
        "needs_ocr": F.when(~_closed() & ~F.col("needs_ocr") & poor, True),
    }


def decide() -> dict[str, Column]:
    return {"current_step": F.when(~_closed() & F.col("needs_ocr"), "ocr_required").otherwise("ocr_not_needed")}


def recognize(ocr: Callable[[Column], Column], attempts: int) -> Step:
    """``ocr`` tells the text of attempt number n, null if it fails."""

    def step():
        wanted = ~_closed() & F.col("needs_ocr")
        tries = [ocr(F.lit(n)) for n in range(1, attempts + 1)]
        text = F.coalesce(*tries)
        used = F.coalesce(*[F.when(x.isNotNull(), n) for n, x in enumerate(tries, 1)], F.lit(attempts))
        failed = wanted & text.isNull()
        return {
            "current_step": F.when(~wanted, "ocr_skipped").when(failed, "ocr_failed").otherwise("ocr_completed"),
            "ocr_text": F.when(wanted, text),
            "ocr_confidence": F.when(wanted & text.isNotNull(), CONFIDENCE),
            "attempts": F.when(wanted, used),
            "error_message": F.when(failed, "OCR failed"),
            "quarantined": F.when(failed, True),
        }

    return step


def store() -> dict[str, Column]:
    key = F.concat_ws("/", "tenant_id", F.lit("emails"), "email_id", F.lit("attachments"), "filename", F.lit("text"))
    return {"current_step": F.when(_text().isNull(), "storage_skipped").otherwise("storage_completed"), "storage_key": F.when(_text().isNotNull(), key)}


def guard() -> dict[str, Column]:
    return {"current_step": F.when(_text().isNull(), "compliance_skipped").otherwise("compliance_checked"), "compliance_checks": F.when(_text().isNotNull(), drafts.ocr_compliance(_text()))}


def audit() -> dict[str, Column]:
    status = attachments.final_status(F.coalesce("error_message", F.lit("")), F.coalesce(_text(), F.lit("")))
    return {"current_step": F.concat(F.lit("workflow_"), status)}


def process(tasks: DataFrame, ocr: Callable[[Column], Column], attempts: int = ATTEMPTS, allowed: list[str] | None = None, largest: int = attachments.LARGEST) -> DataFrame:
    """The final state of each task: tenant_id, email_id, filename, mimetype, size_bytes, native_text and the state's columns.

    Other columns of ``tasks`` stay.  A null type or size is not let in; a null or
    blank text is read by ``ocr``; rows that repeat are processed as often.
    """
    state = tasks.withColumns({c: F.lit(None).cast(k) for c, k in _STATE.items()}).withColumn("steps", F.array().cast("array<string>"))
    for step in (mine(allowed or attachments.ALLOWED, largest), extract, decide, recognize(ocr, attempts), store, guard, audit):
        state = apply(state, step)
    return state.withColumn("quarantined", _closed())


def outcome(state: DataFrame) -> DataFrame:
    """What a caller is told: success, text, needs_ocr, error, quarantined."""
    return state.select(
        "tenant_id", "email_id", "filename", (F.col("current_step") == "workflow_completed").alias("success"), _text().alias("text"), F.coalesce("needs_ocr", F.lit(False)).alias("needs_ocr"), F.col("error_message").alias("error"), "quarantined"
    )
