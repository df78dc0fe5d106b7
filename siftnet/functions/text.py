"""Scalar rules on texts, statuses and bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PERMANENT_STATUSES = [400, 401, 403, 404, 405, 409, 410, 422]
TRIGGERS = ["syslog", "poll", "manual"]
MASK_MARKS = ["config_masked_password", "ENC <removed>"]


def poll_error_class(message: Column) -> Column:
    text = F.coalesce(message, F.lit(""))
    return (
        F.when(text.contains("timeout"), "timeout")
        .when(text.contains("connection refused"), "conn_refused")
        .when(text.contains("no such host"), "dns")
        .when(text.contains("auth") | text.contains("community"), "auth")
        .otherwise("other")
    )


def upload_name(name: Column) -> tuple[Column, Column]:
    """(device id, trigger) from ``fgt_<id>_<trigger>_config`` or ``fgt_<id>_config``."""
    parts = F.split(name, "_")
    raw = F.get(parts, F.lit(1))
    number = F.when(raw.rlike("^[0-9]{1,10}$"), raw.try_cast("bigint"))
    device = F.when(number < (1 << 32), number)
    word = F.get(parts, F.lit(2))
    named = device.isNotNull() & (F.size(parts) >= 4) & word.isin(TRIGGERS)
    return F.coalesce(device, F.lit(0).cast("bigint")), F.when(named, word).otherwise("poll")


def backup_quality(config: Column) -> Column:
    masked = F.lit(False)
    for mark in MASK_MARKS:
        masked = masked | config.contains(mark)
    return F.when(masked, "masked").otherwise("full")


def config_checksum(config: Column) -> Column:
    return F.md5(config)


def config_token(config: Column) -> Column:
    return F.sha2(config, 256)


def content_key(payload: Column) -> Column:
    """First 32 hex digits of the payload's SHA-256."""
    return F.substring(F.sha2(payload, 256), 1, 32)


def schema_range(text: Column) -> tuple[Column, Column]:
    """(min, max) of ``min-max`` or ``N``; both null where the text does not parse or the range is reversed."""
    value = F.trim(text)
    dash = F.instr(value, "-")
    integer = r"^[+-]?[0-9]+$"

    def whole(part: Column) -> Column:
        return F.when(part.rlike(integer), part.try_cast("int"))

    low = F.when(dash > 0, whole(F.trim(F.substring(value, F.lit(1), dash - 1)))).otherwise(whole(value))
    high = F.when(dash > 0, whole(F.trim(F.substring(value, dash + 1, F.length(value))))).otherwise(whole(value))
    valid = low.isNotNull() & high.isNotNull() & (low <= high)
    return F.when(valid, low), F.when(valid, high)


def delivery_class(status: Column) -> Column:
    return F.when(status.isin(PERMANENT_STATUSES), "permanent").otherwise("transient")


def step_text() -> Column:
    """One apply step as hashed: five fields ended by NUL, NUL, NUL, NUL and a record separator."""
    nul = F.lit("\x00")
    parts: list[Column] = []
    for name in ("kind", "cli", "method", "path", "body"):
        parts += [F.coalesce(F.col(name), F.lit("")), nul]
    return F.concat(*parts[:-1], F.lit("\x1e"))


def step_checksum(step_no: Column, text: Column) -> Column:
    """Aggregate: SHA-256 over the steps of a plan in order. A plan is one change request, a bounded list."""
    ordered = F.array_sort(F.collect_list(F.struct(step_no.alias("n"), text.alias("t"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda s: s["t"]), ""), 256)


def version_from_status(body: Column) -> Column:
    """Version string out of a JSON status body, '' if there is none."""
    fields = F.from_json(body, "MAP<STRING, VARIANT>")

    def string_at(value: Column, path: str) -> Column:
        found = F.try_variant_get(value, path, "string")
        kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
        return F.when(kind == "STRING", found)

    def top(name: str) -> Column:
        return string_at(F.try_element_at(fields, F.lit(name)), "$")

    return F.coalesce(
        F.nullif(top("version"), F.lit("")),
        F.nullif(top("product_version"), F.lit("")),
        string_at(F.try_element_at(fields, F.lit("results")), "$.version"),
        string_at(F.try_element_at(fields, F.lit("product")), "$.product_version"),
        F.lit(""),
    )


def rows_match(body: Column, name: Column) -> tuple[Column, Column]:
    """(matched, parsed): whether any string field of the ``rows`` array equals the name."""
    parsed = F.from_json(body, "STRUCT<rows: ARRAY<MAP<STRING, VARIANT>>>")
    readable = body.rlike(r"^\s*\{") & parsed.isNotNull()

    def has(row: Column) -> Column:
        return F.exists(
            F.map_values(row),
            lambda v: F.coalesce((F.schema_of_variant(v) == "STRING") & (v.cast("string") == name), F.lit(False)),
        )

    hit = F.coalesce(F.exists(parsed["rows"], has), F.lit(False))
    return F.when(name == "", False).otherwise(readable & hit), (name == "") | readable
