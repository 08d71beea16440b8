"""Text and JSON columns for an alert row: colour, chat payload, e-mail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message texts, colours and formats that receivers rely on.
SEVERITY_COLOURS = {
    "low": "#36a64f",
    "medium": "#ff9500",
    "high": "#ff0000",
    "critical": "#8b0000",
}
DEFAULT_COLOUR = "#ff9500"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss 'UTC'"
TITLE_ICON = "\U0001f6a8 "
SUBJECT_PREFIX = "[Job alert] "
BLOCK_TYPE = (
    "STRUCT<type: STRING, text: STRUCT<type: STRING, text: STRING>,"
    " fields: ARRAY<STRUCT<type: STRING, text: STRING>>>"
)
NUMERIC_METADATA = ("rule_threshold", "health_score", "threshold", "anomaly_score", "cost_ratio")


def _blank_to(column: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), fallback)


def display_name(name: Column, job_id: Column) -> Column:
    """The job's name, or ``Job <id>`` when it has none."""
    return _blank_to(name, F.concat(F.lit("Job "), job_id))


def error_text(message: Column) -> Column:
    return _blank_to(message, F.lit("Unknown error"))


def severity_colour(severity: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SEVERITY_COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, severity), F.lit(DEFAULT_COLOUR))


def time_text(created_at: Column) -> Column:
    return F.date_format(created_at, TIME_FORMAT)


def _markdown(text: Column) -> Column:
    return F.struct(F.lit("mrkdwn").alias("type"), text.alias("text"))


def chat_payload(*, channel: str, username: str, icon_emoji: str) -> Column:
    """Chat message as JSON: header, text, job fields when a job is named, colour bar."""
    no_text = F.lit(None)
    header = F.struct(
        F.lit("header").alias("type"),
        F.struct(
            F.lit("plain_text").alias("type"),
            F.concat(F.lit(TITLE_ICON), F.col("title")).alias("text"),
        ).alias("text"),
        no_text.alias("fields"),
    ).cast(BLOCK_TYPE)
    body = F.struct(
        F.lit("section").alias("type"),
        _markdown(F.col("message")).alias("text"),
        no_text.alias("fields"),
    ).cast(BLOCK_TYPE)
    details = F.struct(
        F.lit("section").alias("type"),
        no_text.alias("text"),
        F.array(
            _markdown(F.concat(F.lit("*Job:* "), F.col("job_name"))),
            _markdown(F.concat(F.lit("*Severity:* "), F.upper("severity"))),
            _markdown(F.concat(F.lit("*Time:* "), time_text(F.col("created_at")))),
        ).alias("fields"),
    ).cast(BLOCK_TYPE)
    named = F.coalesce(F.col("job_name"), F.lit("")) != ""
    return F.to_json(
        F.struct(
            F.col("title").alias("text"),
            F.lit(channel).alias("channel"),
            F.lit(username).alias("username"),
            F.lit(icon_emoji).alias("icon_emoji"),
            F.when(named, F.array(header, body, details))
            .otherwise(F.array(header, body))
            .alias("blocks"),
            F.array(
                F.struct(
                    severity_colour(F.col("severity")).alias("color"),
                    F.array().cast("array<string>").alias("fields"),
                )
            ).alias("attachments"),
        )
    )


def metadata_text(metadata: Column) -> Column:
    """The metadata map as two-space indented JSON text, ``None`` when empty."""

    def line(entry: Column) -> Column:
        quoted = F.regexp_extract(F.to_json(F.array(entry["value"])), r"(?s)^\[(.*)\]$", 1)
        value = (
            F.when(entry["value"].isNull(), F.lit("null"))
            .when(entry["key"].isin(*NUMERIC_METADATA), entry["value"])
            .otherwise(quoted)
        )
        return F.concat(F.lit('  "'), entry["key"], F.lit('": '), value)

    lines = F.array_join(F.transform(F.map_entries(metadata), line), ",\n")
    return F.when(F.size(metadata) > 0, F.concat(F.lit("{\n"), lines, F.lit("\n}"))).otherwise(
        F.lit("None")
    )


def email_subject() -> Column:
    return F.concat(F.lit(SUBJECT_PREFIX), F.col("title"))


def email_body(heading: str = "Job alert") -> Column:
    """Plain e-mail text: one labelled line per alert field, then the metadata."""
    return F.concat_ws(
        "\n",
        F.lit(heading),
        F.lit(""),
        F.concat(F.lit("Title: "), F.col("title")),
        F.concat(F.lit("Severity: "), F.upper("severity")),
        F.concat(F.lit("Message: "), F.col("message")),
        F.concat(F.lit("Job: "), _blank_to(F.col("job_name"), F.lit("N/A"))),
        F.concat(F.lit("Time: "), time_text(F.col("created_at"))),
        F.lit(""),
        F.lit("Additional Details:"),
        metadata_text(F.col("metadata")),
    )
