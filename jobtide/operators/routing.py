"""Which channel gets which alert, and the text it gets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.alert_text import (
    chat_payload,
    email_body,
    email_subject,
    severity_colour,
)
from jobtide.operators.alerts import ALERT_COLUMNS, RULES, AlertRule


def _channels_of(kind: Column, rules: Mapping[str, AlertRule], configured: Sequence[str]) -> Column:
    def names(rule: AlertRule) -> Column:
        chosen = configured if rule.channels is None else rule.channels
        return F.array(*[F.lit(c) for c in chosen]).cast("array<string>")

    return F.coalesce(*[F.when(kind == k, names(r)) for k, r in rules.items()])


def route_alerts(
    alerts: DataFrame,
    configured: Sequence[str],
    rules: Mapping[str, AlertRule] = RULES,
) -> DataFrame:
    """One row per alert and channel; ``deliverable`` if the channel is configured.

    An alert of a kind without a rule, or of a rule without channels, has one row without channel.
    """
    channels = _channels_of(F.col("alert_type"), rules, configured)
    ready = F.array(*[F.lit(c) for c in configured]).cast("array<string>")
    return alerts.withColumn("channel", F.explode_outer(channels)).withColumn(
        "deliverable", F.coalesce(F.array_contains(ready, F.col("channel")), F.lit(False))
    )


def alert_payloads(
    alerts: DataFrame,
    *,
    channel: str = "#alerts",
    username: str = "alerts",
    icon_emoji: str = ":warning:",
    heading: str = "Job alert",
) -> DataFrame:
    """Colour, chat JSON, e-mail subject and body per alert, ready for a sender."""
    return alerts.select(
        "id",
        "alert_type",
        severity_colour(F.col("severity")).alias("colour"),
        chat_payload(channel=channel, username=username, icon_emoji=icon_emoji).alias(
            "chat_payload"
        ),
        email_subject().alias("email_subject"),
        email_body(heading).alias("email_body"),
    )


def alert_history(
    alerts: DataFrame,
    configured: Sequence[str],
    rules: Mapping[str, AlertRule] = RULES,
) -> DataFrame:
    """Alerts with the list of channels that can take them, for an append-only table.

    Where limits have marked alerts, the mark stays with them.
    """
    ready = F.array(*[F.lit(c) for c in configured]).cast("array<string>")
    wanted = _channels_of(F.col("alert_type"), rules, configured)
    return alerts.select(
        *ALERT_COLUMNS,
        *(c for c in ("suppressed_by",) if c in alerts.columns),
        F.array_sort(F.array_intersect(wanted, ready)).alias("channels_sent"),
    )
