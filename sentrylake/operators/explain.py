"""Ranking of contributions and the rule-based triage of an alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import risk_level

# The indicator columns, the actions and the text of the triage.
IOC_COLUMNS = [
    ("source.ip", "source_ip"),
    ("destination.ip", "destination_ip"),
    ("host.name", "host_name"),
    ("user.name", "user_name"),
    ("process.name", "process_name"),
]
ACTIONS = [
    "Review correlated events in the provided context.",
    "Verify account activity and process tree.",
    "Isolate endpoint if needed; rotate credentials.",
]
MARKDOWN = (
    "# AI Alert Analysis\n\n"
    "- Time: %s\n"
    "- Score: %.4f\n"
    "- Risk: %s\n"
    "- Key contributors: %s\n\n"
    "## Observations\n"
    "- Host: %s, User: %s\n"
    "- SrcIP: %s, DstIP: %s\n\n"
    "## Recommended actions\n"
    "- Triage related events ±5m.\n"
    "- Validate user/session and process lineage.\n"
    "- Contain host if malicious indicators confirmed.\n"
)


def top_features(values: dict[str, Column], k: int = 5) -> Column:
    """``array<struct<feature,value>>``: the ``k`` largest by absolute value, ties in given order."""
    ranked = F.sort_array(
        F.array(
            *[
                F.struct(
                    (-F.abs(value)).alias("size"), F.lit(i).alias("i"), F.lit(name).alias("feature"),
                    value.alias("value"),
                )
                for i, (name, value) in enumerate(values.items())
            ]
        )
    )
    return F.transform(F.slice(ranked, 1, k), lambda x: F.struct(x["feature"], x["value"]))


def explain_by_size(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Add ``top_features`` by absolute value of the row itself, and the ``note`` that says so."""
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    return df.withColumn("top_features", top_features(values, k)).withColumn("note", F.lit("fallback_no_shap"))


def reason_text(features: Column) -> Column:
    """``name(+0.123), ...`` for up to five features."""
    parts = F.transform(F.slice(features, 1, 5), lambda x: F.format_string("%s(%+.3f)", x["feature"], x["value"]))
    return F.array_join(parts, ", ")


def triage(
    alerts: DataFrame, score: str = "anom_score", created_at: str | None = None,
    high: float = 0.95, medium: float = 0.85,
) -> DataFrame:
    """Add ``risk_level``, ``reason``, ``iocs``, ``actions``, ``markdown`` (and ``created_at``).

    Expects ``top_features``. The run's time is an argument, so a rerun gives the same rows.
    """
    present = [(name, c) for name, c in IOC_COLUMNS if c in alerts.columns]
    iocs = F.filter(
        F.array(*[F.struct(F.lit(name).alias("type"), F.col(c).alias("value")) for name, c in present]),
        lambda x: x["value"] != "",
    )
    shown = F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSSxxx")

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("None"))

    out = alerts.withColumn("risk_level", risk_level(F.col(score), high, medium)).withColumn(
        "reason", reason_text(F.col("top_features"))
    )
    reason = F.when(F.col("reason") != "", F.col("reason")).otherwise("n/a")
    markdown = F.format_string(
        MARKDOWN, shown, F.col(score), F.col("risk_level"), reason,
        text("host_name"), text("user_name"), text("source_ip"), text("destination_ip"),
    )
    return out.withColumns(
        {
            "iocs": iocs,
            "actions": F.array(*[F.lit(a) for a in ACTIONS]),
            "markdown": markdown,
            "created_at": F.lit(created_at).cast("string"),
        }
    )
