"""Which handler fires for an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hawkframe.functions.decisions import auth_failure, high_volume, suspicious_powershell


def detections() -> Column:
    """Names of the detections that fire on a row of the united event frame."""
    kind = F.col("event_type")
    named = [
        ("high_volume_connection", (kind == "network") & high_volume(F.col("bytes_sent"))),
        (
            "suspicious_powershell_execution",
            (kind == "endpoint") & suspicious_powershell(F.col("process_name"), F.col("command_line")),
        ),
        ("authentication_failure", (kind == "application") & auth_failure(F.col("message"))),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named]), lambda x: x.isNotNull())
