"""What happens to records that can't be written: reported or raised, with as much detail as is allowed and no value in it."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrace.errors import InvalidRecord

LOG = logging.getLogger("retrace")
URL = re.compile(r"(?i)\b([a-z][a-z0-9+.-]*://)[^/@\s]+@")
QUOTED = re.compile(r"""(?<!\w)(["'`])(?:(?!\1).)*\1""")


def safe_message(error: BaseException, details: str = "cause") -> str:
    """none: the kind only; cause: the message without credentials and quoted values; full: without credentials."""
    if details == "none":
        return type(error).__name__
    text = URL.sub(r"\1***@", str(error))
    return f"{type(error).__name__}: {text if details == 'full' else QUOTED.sub('***', text)}"


def report(rejected: DataFrame, policy: str = "log", logger: logging.Logger = LOG) -> dict[str, int]:
    """Counts rejected records by reason, one aggregation; logs them, or raises if the policy is to throw."""
    counts = {r["reason"]: r["n"] for r in rejected.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    if counts and policy == "throw":
        raise InvalidRecord("; ".join(f"{n} records: {reason}" for reason, n in sorted(counts.items())))
    for reason, n in sorted(counts.items()):
        logger.warning("%d records were not written: %s", n, reason)
    return counts
