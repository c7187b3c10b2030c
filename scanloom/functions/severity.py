"""The two severity scales, their order, and the weights of the risk score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scales in order of gravity, and the weight of each level.
FINDING_LEVELS = ["critical", "high", "medium", "low", "info"]
RULE_LEVELS = ["ERROR", "WARNING", "INFO"]
WEIGHTS = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2, "info": 0.1}

# How rule levels map to finding levels is this library's choice.
RULE_TO_FINDING = {"ERROR": "high", "WARNING": "medium", "INFO": "info"}


def finding_level(severity: Column) -> Column:
    """A severity of either scale on the finding scale; others stay as they are."""
    out = severity
    for rule, finding in RULE_TO_FINDING.items():
        out = F.when(severity == rule, F.lit(finding)).otherwise(out)
    return out


def rank(severity: Column) -> Column:
    """1 for critical up to 5 for info; NULL for a level of neither scale."""
    level = finding_level(severity)
    out = F.lit(None).cast("int")
    for i, name in enumerate(FINDING_LEVELS, 1):
        out = F.when(level == name, F.lit(i)).otherwise(out)
    return out


def at_least(severity: Column, threshold: str) -> Column:
    """True where a severity is as grave as ``threshold`` or graver."""
    level = RULE_TO_FINDING.get(threshold, threshold)
    return rank(severity) <= FINDING_LEVELS.index(level) + 1
