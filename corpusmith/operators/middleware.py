"""Steps over texts that leave a trace: which were applied to a row, in which version and with which settings.

A step is a column expression, so a chain of any length is one projection. What was
applied to a row already, in the same version and with the same settings, is skipped, so a
chain that runs again changes nothing, and rows from different runs may stand
in one table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions import text as tx
from corpusmith.functions.sequential import config_hash

TRACE = "array<struct<name:string,version:string,config:string>>"


@dataclass(frozen=True)
class Step:
    """apply: from the text's column to the new text's, with the settings as named arguments."""

    name: str
    version: str
    apply: Callable[..., Column]
    settings: dict = field(default_factory=dict)

    def mark(self) -> Column:
        return F.struct(F.lit(self.name).alias("name"), F.lit(self.version).alias("version"), F.lit(config_hash(self.settings)).alias("config"))


CONTENTS = Step("contents", "1.0.0", tx.strip_toc)
LINKS = Step("links", "1.0.0", tx.clean_links)


def applied(rows: DataFrame, steps: list[Step], text: str = "text", trace: str = "trace") -> DataFrame:
    """rows with the steps applied to `text` in order and appended to `trace`, which is made where there is none. A null
    text stays null and is marked like others."""
    if trace not in rows.columns:
        rows = rows.withColumn(trace, F.array().cast(TRACE))
    for step in steps:
        known = F.array_contains(F.coalesce(trace, F.array().cast(TRACE)), step.mark())
        rows = rows.withColumn("__known", known)
        rows = rows.withColumns({
            text: F.when(F.col("__known"), F.col(text)).otherwise(step.apply(F.col(text), **step.settings)),
            trace: F.when(F.col("__known"), F.col(trace)).otherwise(F.concat(F.coalesce(trace, F.array().cast(TRACE)), F.array(step.mark()))),
        }).drop("__known")
    return rows


def digest(trace: str = "trace") -> Column:
    """One hash for all that was applied to a row, in order."""
    return F.sha2(F.array_join(F.transform(trace, lambda s: F.concat_ws(":", s["name"], s["version"], s["config"])), ";"), 256)
