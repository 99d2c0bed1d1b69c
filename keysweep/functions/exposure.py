"""Wording of how long a secret was exposed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keysweep.functions.paths import short_commit


def exposure_window(commits: Column, still_present: Column, removed_commit: Column) -> Column:
    unit = F.when(commits == 1, F.lit("commit")).otherwise(F.lit("commits"))
    text = F.concat(F.lit("Exposed for "), commits.cast("string"), F.lit(" "), unit)
    text = (
        F.when(commits <= 0, F.lit(""))
        .when(still_present, F.concat(text, F.lit(" (still present in HEAD)")))
        .when(F.coalesce(removed_commit, F.lit("")) != "",
              F.concat(text, F.lit(" (removed in commit "), short_commit(removed_commit), F.lit(")")))
        .otherwise(text)
    )
    return F.replace(text, F.lit("\n"), F.lit(" "))
