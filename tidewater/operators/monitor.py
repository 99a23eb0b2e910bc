"""Staleness of sources, and stored tables against recomputed ones."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Days after which a source is stale.
STALE_AFTER = {"aum": 4, "issuer": 4, "nport": 110, "bulk": 200, "filings": 7}


def staleness(sources: dict[str, tuple[DataFrame, str]], as_of: date) -> DataFrame:
    """(source, latest, age, stale) by each source's greatest date; one aggregate a source."""
    out = None
    for name, (df, column) in sources.items():
        row = df.agg(F.max(F.col(column).cast("date")).alias("latest")).select(F.lit(name).alias("source"), "latest", F.lit(STALE_AFTER[name]).alias("most"))
        out = row if out is None else out.unionByName(row)
    age = F.datediff(F.lit(as_of), "latest")
    return out.select("source", "latest", age.alias("age"), F.coalesce(age > F.col("most"), F.lit(True)).alias("stale"))


def reconcile(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Quarters whose stored and recomputed rows differ in number or filings, and leaks of options and principal amounts."""
    def by_quarter(df, tag):
        leak = F.count_if(F.col("put_call").isNotNull() | (F.coalesce("sh_type", F.lit("SH")) == "PRN"))
        return df.groupBy("cik", "period").agg(F.count("*").alias(f"{tag}_rows"), F.sum("shares").alias(f"{tag}_shares"), F.count_distinct("filing_id").alias(f"{tag}_filings"), leak.alias(f"{tag}_leaks"))

    both = by_quarter(stored, "stored").join(by_quarter(fresh, "fresh"), ["cik", "period"], "full_outer")
    same = lambda c: F.col(f"stored_{c}").eqNullSafe(F.col(f"fresh_{c}"))
    return both.where(~(same("rows") & same("shares") & same("filings")) | (F.coalesce("stored_leaks", F.lit(0)) > 0))
