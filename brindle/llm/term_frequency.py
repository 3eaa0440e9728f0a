"""How often, and in how many records, every distinct term occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_frequencies(df: DataFrame, record: str, terms: list[str], min_records: int = 3, max_share: float = 0.5) -> DataFrame:
    """(terms..., occurrences, records, mark) for every distinct combination of the term columns.

    Rows become per-record term counts (partially combined where they are read, then hashed
    by record and term), and those become sums of occurrences and records, again combined
    partially before they are hashed by term. No term's rows ever meet in one task, however
    frequent it is. mark is ``rare`` below min_records records, ``common`` above max_share
    of all distinct records of df, else null.

    Rows with a null term column count for no term, but their record counts among all
    records. A null record adds occurrences, and no record. Repeated rows are occurrences of
    one record. An empty table gives no rows; other columns are ignored.
    """
    names = [f"t{i}" for i in range(len(terms))]
    rows = df.select(F.col(record).alias("r"), *[F.col(t).alias(n) for t, n in zip(terms, names)])
    total = rows.select("r").distinct().agg(F.count("r")).first()[0]
    sound = rows.na.drop(subset=names)
    by_record = sound.groupBy("r", *names).agg(F.count(F.lit(1)).alias("n"))
    counted = by_record.groupBy(*names).agg(F.sum("n").alias("occurrences"), F.count("r").alias("records"))
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > max_share * total, "common")
    return counted.select(*[F.col(n).alias(t) for t, n in zip(terms, names)], "occurrences", "records", mark.alias("mark"))
