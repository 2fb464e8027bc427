"""Tables laid out by patient, so that the flow over them meets its keys where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.scoring import patient_id


def save_by_patient(df: DataFrame, table: str, buckets: int, mode: str = "overwrite", subject: str = "subject") -> DataFrame:
    """Write a table bucketed by ``patient_id`` and read it back; the id is taken from ``subject`` where there is none.

    Rows are dealt by patient once, on writing. Newest per patient and code, merge, totals and the join with patients
    that are laid out in as many buckets then need no exchange. A patient with very many rows makes its bucket's file
    large, which a scan splits only for jobs that don't group by patient: choose buckets by the rows of all patients.
    """
    if "patient_id" not in df.columns:
        df = df.withColumn("patient_id", patient_id(F.col(subject)))
    dealt = df.repartition(buckets, "patient_id")  # one file a bucket
    dealt.write.mode(mode).format("parquet").bucketBy(buckets, "patient_id").sortBy("patient_id").saveAsTable(table)
    return df.sparkSession.table(table)
