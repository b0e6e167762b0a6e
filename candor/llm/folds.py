"""Fold of a document and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sampled(labelled: DataFrame, label: str, most: int, id_column: str = "doc_id") -> DataFrame:
    """Rows with a label, about most / labels of each label, chosen by a hash of the id; never more than 2 * most."""
    labelled = labelled.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}  # a row for each label
    if not counts:
        return labelled.limit(0)
    share = most / len(counts)
    chosen = F.lit(False)
    for value, n in counts.items():
        at_most = int(min(1.0, share / n) * (1 << 32))
        chosen |= (F.col(label) == F.lit(value)) & (F.pmod(F.xxhash64(F.col(id_column), F.lit("sample")), F.lit(1 << 32)) < at_most)
    return labelled.where(chosen).limit(2 * most)
