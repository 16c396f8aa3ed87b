"""Hash-chained logs: building, and verification in parallel."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

GENESIS = "GENESIS"


def event_hash(case: Column, time: Column, evidence: Column, action: Column, details: Column, previous: Column) -> Column:
    """SHA-256 of the fields joined by '|'; a missing evidence id is 'CASE'."""
    return F.sha2(F.concat_ws("|", case, time, F.coalesce(evidence, F.lit("CASE")), F.coalesce(action, F.lit("")), F.coalesce(details, F.lit("")), previous), 256)


def action_code(action: Column) -> Column:
    return F.replace(F.upper(F.trim(action)), F.lit(" "), F.lit("_"))


def build_chain(log: DataFrame, case: str, order: str) -> DataFrame:
    """Adds prev_hash and event_hash to ``log(case, order, time, evidence, action, details)``.

    A chain is a fold in its order. Cases are dealt to tasks and sorted there, and a task carries one hash from row to
    row, so that no case is ever held as a whole.
    """
    schema = StructType([*log.schema.fields, StructField("prev_hash", StringType()), StructField("event_hash", StringType())])
    at = log.columns.index(case)

    def fold(batches):
        last_case, last = object(), GENESIS
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("time", "evidence", "action", "details")}
            before, after = [], []
            for c, time, evidence, action, details in zip(batch.column(at).to_pylist(), *columns.values()):
                if c != last_case:
                    last_case, last = c, GENESIS
                fields = [None if c is None else str(c), time, "CASE" if evidence is None else evidence, action or "", details or "", last]
                before.append(last)
                last = hashlib.sha256("|".join(x for x in fields if x is not None).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=schema.names)

    return log.repartition(case).sortWithinPartitions(case, order).mapInArrow(fold, schema)


def verify_chain(log: DataFrame, case: str, order: str) -> DataFrame:
    """Each case's number of events and the first that breaks the chain (null if none)."""
    before = F.lag("event_hash", 1, GENESIS).over(Window.partitionBy(case).orderBy(order))
    right = event_hash(F.col(case).cast("string"), F.col("time"), F.col("evidence"), F.col("action"), F.col("details"), F.col("prev_hash"))
    checked = log.withColumn("fine", (F.col("prev_hash") == before) & (F.col("event_hash") == right))
    return checked.groupBy(case).agg(F.count(F.lit(1)).alias("events"), F.min(F.when(~F.col("fine"), F.col(order))).alias("first_break"))


def package_root(entries: DataFrame, manifest_sha: str, key: bytes | None = None) -> DataFrame:
    """root: SHA-256 over a manifest hash and the lines 'section|path|sha256' of its entries in order; with a key, also its HMAC.

    One digest reads all lines in order, so one task streams them sorted; it never holds them.
    """

    def digest(batches):
        h = hashlib.sha256(manifest_sha.encode())
        for batch in batches:
            for line in batch.column(0).to_pylist():
                h.update(line.encode())
        root = h.hexdigest()
        mark = hmac.new(key, root.encode(), hashlib.sha256).hexdigest() if key else None
        yield pa.RecordBatch.from_arrays([pa.array([root]), pa.array([mark], pa.string())], names=["root", "hmac"])

    if "section" not in entries.columns:
        entries = entries.withColumn("section", F.lit("artifacts"))
    line = F.concat(F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in ("section", "relative_path", "sha256"))), F.lit("\n"))
    rows = entries.select("section", "relative_path", line.alias("line"))
    none = entries.sparkSession.range(1).select(F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("relative_path"), F.lit("").alias("line"))  # a package without entries has a root too
    ordered = rows.unionByName(none).repartition(1).sortWithinPartitions("section", "relative_path", "line")
    return ordered.select("line").mapInArrow(digest, "root string, hmac string")


#: What the check of a signature may find, in the order in which it looks.
OUTCOMES = ("signature missing", "sidecar missing", "manifest missing", "sidecar differs", "root differs", "hmac differs", "verified")


def signature_outcome(signature: Column, sidecar: Column, manifest: Column, signature_sha: Column, root: Column, signed_root: Column, mark: Column, expected_mark: Column) -> Column:
    """The first of :data:`OUTCOMES` that holds, from the parts of a package (null where missing) and what they should be."""
    return (
        F.when(signature.isNull(), OUTCOMES[0]).when(sidecar.isNull(), OUTCOMES[1]).when(manifest.isNull(), OUTCOMES[2])
        .when(F.element_at(F.split(F.trim(sidecar), r"\s+"), 1) != signature_sha, OUTCOMES[3])
        .when(~root.eqNullSafe(signed_root), OUTCOMES[4])
        .when(F.coalesce(mark, F.lit("")).isin("") | mark.eqNullSafe(expected_mark), OUTCOMES[6])
        .otherwise(OUTCOMES[5])
    )


def verify_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    joined = manifest.join(files.withColumnRenamed("sha256", "found"), "relative_path", "left")
    return joined.withColumn("outcome", F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "ok").otherwise("changed"))
