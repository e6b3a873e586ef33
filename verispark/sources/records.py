"""Fingerprints, manifests and the parameter seal: small documents kept by the driver."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(document: object) -> str:
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(document: object) -> str:
    return hashlib.sha256(canonical(document).encode()).hexdigest()


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint: row count and the sum of the leading digits of each row's SHA-256."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    lead = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(lead.cast("decimal(38,0)")).cast("string").alias("row_hash_sum"))


def seal(parameters: dict, sections: Sequence[str]) -> dict:
    """Digest of each sealed section and of them all."""
    parts = {name: digest(parameters[name]) for name in sections}
    return {"sections": parts, "sha256": digest(parts)}


def seal_differences(parameters: dict, sealed: dict) -> list[str]:
    """Sections that no longer match their seal; empty means intact."""
    return [name for name, value in sealed["sections"].items()
            if name not in parameters or digest(parameters[name]) != value]


def write_manifest(path: str, inputs: dict, parameters: dict, counts: dict, validations: dict, outputs: dict,
                   spark: SparkSession | None = None) -> dict:
    """Write the manifest: through the session's file systems if one is given, else to a local file."""
    document = {"schema_version": 1, "inputs": inputs, "parameters_sha256": digest(parameters), "counts": counts,
                "validations": validations, "outputs": outputs}
    text = json.dumps(document, indent=2, sort_keys=True)
    if spark is None:
        Path(path).write_text(text, encoding="utf-8")
    else:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
    return document


def verify_input(fingerprint: dict, manifest: dict, keys: Sequence[str]) -> None:
    """Compare a fingerprint with the one an upstream manifest recorded under ``keys``."""
    found = manifest
    for key in keys:
        found = found[key]
    if found != fingerprint:
        raise ValueError(f"input does not match its manifest entry {'/'.join(keys)}")
