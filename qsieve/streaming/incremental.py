"""Incremental scanning with Structured Streaming.

The detection branches (discovery, regex lines, usage sites) are stateless
per file, so the batch operators run unchanged on a streaming `files` table
(e.g. parquet files landing in a directory as repositories are ingested).
De-duplication (W1/A1) becomes a streaming aggregation keyed by
(repo, rule_id, file): its state is one row per key, independent of how many
hits arrive, and `update` mode emits the changed keys per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import findings as FD
from ..operators.lines import regex_findings
from ..operators.usage import usage_findings
from ..sources.files import discover, readable, with_file_meta

FILES_SCHEMA = T.StructType([T.StructField("repo", T.StringType()),
                             T.StructField("path", T.StringType()),
                             T.StructField("content", T.StringType())])


def read_files_stream(spark: SparkSession, source_dir: str, max_files: int = 64) -> DataFrame:
    """A streaming `files(repo, path, content)` table over parquet files."""
    return (spark.readStream.schema(FILES_SCHEMA).option("maxFilesPerTrigger", max_files)
            .parquet(source_dir))


def findings_stream(files: DataFrame, rules: list[dict] | None = None,
                    min_confidence: float = 50, min_severity: str = "safe") -> DataFrame:
    """Filtered findings of every file as it arrives (stateless)."""
    text = readable(with_file_meta(discover(files)))
    raw = FD.union_findings(regex_findings(text, rules), usage_findings(text, rules))
    return FD.filter_findings(raw, min_confidence, min_severity)


def deduped_stream(findings: DataFrame) -> DataFrame:
    """W1/A1 as a stateful streaming aggregation (use outputMode 'update')."""
    return FD.dedupe(findings)


def start(spark: SparkSession, source_dir: str, query_name: str, checkpoint: str | None = None,
          available_now: bool = True, sink_format: str = "parquet", sink_path: str | None = None):
    """Start the incremental scan.  A durable sink (`sink_format` parquet/…,
    `sink_path`) keeps a stable checkpoint under the session's checkpoint
    directory so a restarted job resumes; the memory sink (tests, notebooks)
    cannot resume and gets a fresh checkpoint per start."""
    if sink_format != "memory" and not sink_path:
        raise ValueError("a file sink needs sink_path")
    import uuid
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if checkpoint is None:
        suffix = query_name if sink_format != "memory" else f"{query_name}-{uuid.uuid4().hex}"
        checkpoint = f"{base}/stream-{suffix}"
    out = deduped_stream(findings_stream(read_files_stream(spark, source_dir)))
    if sink_format == "memory":
        w = out.writeStream.outputMode("update").format("memory").queryName(query_name)
    else:
        # file sinks are append-only: write the per-file findings, dedupe downstream
        out = findings_stream(read_files_stream(spark, source_dir))
        w = out.writeStream.outputMode("append").format(sink_format).option("path", sink_path)
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
