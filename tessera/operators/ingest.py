"""Import of typed rows with a ledger, strict row checks, idempotent observations, content adapters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_conflicts(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Source events that stand twice in a batch, or were imported before; strict, whatever their payload."""
    twice = batch.groupBy("source_event").agg(F.count("*").alias("n")).filter("n > 1").select("source_event", F.lit("duplicate_in_batch").alias("reason"))
    before = batch.select("source_event").distinct().join(history.select("source_event").distinct(), "source_event", "left_semi").select("source_event", F.lit("imported_before").alias("reason"))
    return twice.unionByName(before)


def batch_outcomes(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Outcome of each offered batch against its job's checkpoint, by the order of the cases."""
    rows = batches.join(jobs.withColumnsRenamed({"source_digest": "job_digest", "cursor": "job_cursor"}), "job", "left")
    outcome = (
        F.when(F.col("next_batch").isNull(), "job_not_found").when(F.col("status") == "completed", "job_completed")
        .when(F.col("source_digest") != F.col("job_digest"), "source_changed").when(F.col("sequence") < F.col("next_batch"), "batch_conflict")
        .when((F.col("sequence") > F.col("next_batch")) | (F.col("cursor") != F.col("job_cursor")), "invalid_checkpoint").otherwise("accepted")
    )
    return rows.select("job", "sequence", outcome.alias("outcome"))


def start_job(jobs: DataFrame, job: str, entities: DataFrame, entity: str) -> str:
    """started, job_exists or entity_not_active."""
    if not jobs.filter(F.col("job") == job).isEmpty():
        return "job_exists"
    return "entity_not_active" if entities.filter((F.col("id") == entity) & (F.col("lifecycle") == "active")).isEmpty() else "started"


def readable_jobs(jobs: DataFrame, bindings: DataFrame, denied: DataFrame) -> DataFrame:
    """Jobs none of whose bindings (job, ref) is denied."""
    hidden = bindings.join(denied.select(F.col("id").alias("ref")).distinct(), "ref", "left_semi").select("job").distinct()
    return jobs.join(hidden, "job", "left_anti")


def dedup_observations(rows: DataFrame) -> DataFrame:
    """One row per (source, session, event): the first by revision, how many came, and whether payloads differ.

    Equal payloads are duplicates of the first; others are conflicts and are reported, not resolved.
    """
    sums = rows.groupBy("source", "session", "event").agg(
        F.min_by("id", "revision").alias("id"), F.min("revision").alias("revision"), F.count("*").alias("n"),
        F.count_distinct("payload").alias("payloads"))
    outcome = F.when(F.col("payloads") > 1, "conflict").when(F.col("n") > 1, "duplicate").otherwise("single")
    return sums.select("source", "session", "event", "id", "revision", "n", outcome.alias("outcome"))


def preview(batch: DataFrame, history: DataFrame, current_revision: int) -> DataFrame:
    """What an import of ``batch`` would do, without doing it."""
    bad = row_conflicts(batch, history).groupBy("source_event").agg(F.min("reason").alias("reason"))
    return batch.join(bad, "source_event", "left").select("source_event", F.lit(current_revision + 1).cast("long").alias("proposed_revision"), F.coalesce("reason", F.lit("accepted")).alias("outcome"))


def json_rows(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Typed fields of a JSON text, with complete, partial or malformed."""
    parsed = F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    names = [f.split()[0] for f in schema.split(",") if f.strip()]
    out = rows.withColumn("_p", parsed)
    holes = F.lit(False)
    for n in (x.strip() for x in names):
        holes = holes | F.col(f"_p.{n}").isNull()
    outcome = F.when(F.col(column).isNull() | F.col("_p").isNull() | F.col("_p._corrupt").isNotNull(), "malformed").when(holes, "partial").otherwise("complete")
    return out.select(*rows.columns, *[F.col(f"_p.{n.strip()}").alias(n.strip()) for n in names], outcome.alias("outcome"))


def csv_rows(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Typed fields of a CSV line; a line that doesn't fit is malformed."""
    parsed = F.from_csv(column, F.lit(f"{schema}, _corrupt string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = rows.withColumn("_p", parsed)
    return out.select(*rows.columns, "_p.*").withColumn("outcome", F.when(F.col("_corrupt").isNotNull(), "malformed").otherwise("complete")).drop("_corrupt")


def html_text(rows: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Text of HTML without scripts and styles, nothing in it is run; outcome complete or malformed (null)."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.parts, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style") and self.skip > 0

        def handle_data(self, data):
            if not self.skip and data.strip():
                self.parts.append(" ".join(data.split()))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for h in f[html_col]:
                p = Text()
                p.feed(h or "")
                p.close()
                out.append("\n".join(p.parts))
            yield pd.DataFrame({id_col: f[id_col], "text": out, "outcome": ["malformed" if h is None else "complete" for h in f[html_col]]})

    return rows.select(id_col, html_col).mapInPandas(scan, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, text string, outcome string")


def xml_rows(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Typed fields of an XML text, with complete or malformed."""
    parsed = F.from_xml(column, F.lit(f"{schema}, _corrupt string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = rows.withColumn("_p", parsed)
    names = [f.strip().split()[0] for f in schema.split(",")]
    outcome = F.when(F.col("_p").isNull() | F.col("_p._corrupt").isNotNull(), "malformed").otherwise("complete")
    return out.select(*rows.columns, *[F.col(f"_p.{n}").alias(n) for n in names], outcome.alias("outcome"))


def container_members(rows: DataFrame, name_col: str = "name", content_col: str = "content", max_bytes: int = 1 << 30) -> DataFrame:
    """Members of ZIP and TAR files and the frames of WAV files, without unpacking to disk.

    outcome: complete, malformed, limit_exceeded (members unpack to more than ``max_bytes``), unsupported.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile
        import wave
        import zipfile

        for f in frames:
            out = []
            for name, raw in zip(f[name_col], f[content_col]):
                kind = str(name).rpartition(".")[2].lower()
                try:
                    data = io.BytesIO(raw or b"")
                    if kind == "zip":
                        found = [(i.filename, i.file_size) for i in zipfile.ZipFile(data).infolist()]
                    elif kind == "tar":
                        found = [(i.name, i.size) for i in tarfile.open(fileobj=data).getmembers()]
                    elif kind == "wav":
                        found = [("frames", wave.open(data).getnframes())]
                    else:
                        out.append((name, None, None, "unsupported"))
                        continue
                    outcome = "limit_exceeded" if sum(n for _, n in found) > max_bytes else "complete"
                    out += [(name, m, n, outcome) for m, n in found] or [(name, None, None, outcome)]
                except (zipfile.BadZipFile, tarfile.TarError, wave.Error, EOFError):
                    out.append((name, None, None, "malformed"))
            yield pd.DataFrame(out, columns=["name", "member", "size", "outcome"]).astype({"size": "Int64"})

    return rows.select(name_col, content_col).mapInPandas(scan, "name string, member string, size long, outcome string")
