"""What a scan reads off the contents of files, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import labels, paths, text
from fleetscope.operators import drift, lines, packages
from fleetscope.plans.detectors import Settings
from fleetscope.sources.files import context_name


def kept_whole(path: Column) -> Column:
    """Files whose text later steps read: manifests, workspace definitions, documentation, instructions,
    environment examples, ignore files. They are few and small beside the sources."""
    names = [*packages.MANIFEST_LANGUAGES, "pnpm-workspace.yaml", "pnpm-workspace.yml", "lerna.json"]
    return (
        paths.basename(path).isin(names) | path.isin([*drift.ENV_EXAMPLES, *paths.IGNORE_FILES])
        | drift.documentation_name(path).isNotNull() | context_name(path).isNotNull()
    )


def content_facts(files: DataFrame, settings: Settings) -> DataFrame:
    """``repo, path, size, line_no, kind, marker, confidence, is_text, tokens, signed, content``.

    Row 0 of a file holds what is known of it as a whole: whether it is scanned text, its estimated tokens (NULL if
    it does not count), whether an assistant has signed it, and the content of files that are
    :func:`kept_whole`. The others are its lines with a marker or secret. Nothing moves between tasks.
    """
    path, content = F.col("path"), F.col("content")
    binary = F.coalesce(paths.binary(path, content), F.lit(False)) | content.isNull()
    scanned = ~paths.skippable(path) & ~binary & ~paths.ignored(path)
    counted = ~paths.basename(path).isin(paths.REPORT_FILES) & ~binary
    line = F.struct(F.lit(0).alias("line_no"), F.lit(None).cast("string").alias("line"))
    numbered = F.transform(text.lines(content), lambda row, i: F.struct((i + 1).alias("line_no"), row.alias("line")))
    # Lines that cannot hold anything are left out before they become rows.
    likely = F.filter(numbered, lambda row: lines.may_hold_finding(row["line"], path, settings.markers))
    listed = F.when(scanned & lines.may_hold_finding(content, path, settings.markers), likely)
    whole = files.select(
        "repo", "path", F.col("size").cast("long").alias("size") if "size" in files.columns else F.octet_length(content).cast("long").alias("size"),
        scanned.alias("is_text"), F.when(counted, text.token_estimate(content)).alias("tokens"),
        (paths.eligible_source(path) & labels.inline_signature(content)).alias("signed"),
        F.when(kept_whole(path), content).alias("content"),
        F.explode(F.concat(F.array(line), F.coalesce(listed, F.array().cast("array<struct<line_no:int,line:string>>")))).alias("row"),
    )
    found = lines.line_findings(F.col("row.line"), path, settings.markers, settings.entropy_cutoff, settings.secret_patterns)
    none = F.lit(None).cast("struct<kind:string,marker:string,confidence:string>")
    first = F.col("row.line_no") == 0
    rows = whole.withColumn("found", F.explode(F.when(first, F.array(none)).otherwise(found)))
    of_file = lambda name: F.when(first, F.col(name)).alias(name)
    return rows.select(
        "repo", "path", "size", F.col("row.line_no").cast("long").alias("line_no"), "found.kind", "found.marker", "found.confidence",
        of_file("is_text"), of_file("tokens"), of_file("signed"), of_file("content"),
    )
