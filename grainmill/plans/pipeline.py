"""A run over a tree of files, from listing to output files, metadata and state."""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig, validate_directory
from ..functions.formatting import format_chunk
from ..functions.library import write_whole
from ..functions.text import word_count
from ..session import ship, stage
from ..operators import chunkers, ignore, metadata, packing, state
from ..sources import listing, reader, sinks

log = logging.getLogger(__name__)
TOO_LARGE = "File exceeds size limit"
UNCHANGED = "Unchanged file (hash match)"
IGNORED = "Left out by a rule"
NO_HASH = "Error computing file hash"
FAILED = "Error processing file: "


class Pipeline:
    """One run: ``run`` writes ``chunk_*.txt``, ``metadata.json`` and ``hashes.json`` and gives its tables."""

    def __init__(self, spark: SparkSession, config: RunConfig):
        self.spark, self.config = spark, config
        ship(spark)

    def listed(self) -> DataFrame:
        return listing.listing(self.spark, self.config.repo_path)

    def kept(self, listed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Files to read, files that are too large, and files that rules leave out."""
        c = self.config
        rules = ignore.load_rules(c.repo_path, c.skip_patterns)
        files = listed.where(~F.col("is_dir"))
        rows = files.where(~ignore.ignored(F.col("path"), rules))
        if c.mode == "strict":
            out = os.path.relpath(c.output_dir, c.repo_path)
            rows = rows.where(~ignore.in_skipped_folder(F.col("path"), [*c.skip_dirs, ".git"])).where(~F.col("path").startswith(out + "/"))
        large = ignore.too_large(F.col("size"), c.max_file_size)
        return rows.where(~large), rows.where(large), files.join(rows.select("seq"), "seq", "left_anti")

    def run(self) -> dict[str, DataFrame]:
        c, strict = self.config, self.config.mode == "strict"
        validate_directory(c.output_dir)
        kept_state = state.StateTable(self.spark, os.path.join(c.output_dir, "hashes")) if c.state == "parquet" else None
        saved = os.path.join(c.output_dir, "hashes.json")
        listed = stage(self.listed(), "listed")
        kept, large, left_out = self.kept(listed)
        log.info("%d entries listed, %d files to read, %d too large, %d left out by rules", metadata.entries(listed).first()[0], kept.count(), large.count(), left_out.count())
        held = kept_state.load() if kept_state else state.load(self.spark, saved)
        read = stage(reader.read_files(kept), "read")
        place = "path" if strict else "abs_path"
        broken = F.col("hash").isNull()
        # suffixes whose reader fails once more on text that isn't UTF-8
        twice = F.col("suffix").isin(".js", ".ts", ".java", ".cpp", ".c", ".html", ".css")
        undecodable = F.col("error").startswith("decode") & (F.lit(strict) | twice)
        todo = state.changed(read.where(~broken), held)
        good = todo.where(~F.coalesce(undecodable, F.lit(False)))
        files = stage(chunkers.chunked(good.select("seq", "path", "name", "suffix", "size", "hash", "text"), c.mode), "files")
        exploded = files.select("seq", "path", F.col("suffix").alias("sfx"), F.posexplode("chunks").alias("chunk_idx", "c"))
        chunks = exploded.select("seq", "path", "chunk_idx", chunkers.subdir(F.col("sfx")).alias("subdir"), "c.*")
        chunks = stage(chunks.withColumn("formatted", format_chunk(c.mode)).withColumn("words", word_count("formatted")), "chunks")
        processed = metadata.per_file(files.select("path", "size", "lines"), chunks, ["path"]).select("path", "chunks", "size", "lines", "words")
        skipped = (
            large.select(F.col(place).alias("path"), F.lit(TOO_LARGE).alias("reason"))
            .unionByName(read.where(broken).select(F.col(place).alias("path"), F.lit(NO_HASH).alias("reason")))
            .unionByName(state.unchanged(read.where(~broken), held).select("path", F.lit(UNCHANGED).alias("reason")))
            .unionByName(todo.where(undecodable).select(F.col(place).alias("path"), F.concat(F.lit(FAILED), F.regexp_replace("error", "^decode: ", "")).alias("reason")))
        )
        if strict:
            skipped = skipped.unionByName(left_out.select("path", F.lit(IGNORED).alias("reason")))
        processed, skipped = stage(processed, "processed"), stage(skipped, "skipped")
        for r in skipped.groupBy(F.regexp_extract("reason", f"^(?:{FAILED})?[^:]*", 0).alias("reason")).agg(F.count("*").alias("n")).collect():
            log.info("%d files skipped: %s", r["n"], r["reason"])
        order = ["seq", "chunk_idx"]
        by = ["subdir", *order] if strict else order
        bins = packing.next_fit(chunks, c.max_words, by).join(chunks.select(*order, "formatted", *([] if strict else ["subdir"])), order)
        bins = stage(bins, "bins")
        named = stage(packing.files_by_folder(bins) if strict else packing.files(bins, order), "named")
        total = metadata.summary(processed)
        written = sinks.write_texts(bins.select(*order, "bin", "subdir", "formatted").join(named.select("bin", "rel_file", *(["subdir"] if strict else [])), ["bin", *(["subdir"] if strict else [])]).drop("subdir"), c.output_dir, order)
        done = written.agg(F.count("*"), F.sum("chars")).collect()[0]
        log.info("%d files processed, %d output files, %s characters", processed.count(), done[0], done[1])
        # a path that is gone stays in the state unless the mode is strict
        new = state.upsert(held.join(listed.select("path"), "path", "left_semi") if strict else held, files.select("path", "hash"))
        if kept_state:
            for name, rows in (("processed_files", processed), ("skipped_files", skipped), ("summary", total)):
                rows.write.mode("overwrite").parquet(os.path.join(c.output_dir, "metadata", name))
            kept_state.save(new)
        else:
            self._save_metadata(processed, skipped, total)
            state.save(new, saved)
        return {"processed": processed, "skipped": skipped, "summary": total, "chunks": chunks, "files": named, "listed": listed}

    def _save_metadata(self, processed: DataFrame, skipped: DataFrame, total: DataFrame) -> None:
        """``metadata.json``, written row by row."""

        def parts():
            yield "{"
            for name, rows in (("processed_files", processed.orderBy("path")), ("skipped_files", skipped.orderBy("path", "reason"))):
                yield f'\n    "{name}": ['
                n = -1
                for n, r in enumerate(rows.toLocalIterator(prefetchPartitions=True)):
                    yield "," if n else ""
                    yield "\n        " + json.dumps(r.asDict(), indent=4).replace("\n", "\n        ")
                yield "\n    ]," if n >= 0 else "],"
            yield '\n    "summary": ' + json.dumps(total.collect()[0].asDict(), indent=4).replace("\n", "\n    ") + "\n}"

        write_whole(os.path.join(self.config.output_dir, "metadata.json"), parts())
