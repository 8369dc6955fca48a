"""An inverted index that is kept up to date: what changed is a new segment, what is gone is corrected for, readers merge."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pergola.operators import lexical
from pergola.session import materialise
from pergola.sources import versions

#: Segments beyond which an update rewrites the live postings as one.
SEGMENTS = 8
#: Ids that are sent to every task; more are shuffled.
BROADCAST = 200_000


def digest(text: Column) -> Column:
    """What tells a text from any other; null is a text of its own."""
    return F.sha2(F.concat(F.when(text.isNull(), "0").otherwise("1"), F.coalesce(text, F.lit(""))), 256)


def _small(rows: DataFrame, n: int) -> DataFrame:
    """Rows that go to every task if they are few, so that what they are joined with stays where it is."""
    return F.broadcast(rows) if n <= BROADCAST else rows


@dataclass
class Update:
    """A version and how many documents were new, had another text, were gone, and stayed as they were."""

    version: int
    added: int
    changed: int
    removed: int
    unchanged: int


class Increments:
    """An index folder. A version has a table of documents (doc, digest, dl, segment), segments of the terms of documents that have some (doc, dl, terms, tfs), one an
    update, and as many tables of what each update did to the documents that terms are in (term, change).

    A document's postings count in the segment that the table of documents names for it, so those of an earlier text are dead without being touched. All tables are
    written once and named by the version's file: a reader keeps its version, and an update that fails leaves none.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def update(self, docs: DataFrame, doc: str = "doc_id", text: str = "text", segments: int = SEGMENTS) -> Update:
        """Makes the index that of `docs`, all there are now: only texts that are new or differ are tokenised.

        A document is told by its id, which must be one row's; its text is compared by digest. An update to the same documents adds a version
        without a segment.
        """
        there = versions.known(self.spark, self.path)
        version, held = (there[-1], versions.read(self.spark, self.path, there[-1])[1]) if there else (0, {"docs": None, "segments": [], "terms": []})
        now = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).withColumn("digest", digest(F.col("text")))
        if held["docs"] is None:
            before = self.spark.createDataFrame([], f"doc {docs.schema[doc].dataType.simpleString()}, digest string, dl long, segment string")
        else:
            before = self._table(held["docs"])
        compared = now.select("doc", "digest").join(before.select("doc", F.col("digest").alias("old"), "dl", "segment"), "doc", "full")
        state = F.when(F.col("digest").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("digest"), "changed").otherwise("unchanged")
        judged = self._table(self._write(compared.withColumn("state", state), "compared"))
        counts = {r.state: r["count"] for r in judged.groupBy("state").count().collect()}
        segment = f"postings-{uuid.uuid4().hex}"
        n = counts.get("added", 0) + counts.get("changed", 0)
        fresh = now if held["docs"] is None else now.join(_small(judged.where("state IN ('added', 'changed')").select("doc"), n), "doc", "left_semi")
        moved = bool(counts.get("added") or counts.get("changed"))
        if moved:
            lexical.counted_texts(fresh, "doc").where("size(terms) > 0").write.parquet(f"{self.path}/{segment}")
        dead = judged.where("state IN ('changed', 'removed')").select("doc", "segment")
        gone = self._dead(held["segments"], _small(dead, counts.get("changed", 0) + counts.get("removed", 0)))
        changes = gone.groupBy("term").agg((-F.count("*")).alias("change"))
        if moved:
            changes = changes.unionByName(lexical.document_counts(self._table(segment)).withColumnRenamed("df", "change"))
        terms = [*held["terms"], self._write(changes, "terms")] if moved or counts.get("removed") else held["terms"]
        kept = judged.where("state = 'unchanged'").select("doc", "digest", "dl", "segment")
        renewed = judged.where("state IN ('added', 'changed')").select("doc", "digest")
        if moved:
            renewed = renewed.join(self._table(segment).select("doc", "dl"), "doc", "left")
        else:
            renewed = renewed.withColumn("dl", F.lit(1))
        renewed = renewed.select("doc", "digest", F.coalesce("dl", F.lit(1)).cast("long").alias("dl"), F.lit(segment).alias("segment"))
        out = {"docs": self._write(kept.unionByName(renewed), "docs"), "segments": [*held["segments"], *([segment] if moved else [])], "terms": terms}
        if len(out["segments"]) > segments:
            out = self._compacted(out)
        versions.publish(self.spark, self.path, version + 1, out)
        return Update(version + 1, *(counts.get(k, 0) for k in ("added", "changed", "removed", "unchanged")))

    def _dead(self, segments: list[str], dead: DataFrame) -> DataFrame:
        """term: a row for each posting of documents (doc, segment) in their segments."""
        found = [self._table(s).join(dead.where(F.col("segment") == s).select("doc"), "doc", "left_semi").select(F.explode("terms").alias("term")) for s in segments]
        out = self.spark.createDataFrame([], "term string")
        for rows in found:
            out = out.unionByName(rows)
        return out

    def _live(self, held: dict) -> DataFrame:
        """doc, dl, terms, tfs: each segment's documents that name it. Only ids are shuffled to find those that don't; where these are few, terms stay where they are."""
        docs = self._table(held["docs"])
        out = None
        for s in held["segments"]:
            dead = materialise(self._table(s).select("doc").join(docs.where(F.col("segment") == s).select("doc"), "doc", "left_anti"))
            n = dead.count()
            rows = self._table(s).select("doc", "dl", "terms", "tfs")
            rows = rows.join(_small(dead, n), "doc", "left_anti") if n else rows
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], f"doc {docs.schema['doc'].dataType.simpleString()}, dl long, terms array<string>, tfs array<long>")

    def _compacted(self, held: dict) -> dict:
        live = self._write(self._live(held), "postings")
        docs = self._table(held["docs"]).withColumn("segment", F.lit(live))
        return {"docs": self._write(docs, "docs"), "segments": [live], "terms": [self._write(lexical.document_counts(self._table(live)).withColumnRenamed("df", "change"), "terms")]}

    def compact(self) -> int:
        """Rewrites the live postings as one segment; gives the version that has it."""
        version, held = versions.read(self.spark, self.path)
        versions.publish(self.spark, self.path, version + 1, self._compacted(held))
        return version + 1

    def index(self, version: int | None = None) -> lexical.LexicalIndex:
        """The index of a version, or of the latest: postings of all segments merged, frequencies and lengths from what was corrected, not counted anew."""
        _, held = versions.read(self.spark, self.path, version)
        n, total = F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))
        corpus = self._table(held["docs"]).agg(n.alias("n"), F.when(n > 0, total / F.nullif(n, F.lit(0))).otherwise(1.0).alias("avgdl"))
        changes = None
        for t in held["terms"]:
            changes = self._table(t) if changes is None else changes.unionByName(self._table(t))
        changes = changes if changes is not None else self.spark.createDataFrame([], "term string, change long")
        terms = changes.groupBy("term").agg(F.sum("change").alias("df")).where("df > 0")
        live = self._live(held)
        return lexical.LexicalIndex(lexical.postings_of(live), corpus, terms, live)
