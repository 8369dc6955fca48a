"""The engine's commands as functions of frames and folders: index, list, ask, review, evaluate, delete."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pergola.functions.text import json_value

from pergola.operators import chunking, diffs, evaluation, lexical, reviewing, retrieval
from pergola.plans import agent
from pergola.plans.provider import Provider, StandIn
from pergola.progress import Progress
from pergola.session import materialise
from pergola.sources import files
from pergola.sources import index as store


@dataclass(frozen=True)
class Settings:
    """What shapes an index and a retrieval."""

    max_lines: int = chunking.MAX_LINES
    overlap: int = chunking.OVERLAP
    max_files: int = 4000
    max_bytes: int = 400_000
    top_k: int = retrieval.TOP_K
    candidates: int = retrieval.CANDIDATES
    max_refinements: int = agent.MAX_REFINEMENTS


FINDINGS = "array<struct<line int, severity string, title string, body string, category string, confidence double>>"
NO_SUMMARY = "The review's summary could not be written; the findings stand as they are."
#: Indexes whose tables an engine keeps at hand.
HELD = 32


@dataclass
class Engine:
    spark: SparkSession
    root: str
    settings: Settings = field(default_factory=Settings)
    provider: Provider = field(default_factory=StandIn)
    held: dict[str, dict[str, DataFrame]] = field(default_factory=dict)

    def tables(self, index_id: str) -> dict[str, DataFrame]:
        """An index's tables; the HELD indexes opened last are kept, the oldest goes first."""
        if index_id not in self.held:
            while len(self.held) >= HELD:
                self.held.pop(next(iter(self.held)))
            self.held[index_id] = store.load_by_name(self.spark, self.root, index_id)
        return self.held[index_id]

    def index(self, source: str, index_id: str, commit: str = "", ignore: list[str] | None = None, globs: list[str] | None = None, progress: Progress | None = None) -> DataFrame:
        """Scans a folder, chunks its files, embeds and indexes them, and writes the index; gives back how many files were left out and why.

        ignore: lines of an ignore file; if not given, those of the folder's own. A file that can't be parsed is chunked by lines and fails no other.
        """
        tell = progress.emit if progress else lambda *_, **__: None
        tell("scan", source=source)
        ignore = files.ignore_lines(self.spark, source) if ignore is None else ignore
        judged = materialise(files.judged(files.decoded(files.scan(self.spark, source, self.settings.max_bytes)), ignore, globs, self.settings.max_bytes))
        kept = files.chosen(judged, self.settings.max_files)
        tell("chunk", files=judged.where("skip_reason IS NULL").count())
        chunks = materialise(chunking.last_by_id(chunking.chunks(kept.select("path", "content"), self.settings.max_lines, self.settings.overlap)).withColumnRenamed("chunk_id", "doc").withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy("start_line", "doc"))))
        tell("embed", chunks=chunks.count())
        held = lexical.build_texts(chunks.withColumn("text", F.concat_ws("\n", "path", F.coalesce("symbol", "path"), "symbol", "content")), "doc")
        vectors = self.provider.embed(chunks.select(F.col("doc").alias("key"), F.concat_ws("\n", "path", F.substring("content", 1, 8000)).alias("text"))).where("embedding IS NOT NULL").withColumnRenamed("key", "doc")
        overview = chunking.repo_map(kept.select("path", "content"), chunks)
        tell("write", index_id=index_id)
        store.save(self.spark, f"{self.root}/{index_id}", index_id, commit, chunks=chunks, postings=held.postings, corpus=held.corpus, vectors=vectors, repo_map=overview)
        self.held.pop(index_id, None)
        tell("done", index_id=index_id)
        return files.skip_counts(judged)

    def list(self) -> DataFrame:
        return store.catalogue(self.spark, self.root)

    def delete(self, index_id: str) -> bool:
        self.held.pop(index_id, None)
        return store.delete(self.spark, f"{self.root}/{index_id}")

    def source(self, index_id: str, path: str) -> DataFrame:
        return store.by_path(self.tables(index_id)["chunks"], path)

    def _retriever(self, tables: dict[str, DataFrame]) -> agent.Retrieve:
        held = lexical.LexicalIndex(tables["postings"], tables["corpus"])
        return agent.retriever(tables["chunks"], held, self.provider, tables.get("vectors"), self.settings.top_k, self.settings.candidates)

    def ask(self, index_id: str, questions: DataFrame) -> DataFrame:
        """Answers to questions (qid string, question) over an index."""
        tables = self.tables(index_id)
        overview = tables["repo_map"].first().map if "repo_map" in tables else ""
        return agent.ask(agent.checked(questions), tables["chunks"], self._retriever(tables), self.provider, self.settings.max_refinements, overview)

    def stream(self, index_id: str, question: str) -> Iterator[dict]:
        """One question's steps as they end: plan, retrieve, answer."""
        tables = self.tables(index_id)
        asked = agent.checked(self.spark.createDataFrame([("q", question)], "qid string, question string"))
        plan = materialise(agent.planned(asked, self.provider))
        yield {"stage": "plan", "queries": plan.first().queries}
        found = materialise(self._retriever(tables)(plan.select("qid", "queries")))
        yield {"stage": "retrieve", "places": [r.path for r in found.orderBy("rank").select("path").collect()]}
        row = self.ask(index_id, asked).first()
        yield {"stage": "answer", **row.asDict(recursive=True)}

    def review_run(self, diff: DataFrame, fail_on: str = "high", index_id: str | None = None) -> tuple[DataFrame, DataFrame, str, int]:
        """A review of a diff (diff_id, text) by the provider: findings, gate, summary, and how many files had no readable reply.

        Each reviewable file is a prompt of its own, all sent as one frame, with what an index, if one is given, has that is related to it: all files
        are searched for and packed in one plan. A file whose call fails is left out and counted, and fails no other.
        """
        marked = materialise(diffs.marked(diff))
        contexts = self._contexts(index_id, marked) if index_id is not None else None
        named = reviewing.bodies(marked).select("key", "path")
        replies = self.provider.complete(reviewing.prompts(marked, contexts)).select("key", F.from_json(json_value(F.col("reply")), FINDINGS).alias("found"))
        replies = materialise(named.join(replies, "key", "left"))
        failed = replies.where("found IS NULL").count()
        each = replies.select("key", "path", F.explode("found").alias("f")).select(F.xxhash64("key", "f.line", "f.title", "f.body").alias("finding_id"), "path", "f.*")
        report, gate = self.review(diff, each, fail_on)
        report = materialise(report)
        text = diffs.summary_markdown(report).first().markdown
        asked = self.spark.createDataFrame([("summary", "summary", text)], "key string, role string, prompt string")
        return report, gate, self.provider.complete(asked).first().reply or f"{NO_SUMMARY}\n\n{text}", failed

    def _contexts(self, index_id: str, marked: DataFrame) -> DataFrame:
        """key, context: for each file of a diff the chunks related to it, as many as its context has room for."""
        tables = self.tables(index_id)
        held = lexical.LexicalIndex(tables["postings"], tables["corpus"])
        find = agent.retriever(tables["chunks"], held, self.provider, tables.get("vectors"), reviewing.CHUNKS, self.settings.candidates, expand=False)
        found = materialise(reviewing.first(reviewing.related(materialise(reviewing.searches(marked)), find)))
        return agent.context(found.withColumnRenamed("key", "qid"), tables["chunks"], reviewing.CONTEXT_CHARS).withColumnRenamed("qid", "key")

    def review(self, diff: DataFrame, findings: DataFrame, fail_on: str = "high") -> tuple[DataFrame, DataFrame]:
        """The findings of a review (as a model gave them) that stand against a diff (diff_id, text), and the gate's verdict."""
        marked = diffs.marked(diff)
        lines = diffs.diff_lines(marked)
        added = lines.where("type = 'added'").join(diffs.files(marked).select("diff_id", "file_no", "path"), ["diff_id", "file_no"]).select("path", "new_line")
        report = diffs.deduplicated(diffs.validated(findings, added))
        return report, diffs.blocked(report, fail_on)

    def evaluate(self, index_id: str, cases: DataFrame, k: int | None = None) -> DataFrame:
        """Retrieval metrics of evaluation cases (id, question, expected_paths) over an index, averaged."""
        retrieve = self._retriever(self.tables(index_id))
        got = retrieve(cases.select(F.col("id").alias("qid"), F.array("question").alias("queries"))).select(F.col("qid").alias("case_id"), "rank", "path")
        expected = cases.select(F.col("id").alias("case_id"), F.explode("expected_paths").alias("path"))
        return evaluation.averages(evaluation.retrieval_metrics(got, expected, k))
