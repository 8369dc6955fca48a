"""What the engine asks of a language model, and a stand-in that needs none."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergola.functions.text import code_tokens


class Provider(Protocol):
    """Both methods take and give frames, so calls run where the rows are, in batches."""

    def embed(self, texts: DataFrame) -> DataFrame:
        """key, text -> key, embedding (array<float>); a text that can't be embedded has none."""

    def complete(self, prompts: DataFrame) -> DataFrame:
        """key, role, prompt, more columns -> key, reply; a call that fails has a null reply. Roles: plan, rerank, answer, critique, review, summary, judge."""


class StandIn:
    """Deterministic replies from the prompts themselves. Embeddings are bags of hashed tokens; answers cite the context's first places."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: DataFrame) -> DataFrame:
        n = self.dimensions

        @F.pandas_udf("array<float>")
        def vectors(hashes: pd.Series) -> pd.Series:
            return hashes.map(lambda h: np.bincount(np.abs(np.asarray(h, np.int64)) % n, minlength=n).astype(np.float32) if h is not None and len(h) else None)

        tokens = F.transform(code_tokens(F.col("text")), lambda t: F.xxhash64(t))
        return texts.select("key", vectors(tokens).alias("embedding"))

    def complete(self, prompts: DataFrame) -> DataFrame:
        words = F.slice(F.array_distinct(code_tokens(F.col("prompt"))), 1, 6)
        plan = F.to_json(F.struct(F.lit("explain").alias("intent"), F.col("prompt").alias("restated_question"), F.array(F.array_join(words, " ")).alias("search_queries"), F.array().cast("array<string>").alias("keyword_hints"), F.lit(True).alias("needs_retrieval")))
        places = F.slice(F.regexp_extract_all("prompt", F.lit("(?m)^### Snippet [0-9]+ - (\\S+:[0-9]+-[0-9]+)"), F.lit(1)), 1, 3)
        answer = F.concat(F.lit("See "), F.array_join(F.transform(places, lambda p: F.concat(F.lit("["), p, F.lit("]"))), " and "), F.lit("."))
        cited = F.contains("prompt", F.lit("["))
        critique = F.to_json(F.struct(cited.alias("grounded"), cited.alias("complete"), F.when(cited, 0.9).otherwise(0.3).alias("confidence"), F.when(cited, F.array().cast("array<string>")).otherwise(F.array(F.array_join(words, " "))).alias("follow_up_queries"), F.when(cited, "accept").otherwise("refine").alias("verdict")))
        replies: dict[str, Column] = {"plan": plan, "answer": F.when(F.size(places) > 0, answer).otherwise("I found nothing."), "critique": critique}
        out = F.lit(None).cast("string")
        for role, reply in replies.items():
            out = F.when(F.col("role") == role, reply).otherwise(out)
        return prompts.select("key", out.alias("reply"))


def embed_misses(provider: Provider, texts: DataFrame, cache: DataFrame) -> DataFrame:
    """key, embedding for all texts (key, text): from the cache (key, embedding) where it has the key, else from the provider, each distinct key once."""
    missing = texts.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    return texts.select("key").distinct().join(cache, "key").select("key", "embedding").unionByName(provider.embed(missing).where("embedding IS NOT NULL").select("key", "embedding"))
