"""Pluggable model calls: prompts as columns, batches with retries, a registry, provenance. No model is bundled; the defaults are deterministic."""

from __future__ import annotations

import json
import platform
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime
from importlib import metadata
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions import scalars as S
from retentia.operators.documents import count_tokens
from retentia.sources.schema import RECORD

ANSWER = f"struct<extracted_conditions:array<{RECORD}>>"
# The static dimension of known extractors.
REGISTRY = [
    ("qwen3.5-27b", "QuantTrio/Qwen3.5-27B-AWQ", "awq", 14.0, 32768, True),
    ("qwen3.5-27b-fp8", "Qwen/Qwen3.5-27B-FP8", "fp8", 28.5, 32768, True),
    ("deepseek-r1-14b", "deepseek-ai/DeepSeek-R1-Distill-Qwen-14B", "bf16", 28.0, 32768, True),
    ("deepseek-r1-32b", "deepseek-ai/DeepSeek-R1-Distill-Qwen-32B", "bf16", 64.0, 32768, True),
    ("llama3.1-8b", "meta-llama/Llama-3.1-8B-Instruct", "bf16", 16.0, 32768, False),
    ("mistral-small-24b", "mistralai/Mistral-Small-24B-Instruct-2501", "bf16", 48.0, 32768, False),
]


class Extractor(Protocol):
    """Answers a batch of prompts; an exception or an unreadable answer counts as a failure of that prompt."""

    def answer(self, prompts: list[str]) -> list[str]: ...


class EchoExtractor:
    """Deterministic stand-in: finds no records."""

    def answer(self, prompts: list[str]) -> list[str]:
        return ['{"extracted_conditions": []}' for _ in prompts]


def extraction_prompt(text: Column, task: str, feedback: Column | None = None, tail: str = "") -> Column:
    note = F.coalesce(F.concat(F.lit("\n\nReviewer feedback:\n"), feedback), F.lit("")) if feedback is not None else F.lit("")
    return F.concat(F.lit("Document:\n"), text, F.lit("\n\nTask:\n" + task), note, F.lit(tail))


def judge_prompt(a: Column, b: Column, template: str = "Two extractors read one paper.\nFirst: {a}\nSecond: {b}\nGive the agreed records as JSON.") -> Column:
    """Record lists as JSON in a template with {a} and {b}."""
    head, rest = template.split("{a}")
    mid, end = rest.split("{b}")
    return F.concat(F.lit(head), F.to_json(a), F.lit(mid), F.to_json(b), F.lit(end))


def dispute_prompt(field: str, a: Column, b: Column, quote_a: Column, quote_b: Column) -> Column:
    """Asks which of two values of a field its quotation bears out."""
    say = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    parts = [f"Two readings of {field} disagree.\nFirst: ", say(a), "\nQuoted for it: ", say(quote_a), "\nSecond: ", say(b), "\nQuoted for it: ", say(quote_b), '\nAnswer with JSON: {"resolved_value": text or null}.']
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def validation_prompt(record: Column, evidence: Column) -> Column:
    """Asks whether a record that one extractor alone found was measured, by its quotations."""
    parts = ["Only one extractor reports this record:\n", F.to_json(record), "\nQuotations: ", F.coalesce(F.to_json(evidence), F.lit("none")), '\nWas it measured, rather than simulated, cited or made up? Answer with JSON: {"is_valid": true or false}.']
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def chat(prompt: Column, system: str | None = None, thinking: bool = False) -> Column:
    """A prompt as the JSON list of messages that chat endpoints take; the endpoint applies its model's template."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = [message("system", F.lit(system))] if system else []
    return F.to_json(F.struct(F.array(*messages, message("user", prompt)).alias("messages"), F.lit(thinking).alias("thinking")))


class Judge(Protocol):
    """Decides where two extractors differ; both methods are plugged into the consensus."""

    def resolve(self, field: str, first: object, second: object) -> object: ...

    def validate(self, record: dict) -> bool: ...


class RuleJudge:
    """Deterministic default: the first value stays, every record is valid."""

    def resolve(self, field: str, first: object, second: object) -> object:
        return first

    def validate(self, record: dict) -> bool:
        return True


def _readable(answer: str | None) -> bool:
    try:
        return isinstance(json.loads(answer[answer.index("{") : answer.rindex("}") + 1]), dict)
    except (TypeError, ValueError, AttributeError):
        return False


def call(df: DataFrame, prompt: str, extractor: Extractor, attempts: int = 3) -> DataFrame:
    """(…, answer, n_attempts, success): whole batches are answered, only failed prompts are asked again."""
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", answer string, n_attempts int, success boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers: list[str | None] = [None] * len(b)
            tries = [0] * len(b)
            for _ in range(attempts):
                todo = [i for i, a in enumerate(answers) if not _readable(a)]
                if not todo:
                    break
                try:
                    got: list[str | None] = list(extractor.answer([b[prompt].iloc[i] for i in todo]))
                except Exception:
                    got = [None] * len(todo)
                for i, a in zip(todo, got):
                    answers[i], tries[i] = a, tries[i] + 1
            yield b.assign(answer=answers, n_attempts=pd.Series(tries, index=b.index, dtype="int32"), success=[_readable(a) for a in answers])

    return df.mapInPandas(run, out)


def parse_answers(answered: DataFrame, key: list[str]) -> DataFrame:
    """One row per extracted record of every readable answer."""
    parsed = F.from_json(S.parse_model_answer(F.col("answer")), ANSWER)
    return answered.select(*key, F.posexplode(F.coalesce(parsed["extracted_conditions"], F.array().cast(f"array<{RECORD}>"))).alias("cond_idx", "r")).select(*key, "cond_idx", "r.*")


def assemble(chunks: DataFrame, answered: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_ok, total_tokens): chunk results joined back to their chunks by index."""
    j = chunks.select("doc_id", "chunk_index", "token_count").join(answered.select("doc_id", "chunk_index", "success"), ["doc_id", "chunk_index"], "left")
    return j.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.when(F.col("success"), 1).otherwise(0)).alias("n_ok"), F.sum("token_count").alias("total_tokens"))


def chunk_details(chunks: DataFrame, answered: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, section, token_count, extraction_success, extracted_count, error): one row per chunk; a chunk that was never asked failed."""
    parsed = F.from_json(S.parse_model_answer(F.col("answer")), ANSWER)["extracted_conditions"]
    found = answered.select("doc_id", "chunk_index", "success", F.size(F.coalesce(parsed, F.array().cast(f"array<{RECORD}>"))).alias("n"))
    j = chunks.select("doc_id", "chunk_index", "section", "token_count").join(found, ["doc_id", "chunk_index"], "left")
    ok = F.coalesce("success", F.lit(False))
    return j.select("doc_id", "chunk_index", "section", "token_count", ok.alias("extraction_success"), F.when(ok, F.col("n")).alias("extracted_count"), F.when(~ok, F.lit("no readable answer")).alias("error"))


def document_records(answered: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, cond_idx, fields of a record): all records of a document in the order of its chunks; `cond_idx` counts within a chunk."""
    return parse_answers(answered.where("success"), ["doc_id", "chunk_index"])


def feedback_loop(papers: DataFrame, review, extract, rounds: int = 1) -> DataFrame:
    """At most `rounds` more extractions of the papers a reviewer flags (`review` gives paper_id, requires_retry, feedback)."""
    done = extract(papers, None)
    for _ in range(rounds):
        flagged = review(done).where("requires_retry").select("paper_id", "feedback")
        again = extract(papers.join(flagged, "paper_id", "left_semi"), flagged)
        done = done.join(flagged.select("paper_id"), "paper_id", "left_anti").unionByName(again, allowMissingColumns=True)
    return done


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "short_name string, hf_id string, quantization string, vram_gb double, max_model_len int, has_thinking_mode boolean")


def model_config(spark: SparkSession, names: DataFrame) -> DataFrame:
    """Configuration of every named extractor: by its key, else by its full id, else a plain default."""
    reg = F.broadcast(registry(spark))  # six rows
    j = names.join(reg, (names["name"] == reg["short_name"]) | (names["name"] == reg["hf_id"]), "left")
    return j.select("name", F.coalesce("hf_id", "name").alias("hf_id"), F.coalesce("quantization", F.lit("bf16")).alias("quantization"), F.coalesce("max_model_len", F.lit(32768)).alias("max_model_len"), F.coalesce("has_thinking_mode", F.lit(False)).alias("has_thinking_mode"))


def git_commit(folder: str = ".") -> dict[str, object]:
    def git(*a: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    sha = git("rev-parse", "HEAD")
    return {"sha": sha, "short_sha": sha and sha[:8], "dirty": None if sha is None else bool(git("status", "--porcelain"))}


def provenance(texts: DataFrame, prompt_version: str, sampling: dict[str, float], folder: str = ".", model: str | None = None) -> DataFrame:
    """(doc_id, reproducibility): commit, libraries, model and sampling once, the fingerprint of the input per row."""
    known = next((r for r in REGISTRY if model in r[:2]), (model, model, "bf16", None, 32768, False))
    commit = git_commit(folder)
    libs = {n: metadata.version(n) for n in ("pyspark", "pyarrow", "pandas", "numpy")} | {"python": platform.python_version()}
    lit_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in (kv[0], str(kv[1]))])
    tokens = F.pandas_udf(lambda s: s.map(lambda t: count_tokens(t) if isinstance(t, str) else None).astype("Int64"), "bigint")
    inp = F.struct(F.sha2("text", 256).alias("sha256"), F.length("text").cast("bigint").alias("char_len"), tokens("text").alias("token_count"))
    return texts.select(
        "doc_id",
        F.struct(
            F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")).alias("generated_at_utc"),
            F.struct(F.lit(commit["sha"]).cast("string").alias("sha"), F.lit(commit["short_sha"]).cast("string").alias("short_sha"), F.lit(commit["dirty"]).cast("boolean").alias("dirty")).alias("pipeline_git_commit"),
            F.struct(F.lit(known[0]).cast("string").alias("short_name"), F.lit(known[1]).cast("string").alias("hf_id"), F.lit(known[2]).alias("quantization"), F.lit(known[4]).alias("max_model_len")).alias("model"),
            lit_map(libs).alias("library_versions"), lit_map(sampling).alias("sampling"), F.lit(prompt_version).alias("prompt_version"), inp.alias("input"),
        ).alias("reproducibility"),
    )
