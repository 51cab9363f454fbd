"""The judge and the trace fallback: only rows that need a call reach the model."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import judge as J
from ..functions.adherence import reason_of, result
from ..functions.match import align, words_agree
from ..functions.text import coerce_text, is_blank
from ..functions.trace import check_trace


class JudgeModel(Protocol):
    """Anything that can be pickled, names its model and answers a prompt."""

    @property
    def model_id(self) -> str: ...

    def call(self, prompt: str) -> str: ...


@dataclass
class ProviderJudge:
    """A judge behind a provider's public client library, imported on the executors."""

    provider: str
    model: str = ""
    api_key: str | None = None
    _client: object = field(default=None, repr=False)

    DEFAULTS = {"groq": ("openai/gpt-oss-120b", "GROQ_API_KEY"), "openai": ("gpt-4o", "OPENAI_API_KEY"), "anthropic": ("claude-sonnet-4-5", "ANTHROPIC_API_KEY"), "litellm": ("", "")}

    def __post_init__(self):
        if self.provider not in self.DEFAULTS:
            raise ValueError(f"unknown judge provider: {self.provider}")
        self.model = self.model or self.DEFAULTS[self.provider][0]
        if not self.model:
            raise ValueError(f"{self.provider} needs a model id")

    @property
    def model_id(self) -> str:
        return self.model

    def __getstate__(self):
        return self.__dict__ | {"_client": None}

    def _open(self):
        name = self.DEFAULTS[self.provider][1]
        key = self.api_key or os.environ.get(name, "") if name else "none"
        if not key:
            raise ValueError(f"{name} is not set")
        if self.provider == "groq":
            from groq import Groq as Client
        elif self.provider == "openai":
            from openai import OpenAI as Client
        elif self.provider == "anthropic":
            from anthropic import Anthropic as Client
        else:
            import litellm

            return litellm
        return Client(api_key=key)

    def call(self, prompt: str) -> str:
        self._client = self._client or self._open()
        ask = dict(model=self.model, max_tokens=1000, temperature=0.0, messages=[{"role": "user", "content": prompt}])
        if self.provider == "anthropic":
            return self._client.messages.create(**ask).content[0].text
        if self.provider == "litellm":
            return self._client.completion(**ask).choices[0].message.content or ""
        return self._client.chat.completions.create(response_format={"type": "json_object"}, **ask).choices[0].message.content or ""


def make_judge(spec: str) -> ProviderJudge:
    """``provider`` or ``provider:model``."""
    provider, _, model = spec.partition(":")
    return ProviderJudge(provider.strip().lower(), model)


@dataclass(frozen=True)
class ReplayJudge:
    """Answers from a table (``prompt_sha256, raw``): a join instead of calls."""

    responses: DataFrame
    model_id: str = "replay"


def call_judge(df: DataFrame, prompt: str, judge, out: str = "raw", concurrency: int | None = None) -> DataFrame:
    """Adds the judge's raw answer; each different prompt is asked once.

    ``concurrency`` bounds how many tasks call at a time.
    """
    key = F.sha2(F.col(prompt), 256)
    d = df.withColumn("_key", key)
    if isinstance(judge, ReplayJudge):
        answers = judge.responses.select(F.col("prompt_sha256").alias("_key"), F.col("raw").alias(out))
        return d.join(answers, "_key", "left").drop("_key")
    asked = d.select("_key", F.col(prompt).alias("_p")).dropDuplicates(["_key"])
    if concurrency:
        asked = asked.repartition(concurrency)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"_key": b["_key"], out: [judge.call(p) for p in b["_p"]]})

    return d.join(asked.mapInPandas(run, f"_key string, `{out}` string"), "_key", "left").drop("_key")


JUDGE_REASONS = {
    "empty": "There is no question or no answer.",
    "matched": "The answer is right: it equals the reference or the judge is sure of it.",
    "flagged": "The judge does not surely find the answer right.",
    "judge_error": "The judge's answer could not be parsed.",
}


def judge_answers(df: DataFrame, question: str, answer: str, gold: str | None, judge, *, answering_model_id: Column | str | None = None, out: str = "judge", concurrency: int | None = None) -> DataFrame:
    """Adds the result struct ``out``.

    Three ways, split by predicates before any Python runs: blank rows, rows
    whose answer agrees with the reference word by word, and rows that need a call.
    """
    q, a = coerce_text(question), coerce_text(answer)
    g = coerce_text(gold) if gold else F.lit("")
    has_gold = ~is_blank(g)
    model = F.lit(judge.model_id)
    other = F.lit(None).cast("string") if answering_model_id is None else (F.col(answering_model_id) if isinstance(answering_model_id, str) else answering_model_id)
    warning = J.same_family_warning(model, other)
    blank = is_blank(q) | is_blank(a)
    d = df.withColumn("_way", F.when(blank, "empty").when(has_gold & words_agree(a, g), "aligned").otherwise("call"))
    mode = F.when(has_gold, "reference_based").otherwise("reference_free")
    null = F.lit(None).cast("string")

    def detail(aligned=F.lit(None).cast("boolean"), confidence=null, reasoning=null, why=null, sent=null, raw=null, shown=F.lit(True)):
        return F.struct(
            F.when(shown, mode).alias("mode"), F.when(shown, model).alias("judge_model_id"), aligned.alias("aligned"), why.alias("reasoning"), confidence.alias("confidence"), reasoning.alias("judge_reasoning"),
            sent.alias("raw_confidence"), raw.alias("raw_response"), F.when(shown, warning).alias("self_enhancement_bias_warning"),
        )

    def said(label, passed, score, det):
        return result(label, passed, score, reason_of(label, JUDGE_REASONS), det)

    empty = d.filter("_way = 'empty'").withColumn(out, said(F.lit("empty"), F.lit(False), F.lit(0.0), detail(shown=F.lit(False))))
    same = d.filter("_way = 'aligned'").withColumn(out, said(F.lit("matched"), F.lit(True), F.lit(1.0), detail(aligned=F.lit(True), why=F.lit("The words agree; nothing was asked."))))
    need = d.filter("_way = 'call'")
    spans = align(F.when(has_gold, a), F.when(has_gold, g))
    need = need.withColumn("_spans", spans)
    need = need.withColumn("_prompt", F.when(has_gold, J.build_prompt("reference_based", q, F.col("_spans.mismatched_response"), F.col("_spans.mismatched_gold"))).otherwise(J.build_prompt("reference_free", q, a)))
    need = call_judge(need, "_prompt", judge, "_raw", concurrency).withColumn("_v", J.parse_judge("_raw"))
    bad = F.col("_v.score").isNull()
    passed = F.coalesce(J.judge_passes("_v.score", "_v.confidence"), F.lit(False))
    label = F.when(bad, "judge_error").when(passed, "matched").otherwise("flagged")
    sent = F.when(F.lower("_v.raw_confidence") != F.col("_v.confidence"), F.col("_v.raw_confidence"))
    det = detail(confidence=F.col("_v.confidence"), reasoning=F.col("_v.reasoning"), sent=sent, raw=F.when(bad, F.col("_raw")))
    need = need.withColumn(out, said(label, passed, F.coalesce("_v.score", F.lit(0.0)), det)).drop("_spans", "_prompt", "_raw", "_v")
    return empty.unionByName(same).unionByName(need).drop("_way")


def check_trace_with_judge(df: DataFrame, source: str, trace: str, judge, *, terms=None, out: str = "trace_check", concurrency: int | None = None) -> DataFrame:
    """The dictionary decides first, word agreement second; the rest is asked."""
    d = df.withColumn("_d", check_trace(source, trace, terms))
    same = words_agree(trace, source)
    way = F.when(F.col("_d.label") != "no_misread_detected", "dictionary").when(same, "aligned").otherwise("call")
    d = d.withColumn("_way", way)
    shape = lambda label, passed, used, aligned, conf: F.struct(
        passed.cast("double").alias("score"), passed.alias("passed"), label.alias("label"), F.col("_d.reason").alias("reason"),
        F.struct(F.col("_d.detail.dictionary_size").alias("dictionary_size"), F.col("_d.detail.flagged_terms").alias("flagged_terms"), used.alias("llm_fallback_used"), aligned.alias("aligned"), conf.alias("confidence")).alias("detail"),
    )
    none, nob = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    first = d.filter("_way = 'dictionary'").withColumn(out, shape(F.col("_d.label"), F.col("_d.passed"), nob, nob, none))
    second = d.filter("_way = 'aligned'").withColumn(out, shape(F.col("_d.label"), F.lit(True), F.lit(False), F.lit(True), none))
    third = d.filter("_way = 'call'").withColumn("_spans", align(trace, source))
    third = third.withColumn("_prompt", J.build_prompt("trace", None, F.col("_spans.mismatched_response"), F.col("_spans.mismatched_gold")))
    third = call_judge(third, "_prompt", judge, "_raw", concurrency).withColumn("_v", J.parse_trace_judge("_raw"))
    passed = ~F.col("_v.misread") & (F.col("_v.confidence") == "high")
    label = F.when(passed, "no_misread_detected").otherwise("misread_detected")
    third = third.withColumn(out, shape(label, passed, F.lit(True), F.lit(False), F.col("_v.confidence"))).drop("_spans", "_prompt", "_raw", "_v")
    return first.unionByName(second).unionByName(third).drop("_way", "_d")


ScoreFn = Callable[[Column, Column], Column]
