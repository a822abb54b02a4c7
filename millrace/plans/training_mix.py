"""The chains from records to training examples, from reviews to a split table, and from two runs to a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as T
from ..operators import decontam as X
from ..operators import metrics as M
from ..operators import records as O
from ..operators import reviews as V
from ..operators import sampling as S


def training_mix(questions: DataFrame, suite: DataFrame, teacher: DataFrame, quotas: dict[str, int], seed: str, copies: int | None = None) -> DataFrame:
    """Labelled examples of questions (record_id, source, state, qkey, kind, instructions, criteria, gold) that share nothing with
    the suite (item_id, text) in any of their texts: quotas by source prefix, sources and classes in turn, options shuffled, the teacher's distributions by label,
    prompts rendered."""
    dirty = X.verdicts(O.record_texts(questions), suite, key="record_id").select("record_id")
    clean = questions.join(dirty, "record_id", "left_anti").withColumn("bucket", S.first_bucket(F.col("source"), list(quotas)))
    quota: Column = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col("bucket") == name, n).otherwise(quota)
    mixed = S.round_robin(clean, ["source", "gold"], max(quotas.values()), seed, "record_id", ["bucket"]).filter(F.col("pos") <= quota).drop("rn", "pos")
    examples = O.attach(O.expand(mixed, copies, seed), teacher)
    prompt = R.decision_prompt(F.col("state"), F.col("instructions"), F.col("options"), F.col("labels"))
    return examples.withColumn("prompt", prompt).select("id", "source", "prompt", "labels", "gold", "order", "probs")


def review_table(changes: DataFrame, scores: DataFrame, seed: str) -> DataFrame:
    """repo, number, split, outcome, score: scored changes (repo, number, title, body, author, reviews, commits, threads) with
    their outcome, whole repositories in one split; those without a score are told by a null score."""
    undone = V.reverted(changes.select("repo", "number", "title", "body")).withColumn("reverted", F.lit(True))
    split = S.group_split(changes, "repo", seed)
    rows = changes.join(undone, ["repo", "number"], "left").join(scores, ["repo", "number"], "left").join(split, "repo")
    result = V.outcome(F.col("author"), F.col("reviews"), F.col("commits"), F.col("threads"), F.coalesce("reverted", F.lit(False)))
    return rows.select("repo", "number", "split", result.alias("outcome"), "score")


def regression_gate(old: DataFrame, new: DataFrame, gold: DataFrame, protected: list[str]) -> DataFrame:
    """The gate of two runs (run_id, dataset, qkey, answer) against gold (run_id, qkey, gold); of rows that a run repeats, the one
    with the highest position counts."""
    last = lambda df, name: S.last_of(df, ["run_id", "qkey"], "position").select("run_id", "qkey", "dataset", F.col("answer").alias(name))
    pairs = last(old, "a").join(last(new, "b").drop("dataset"), ["run_id", "qkey"]).join(gold, ["run_id", "qkey"])
    right = lambda c: R.normal_gold(F.col(c)) == R.normal_gold(F.col("gold"))
    return M.gate(pairs.withColumn("was", right("a")).withColumn("now", right("b")), "dataset", "was", "now", protected)


def host_view(pages: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Texts of pages whose host isn't excluded."""
    return pages.filter(~T.in_domain("url", excluded)).select("page_id", T.host("url").alias("host"), T.strip_html("html").alias("text"))
