"""Teachers' labels on questions: which teachers count for a source, their average, fall-backs, and a student's targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from .records import averaged
from .sampling import per_group


def by_prefix(sources: DataFrame, rules: DataFrame, longest: bool = False) -> DataFrame:
    """source and the columns of each rule (prefix, ...) whose prefix the source starts with; with `longest`, of the longest such
    prefixes alone. Each distinct source is cut into its prefixes, as long as there are in the rules, so rules are met by equality."""
    lengths = sorted(r.n for r in rules.select(F.length("prefix").alias("n")).distinct().collect() if r.n is not None)  # a few numbers
    each = sources.select("source").distinct().filter("source is not null")
    each = each.select("source", F.explode(F.array(*(F.lit(n) for n in lengths)) if lengths else F.array().cast("array<int>")).alias("__n")).filter(F.col("__n") <= F.length("source"))
    met = each.withColumn("prefix", F.substring("source", F.lit(1), F.col("__n"))).join(rules, "prefix")
    if longest:
        top = met.groupBy("source").agg(F.max("__n").alias("__n"))
        met = met.join(top, ["source", "__n"])
    return met.drop("__n")


def attached(questions: DataFrame, labels: DataFrame, rules: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """qid, status, probs for questions (qid, source). labels (teacher, qid, probs) of the teachers that rules (prefix, teacher) name for
    the source, as often as they name them, are averaged, an option that one lacks counting 0. Without any, the label of the first of
    fallbacks (teacher, priority) that has one, divided by its sum unless that is 1 already. status: <n>_teachers, fallback or none; probs null for none."""
    who = by_prefix(questions, rules).select("source", "teacher")
    asked = questions.select("qid", "source").distinct()
    own = asked.join(who, "source").join(labels, ["teacher", "qid"])
    each = own.select("qid", "teacher", F.explode("probs").alias("option", "p"))
    n = own.groupBy("qid").agg(F.count("*").alias("n"))
    main = averaged(each, ["qid"]).groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("option", "p")))).alias("probs")).join(n, "qid")
    main = main.select("qid", F.concat(F.col("n").cast("string"), F.lit("_teachers")).alias("status"), "probs")
    spare = asked.join(main, "qid", "left_anti").join(labels, "qid").join(fallbacks, "teacher")
    spare = per_group(spare, ["qid"], 1, ["priority", "teacher"]).select("qid", F.lit("fallback").alias("status"), F.when(F.abs(D.total(F.col("probs")) - 1) < 1e-9, F.col("probs")).otherwise(D.normalised(F.col("probs"))).alias("probs"))
    found = main.unionByName(spare)
    return asked.select("qid").distinct().join(found, "qid", "left").withColumn("status", F.coalesce("status", F.lit("none")))


def student_targets(examples: DataFrame, own: DataFrame, weight: float = 0.5) -> DataFrame:
    """id, how, probs for examples (id, replay, probs): the student's own teacher (id, probs) mixed with the example's, the own one alone
    where it is a replay or has none. A second-pass id ...~2 goes by the first one's. how: blend, own or missing (probs null)."""
    base = F.when(F.col("id").endswith("~2"), F.expr("substring(id, 1, length(id) - 2)")).otherwise(F.col("id"))
    rows = examples.select("id", base.alias("base"), F.when(~F.coalesce("replay", F.lit(False)), F.col("probs")).alias("ext"))
    rows = rows.join(own.select(F.col("id").alias("base"), F.col("probs").alias("own")), "base", "left")
    how = F.when(F.col("own").isNull(), "missing").when(F.col("ext").isNull(), "own").otherwise("blend")
    return rows.select("id", how.alias("how"), F.when(F.col("own").isNotNull(), D.blend(F.col("own"), F.col("ext"), weight)).alias("probs"))


def agreement(targets: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """by, agree, disagree: whether the best option of probs, ties to the first by name, is the gold one (id, gold)."""
    best = D.argmax(F.array_sort(F.map_keys("probs")), F.col("probs"))
    rows = targets.filter("probs is not null").join(gold, "id").withColumn("__ok", (best == F.col("gold")).cast("int"))
    return rows.groupBy(by).agg(F.sum("__ok").alias("agree"), F.sum(1 - F.col("__ok")).alias("disagree"))
