"""Records to labelled examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import records as R
from ..functions.json_text import leaves


def expand(questions: DataFrame, copies: int | None = None, seed: str = "0") -> DataFrame:
    """id, record_id, qkey, copy, order, labels, gold_key, gold of questions (record_id, qkey, kind, criteria, gold): shuffled
    copies, as many as asked for; if none are, two where there are few options, one else. A question goes without 2 to 255 options or without its gold among them."""
    q = questions.withColumn("criteria", R.criteria_of(F.col("kind"), F.col("criteria"))).withColumn("gold_key", F.when(F.col("kind") == "choice", F.col("gold")).otherwise(R.normal_gold(F.col("gold"))))
    size = F.size("criteria")
    q = q.filter(size.between(R.LEAST_OPTIONS, R.MOST_OPTIONS) & F.exists("criteria", lambda o: o["key"] == F.col("gold_key")))
    n = F.lit(copies) if copies is not None else F.when(size <= R.FEW_OPTIONS, 2).otherwise(1)
    q = q.withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))
    q = q.withColumn("id", F.concat_ws("#", "record_id", "qkey", F.col("copy").cast("string")))
    q = q.withColumn("options", R.shuffled(F.col("criteria"), F.concat_ws(":", F.lit(seed), "id")))
    order = F.transform("options", lambda o: o["key"])
    q = q.withColumn("order", order).withColumn("labels", F.slice(R.labels(), F.lit(1), F.size("order")))
    return q.withColumn("gold", F.element_at("labels", F.array_position("order", F.col("gold_key")).cast("int")))


def record_texts(questions: DataFrame) -> DataFrame:
    """record_id, text of questions (record_id, state, qkey, kind, instructions, criteria): the strings of a record, each on a line
    of its own: those of its state at any depth, then for each question, by qkey, its instructions and the descriptions of its
    options (a yes/no question's are everyone's). Line ends part segments and words alike, so pieces don't run across strings."""
    own = F.when(F.col("kind") == "choice", F.filter(F.transform("criteria", lambda o: o["desc"]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    each = questions.select("record_id", "state", F.struct("qkey", F.concat(F.array(F.coalesce("instructions", F.lit(""))), own).alias("parts")).alias("q"))
    by = each.groupBy("record_id").agg(F.min("state").alias("state"), F.array_sort(F.collect_list("q")).alias("qs"))
    return by.select("record_id", F.array_join(F.concat(leaves("state"), F.flatten(F.transform("qs", lambda q: q["parts"]))), "\n").alias("text"))


def attach(examples: DataFrame, teacher: DataFrame) -> DataFrame:
    """Examples with probs, by label, of teacher (record_id, qkey, probs by option key); null where the teacher has none."""
    return examples.join(teacher.select("record_id", "qkey", F.col("probs").alias("__p")), ["record_id", "qkey"], "left").withColumn("probs", F.when(F.col("__p").isNotNull(), D.remapped(F.col("__p"), F.col("order"), F.col("labels")))).drop("__p")


def blended(a: DataFrame, b: DataFrame, weight: float, keys: list[str]) -> DataFrame:
    """keys, probs: two teachers' distributions mixed; where one has none, the other's alone."""
    x, y = a.withColumnRenamed("probs", "__a"), b.withColumnRenamed("probs", "__b")
    return x.join(y, keys, "full").select(*keys, D.blend(F.col("__a"), F.col("__b"), weight).alias("probs"))


def averaged(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, option, p: mean over the teachers of a question, an option that a teacher lacks counting 0, normalised. What it is
    divided by is the sum over options, in their order, of what the teachers give each, so the order of rows doesn't show in it.
    labels: keys, teacher, option, p."""
    each = labels.groupBy(*keys, "option").agg(F.sum("p").alias("s"))
    whole = Window.partitionBy(*keys).orderBy("option").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = each.withColumn("z", F.sum("s").over(whole))
    return each.select(*keys, "option", (F.col("s") / F.when(F.col("z") == 0, F.lit(1.0)).otherwise(F.col("z"))).alias("p"))


def agreed(pairs: DataFrame, options: Column, a: Column, b: Column, veto: Column | None = None, yes_no: Column | None = None) -> DataFrame:
    """Rows on whose answer two distributions agree, without vetoed ones: choice added. The answer is the best option; where
    yes_no holds, whether true has half or more."""
    kind = F.lit(False) if yes_no is None else yes_no
    out = pairs.withColumn("choice", D.picked(options, a, kind)).filter(F.col("choice") == D.picked(options, b, kind))
    return out.filter(~veto) if veto is not None else out


def second_pass(examples: DataFrame, pattern: str) -> DataFrame:
    """All rows, and those whose source fits once more with ~2 on their id."""
    again = examples.filter(F.col("source").rlike(pattern)).withColumn("id", F.concat("id", F.lit("~2")))
    return examples.unionByName(again)


def assembled(parts: list[DataFrame], exclude: list[DataFrame], key: str = "id") -> DataFrame:
    """Parts one after the other without excluded keys; the first row of each key stays."""
    from .sampling import first_of

    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("__part", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    for ids in exclude:
        out = out.join(ids.select(key).distinct(), key, "left_anti")
    return first_of(out, [key], ["__part"]).drop("__part")
