"""The most similar rows by tokens, and templates of log lines: which lines they fit, and distractors that don't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sampling import draw, fraction, per_group

#: First candidates a row, in multiples of k: they only set the similarity to beat.
FIRST = 4
#: Templates of at most so many characters in all go to every task; beyond, templates and lines meet in a shuffle.
SENT = 4_000_000


def similar(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """a, b, sim, rank: for each row of left (id, tokens) the k most similar of right by Jaccard similarity of token sets, ties
    to the smaller id. Ids are unique on either side; a row isn't compared with its own id. Rows without any shared token have
    similarity 0 and aren't listed.

    Pairs come from rare tokens. The rarest ones of a row give it some candidates, and the k-th best of these a similarity s to
    reach; a row that reaches it shares more than the s * n most frequent tokens of the n, so these are never joined on. Pairs whose
    shared tokens so far and tokens to come can't reach s go before their token sets meet."""
    a = left.select(F.col("id").alias("a"), F.array_distinct("tokens").alias("ta"))
    b = right.select(F.col("id").alias("b"), F.array_distinct("tokens").alias("tb"))
    mine, posts = a.select("a", F.size("ta").alias("na"), F.explode("ta").alias("token")), b.select("b", F.size("tb").alias("nb"), F.explode("tb").alias("token"))
    df = posts.join(mine.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    own = Window.partitionBy("a")
    order = own.orderBy("df", "token")
    before = F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tokens = mine.join(df, "token").select("a", "na", "token", F.row_number().over(order).alias("i"), F.count("*").over(own).alias("m"), before.alias("before"))

    def checked(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("ta", "tb"))
        return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", (both / (F.size("ta") + F.size("tb") - both)).alias("sim"))

    some = tokens.filter(F.col("before") < FIRST * k).join(posts, "token").filter("a != b").select("a", "b").distinct()
    some = checked(per_group(some, ["a"], FIRST * k, ["b"]))
    reach = per_group(some, ["a"], k, [F.desc("sim"), "b"], "i").filter(F.col("i") == k).select("a", F.col("sim").alias("s"))
    asked = tokens.join(reach, "a", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    asked = asked.withColumn("p", F.least("m", F.col("m") - F.ceil(F.col("s") * F.col("na") - 1e-9) + 1)).filter("i <= p")
    pairs = asked.join(posts, "token").filter("a != b").groupBy("a", "b", "na", "nb", "m", "p", "s").agg(F.count("*").alias("c"))
    most = F.least(F.col("c") + F.col("m") - F.col("p"), F.col("na"), F.col("nb"))
    found = checked(pairs.filter(most >= F.col("s") * (F.col("na") + F.col("nb") - most) - 1e-9))
    return per_group(found, ["a"], k, [F.desc("sim"), "b"], "rank")


def fits(line: Column, template: Column) -> Column:
    """Whether the fixed parts of the template, between wildcards <*>, stand in the line in this order, apart from each other: what
    its pattern, found anywhere in the line, asks for. False for null."""

    def step(at: Column, part: Column) -> Column:
        found = F.call_function("locate", part, line, at)
        return F.when(at == 0, 0).when(part == "", at).otherwise(F.when(found > 0, found + F.length(part)).otherwise(0))

    return F.coalesce(F.aggregate(F.split(template, r"<\*>", -1), F.lit(1), step) > 0, F.lit(False))


def _held(templates: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How tables of a row a template, or of its words, are joined with lines. Lines are never the side that is held: their size is
    guessed from files that may be much smaller than their rows, and Spark would send all of them to the driver and every task."""
    size = templates.agg(F.sum(F.length("template") + 64)).first()[0] or 0
    return F.broadcast if size <= SENT else lambda df: df.hint("shuffle_hash")


def anchors(templates: DataFrame, lines: DataFrame, held: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """template columns (system, event, template) with token: of the words that stand whole in a fixed part, between characters that
    are no word's, the one that the fewest lines (system, line) have; null where there is none. A line that fits has it."""
    held = held or _held(templates)
    parts = F.split("template", r"<\*>", -1)
    whole = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])"), F.lit(0)))))
    each = templates.select("system", "event", "template", F.explode_outer(whole).alias("token"))
    known = each.select("system", "token").distinct()
    counts = lines.select("system", F.explode(_tokens("line")).alias("token")).join(held(known), ["system", "token"], "left_semi").groupBy("system", "token").agg(F.count("*").alias("n"))
    return per_group(each.join(held(counts), ["system", "token"], "left"), ["system", "event"], 1, [F.coalesce("n", F.lit(0)), F.asc_nulls_last("token")]).drop("n", "rn")


def _tokens(line: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(line, F.lit("[A-Za-z0-9]+"), F.lit(0)))


def fitting(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """system, line_id, event: the templates (system, event, template) that fit each line (system, line_id, line). A line is only held
    against templates whose rarest word it has, and those that have no whole word."""
    some, templates = lines.filter("line is not null"), templates.filter("template is not null")
    held = _held(templates)
    asked = anchors(templates, some, held)
    with_word = some.select("system", "line_id", "line", F.explode(_tokens("line")).alias("token")).join(held(asked.filter("token is not null")), ["system", "token"])
    without = some.select("system", "line_id", "line").join(held(asked.filter("token is null").drop("token")), "system")
    met = with_word.select("system", "line_id", "line", "event", "template").unionByName(without)
    # An array of one event or none, and no filter: Spark derives a filter on templates alone from that, which fails for want of the line.
    return met.select("system", "line_id", F.explode(F.when(fits(F.col("line"), F.col("template")), F.array("event"))).alias("event"))


def distractors(lines: DataFrame, templates: DataFrame, seed: str | int, least: int = 6, most: int = 8) -> DataFrame:
    """system, line_id, event, options: for each line (system, line_id, line, event) its event's template among `least` to `most` of its
    system's, in a drawn order. Two thirds of the others are the most similar ones by words, ties to the smaller event; the rest are
    drawn. None of them fits the line: it could have made it as well. Systems of fewer than four templates, and lines with fewer than
    three options, have no row."""
    sizes = templates.groupBy("system").agg(F.count("*").alias("size")).filter("size >= 4")
    n = F.least(F.floor(fraction(seed, F.lit("n"), "line_id") * (most - least + 1)) + least, F.col("size")).cast("int")
    asked = lines.join(sizes, "system").withColumn("n", n).withColumn("hard", F.greatest(F.lit(1), F.floor((F.col("n") - 1) * 2 / 3)).cast("int"))
    wrong = fitting(asked.select("system", "line_id", "line"), templates)
    out = asked.select("system", "line_id", "event", "n", "hard", "size").join(wrong.groupBy("system", "line_id").agg(F.collect_set("event").alias("wrong")), ["system", "line_id"], "left")
    out = out.withColumn("wrong", F.array_union(F.coalesce("wrong", F.array().cast(f"array<{wrong.schema['event'].dataType.simpleString()}>")), F.array("event")))
    # Neighbours that suffice: the hard ones and as many as may be left out.
    far = out.agg(F.max(F.col("hard") + F.size("wrong"))).first()[0] or 1
    words = templates.select(F.struct("system", "event").alias("id"), F.transform(T.letters("template"), lambda w: F.concat_ws("\t", "system", w)).alias("tokens"))
    near = similar(words, words, far).select("a.system", "a.event", F.col("b.event").alias("other"), "rank")
    hard = out.join(near, ["system", "event"]).filter(~F.array_contains("wrong", F.col("other")))
    hard = per_group(hard, ["system", "line_id"], F.col("hard"), ["rank"]).groupBy("system", "line_id").agg(F.collect_set("other").alias("picked"))
    out = out.join(hard, ["system", "line_id"], "left").withColumn("picked", F.coalesce("picked", F.slice("wrong", 1, 0)))
    # The rest: from a drawn place on, round the system's templates in a drawn order, past those that can't be taken.
    places = templates.select("system", F.col("event").alias("other"), (F.row_number().over(Window.partitionBy("system").orderBy(draw(seed, "event"), "event")) - 1).alias("place"))
    need = F.col("n") - 1 - F.size("picked")
    start = F.floor(fraction(seed, F.lit("at"), "line_id") * F.col("size"))
    steps = F.least(need + F.size("wrong") + F.size("picked"), F.col("size"))
    drawn = out.filter(need > 0).select("system", "line_id", need.alias("need"), "wrong", "picked", "size", start.alias("start"), F.posexplode(F.sequence(F.lit(0), steps.cast("int") - 1)).alias("step", "__s"))
    drawn = drawn.withColumn("place", ((F.col("start") + F.col("step")) % F.col("size")).cast("int")).join(places, ["system", "place"])
    drawn = drawn.filter(~F.array_contains("wrong", F.col("other")) & ~F.array_contains("picked", F.col("other")))
    drawn = per_group(drawn, ["system", "line_id"], F.col("need"), ["step"]).groupBy("system", "line_id").agg(F.collect_set("other").alias("drawn"))
    out = out.join(drawn, ["system", "line_id"], "left")
    options = F.concat("picked", F.coalesce("drawn", F.slice("wrong", 1, 0)), F.array("event"))
    mixed = F.transform(F.array_sort(F.transform(options, lambda e: F.struct(draw(seed, "line_id", e.cast("string")).alias("k"), e.alias("e")))), lambda x: x["e"])
    return out.select("system", "line_id", "event", mixed.alias("options")).filter(F.size("options") >= 3)
