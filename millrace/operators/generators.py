"""Questions with answers by construction, one for each row of a table of ids (id). Numbers come from md5(seed:id:name), so any
engine can make the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(seed: str, ident: Column, name: str, n: int) -> Column:
    """A whole number from 0 to n - 1."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), ident.cast("string"), F.lit(name))), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def dates(ids: DataFrame, seed: str = "dates") -> DataFrame:
    """id, state, answer, options: a day so many days or weeks from another, and six wrong ones about it."""
    i = F.col("id")
    base = F.date_add(F.lit("2000-01-01").cast("date"), pick(seed, i, "day", 9000).cast("int"))
    amount, weeks = (pick(seed, i, "amount", 30) + 1).cast("int"), pick(seed, i, "unit", 2) == 1
    shift = F.when(weeks, amount * 7).otherwise(amount)
    show = lambda d: F.date_format(d, "MM/dd/yyyy")
    answer = F.date_add(base, shift)
    wrong = F.array(*(show(F.date_add(answer, k)) for k in (-7, -2, -1, 1, 2, 7)))
    state = F.concat(F.lit("Today is "), show(base), F.lit("; what is the date in "), amount.cast("string"), F.when(weeks, " weeks?").otherwise(" days?"))
    return ids.select("id").select("id", state.alias("state"), show(answer).alias("answer"), F.array_sort(F.concat(F.array(show(answer)), wrong)).alias("options"))


def ordinals(ids: DataFrame, size: int = 7, seed: str = "ordinals") -> DataFrame:
    """id, items, k, smallest, largest: the k-th smallest and largest of a list of distinct numbers."""
    i = F.col("id")
    rows = ids.select("id").select("id", F.array(*((pick(seed, i, f"x{j}", 90) + 100 * j) for j in range(size))).alias("up"), (pick(seed, i, "k", size) + 1).cast("int").alias("k"))
    mixed = F.transform(F.array_sort(F.transform("up", lambda x: F.struct(F.md5(F.concat_ws(":", i.cast("string"), x.cast("string"))).alias("h"), x.alias("x")))), lambda s: s["x"])
    return rows.select("id", mixed.alias("items"), "k", F.element_at("up", F.col("k")).alias("smallest"), F.element_at("up", -F.col("k")).alias("largest"))


def navigation(ids: DataFrame, steps: int = 6, seed: str = "navigate") -> DataFrame:
    """id, state, x, y, back: where so many steps lead, and whether back to the start: a fold over the steps."""
    i = F.col("id")
    walk = F.array(*(F.struct(pick(seed, i, f"d{j}", 4).alias("d"), (pick(seed, i, f"l{j}", 5) + 1).alias("l")) for j in range(steps)))
    names = F.array(*map(F.lit, ("north", "east", "south", "west")))
    rows = ids.select("id").withColumn("walk", walk)

    def fold(plus: int, minus: int) -> Column:
        return F.aggregate("walk", F.lit(0).cast("bigint"), lambda a, s: a + F.when(s["d"] == plus, s["l"]).when(s["d"] == minus, -s["l"]).otherwise(0))

    text = F.array_join(F.transform("walk", lambda s: F.concat(F.lit("Go "), s["l"].cast("string"), F.lit(" "), F.get(names, s["d"].cast("int")), F.lit("."))), " ")
    return rows.select("id", text.alias("state"), fold(1, 3).alias("x"), fold(0, 2).alias("y")).withColumn("back", (F.col("x") == 0) & (F.col("y") == 0))


def tracking(ids: DataFrame, people: tuple[str, ...] = ("Ann", "Bea", "Cal", "Dee"), swaps: int = 5, seed: str = "tracking") -> DataFrame:
    """id, swaps, holder: who holds the first item after the swaps: a fold over them."""
    i = F.col("id")
    pairs = F.array(*(F.struct(pick(seed, i, f"a{j}", len(people)).alias("a"), F.pmod(pick(seed, i, f"a{j}", len(people)) + 1 + pick(seed, i, f"b{j}", len(people) - 1), F.lit(len(people))).alias("b")) for j in range(swaps)))
    at = F.aggregate("pairs", F.lit(0).cast("bigint"), lambda p, s: F.when(p == s["a"], s["b"]).when(p == s["b"], s["a"]).otherwise(p))
    names = F.array(*map(F.lit, people))
    text = F.array_join(F.transform("pairs", lambda s: F.concat(F.get(names, s["a"].cast("int")), F.lit("-"), F.get(names, s["b"].cast("int")))), " ")
    return ids.select("id").withColumn("pairs", pairs).select("id", text.alias("swaps"), F.get(names, at.cast("int")).alias("holder"))


def truth_chains(ids: DataFrame, length: int = 5, seed: str = "lies") -> DataFrame:
    """id, says, truthful: each says that the one before tells the truth or lies: does the last tell the truth?"""
    i = F.col("id")
    says = F.array(*((pick(seed, i, f"s{j}", 2) == 1) for j in range(length)))
    fold = F.aggregate("said", F.lit(True), lambda t, s: t == s)
    return ids.select("id").withColumn("said", says).select("id", F.array_join(F.transform("said", lambda s: F.when(s, "truth").otherwise("lie")), " ").alias("says"), fold.alias("truthful"))


def sums(ids: DataFrame, seed: str = "sums") -> DataFrame:
    """id, state, answer, options: arithmetic with ten options."""
    i = F.col("id")
    a, b, c = (pick(seed, i, k, 90) + 10 for k in "abc")
    answer = a * b - c
    return ids.select("id").select("id", F.concat_ws(" ", a.cast("string"), F.lit("*"), b.cast("string"), F.lit("-"), c.cast("string")).alias("state"), answer.alias("answer"), F.array(*(answer + k for k in (-20, -10, -2, -1, 0, 1, 2, 10, 20, 100))).alias("options"))
