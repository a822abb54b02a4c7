"""Builders of questions from datasets that serve as held-out tasks, in the form of `datasets`: each takes the dataset's table
with an id and gives questions; rows that make no question go, sampling is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import builders as B
from . import sampling as S
from .datasets import EMPTY, letter, lettered, listed

#: What the questions ask.
ASKS = {
    "trec": "What kind of answer is this question asking for?",
    "emotion": "Which emotion does the writer mainly express?",
    "support_intent": "Which support intent should this message be routed to?",
    "ledgar": "What type of contract provision is this clause?",
    "offensive": "Is this tweet offensive?",
    "piqa": "Which solution achieves the goal?",
    "casehold": "Which holding fits the citation marked <HOLDING>?",
    "ethics": "Is what the narrator did clearly morally wrong by ordinary standards?",
    "isarcasm": "Is this text intended to be sarcastic?",
    "vast": "Determine the stance of the post toward the topic.",
    "tfns": "What market sentiment does this financial news post express?",
    "fpb": "From an investor's point of view, is this financial news sentence positive, negative or neutral?",
}
#: Classes in the order of their numbers, and what they mean.
ANSWERS = {
    "ABBR": "It asks for an abbreviation or its expansion.",
    "ENTY": "It asks for an entity (thing, object, animal, event, ...).",
    "DESC": "It asks for a description, definition or reason.",
    "HUM": "It asks for a person or group of people.",
    "LOC": "It asks for a location.",
    "NUM": "It asks for a number, date, quantity or amount.",
}
EMOTIONS = ["sadness", "joy", "love", "anger", "fear", "surprise"]
OFFENCE = {"not_offensive": "No, it is not offensive.", "offensive": "Yes, it is offensive (insults, threats, profanity aimed at someone)."}
MARKET = {"bearish": "Bearish: negative for the company or market", "bullish": "Bullish: positive for the company or market", "neutral": "Neutral or no clear direction"}
TONES = ["negative", "neutral", "positive"]
STANCES = ["against", "favor", "neutral"]
#: Longest clause, context and scenario (exclusive), in characters.
CLAUSE, CONTEXT, SCENARIO = 3000, 2500, 1200


def numbered(values: Column) -> Column:
    """Criteria of an array of texts by numbers from 1."""
    return F.transform(values, lambda v, i: F.struct((i + 1).cast("string").alias("key"), v.alias("desc")))


def number(i: Column) -> Column:
    """The key of the i-th of them, from 0."""
    return (i.cast("int") + 1).cast("string")


def state(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*((F.col(c) if isinstance(c, str) else c).alias(k) for k, c in fields.items())))


def classed(rows: DataFrame, name: str, classes: dict[str, str], label: str, qkey: str = "q1", **fields: Column | str) -> DataFrame:
    """Questions on one text whose options are a dataset's classes, by a class number."""
    gold = F.get(F.array(*map(F.lit, classes)), F.col(label).cast("int"))
    return B.choices(rows, name, F.col("id"), state(**fields), ASKS[name], listed(classes), gold, qkey)


def own_options(rows: DataFrame, name: str, ask: Column, criteria: Column, gold: Column, seen: Column | None = None) -> DataFrame:
    """Questions that bring their options along."""
    return B.choices(rows, name, F.col("id"), F.lit(EMPTY) if seen is None else seen, ask, criteria, gold, "q1")


def trec(rows: DataFrame) -> DataFrame:
    """Rows: id, text, coarse_label."""
    return classed(rows, "trec", ANSWERS, "coarse_label", question="text")


def emotion(rows: DataFrame) -> DataFrame:
    """Rows: id, text, label."""
    return classed(rows, "emotion", {e: e for e in EMOTIONS}, "label", text="text")


def siqa(rows: DataFrame) -> DataFrame:
    """Rows: id, context, question, answerA, answerB, answerC, label (a number, with white space)."""
    return own_options(rows, "siqa", F.col("question"), numbered(F.array("answerA", "answerB", "answerC")), F.trim("label"), state(context="context"))


def keyed(rows: DataFrame, name: str) -> DataFrame:
    """Rows: id, question, choices (label, text: arrays), answerKey; of csqa and qasc."""
    pairs = F.arrays_zip(F.col("choices.label").alias("key"), F.col("choices.text").alias("desc"))
    return own_options(rows, name, F.col("question"), F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), p["desc"].alias("desc"))), F.col("answerKey"))


def bitext(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows: id, instruction, intent; names: all intents, which stand in order, with spaces in what they mean."""
    known = {n: n.replace("_", " ") for n in sorted(names)}
    return B.choices(rows, "support_intent", F.col("id"), state(customer_message="instruction"), ASKS["support_intent"], listed(known), F.col("intent"), "q1")


def ledgar(rows: DataFrame, names: list[str], most: int = CLAUSE) -> DataFrame:
    """Rows: id, text, label."""
    return classed(rows, "ledgar", {n: n for n in names}, "label", contract_clause=F.substring("text", 1, most))


def logiqa(rows: DataFrame) -> DataFrame:
    """Rows: id, context, query, options, correct_option."""
    return own_options(rows, "logiqa", F.col("query"), numbered(F.col("options")), number(F.col("correct_option")), state(passage="context"))


def medmcqa(rows: DataFrame) -> DataFrame:
    """Rows: id, question, opa, opb, opc, opd, cop (from 0)."""
    return own_options(rows, "medmcqa", F.col("question"), numbered(F.array("opa", "opb", "opc", "opd")), number(F.col("cop")))


def offensive(rows: DataFrame) -> DataFrame:
    """Rows: id, text, label."""
    return classed(rows, "offensive", OFFENCE, "label", tweet="text")


def truthfulqa(rows: DataFrame) -> DataFrame:
    """Rows: id, question, mc1_targets (choices, labels): the first choice labelled 1 is right."""
    right = F.array_position(F.col("mc1_targets.labels"), 1).cast("string")
    return own_options(rows, "truthfulqa", F.col("question"), numbered(F.col("mc1_targets.choices")), right)


def strategyqa(rows: DataFrame) -> DataFrame:
    """Rows: id, question, answer."""
    return B.yes_no(rows, "strategyqa", F.col("id"), F.lit(EMPTY), F.col("question"), F.col("answer"), "q1")


def sciq(rows: DataFrame, seed: str = "sciq") -> DataFrame:
    """Rows: id, question, correct_answer, distractor1 to distractor3: options in the order of their draws."""
    ways = ("correct_answer", "distractor1", "distractor2", "distractor3")
    drawn = F.array_sort(F.array(*(F.struct(S.draw(seed, "id", F.lit(i)).alias("d"), F.lit(i == 0).alias("right"), F.col(c).alias("v")) for i, c in enumerate(ways))))
    rows = rows.withColumn("__o", drawn)
    return own_options(rows, "sciq", F.col("question"), numbered(F.transform("__o", lambda o: o["v"])), F.array_position(F.transform("__o", lambda o: o["right"]), True).cast("string"))


def piqa(rows: DataFrame) -> DataFrame:
    """Rows: id, goal, sol1, sol2, label (from 0)."""
    return own_options(rows, "piqa", F.lit(ASKS["piqa"]), numbered(F.array("sol1", "sol2")), number(F.col("label")), state(goal="goal"))


def aqua(rows: DataFrame) -> DataFrame:
    """Rows: id, question, options ("A)text"), correct."""
    part = lambda o, i: F.trim(F.get(F.split(o, r"\)", 2), F.lit(i)))
    return own_options(rows, "aqua", F.col("question"), F.transform("options", lambda o: F.struct(part(o, 0).alias("key"), part(o, 1).alias("desc"))), F.trim("correct"))


def casehold(rows: DataFrame, most: int = CONTEXT) -> DataFrame:
    """Rows: id, context, endings, label."""
    return own_options(rows, "casehold", F.lit(ASKS["casehold"]), numbered(F.col("endings")), number(F.col("label")), state(citing_context=F.substring("context", 1, most)))


def ethics(rows: DataFrame, below: int = SCENARIO) -> DataFrame:
    """Rows: id, input, label (1: wrong): scenarios below that length."""
    return B.yes_no(rows.filter(F.length("input") < below), "ethics", F.col("id"), state(scenario="input"), ASKS["ethics"], F.col("label").cast("int") == 1, "q1")


def isarcasm(rows: DataFrame) -> DataFrame:
    """Rows: id, tweet, sarcastic ("0" or "1"); others and empty texts go. Sarcastic ones, the minority, twice."""
    rows = rows.withColumn("tweet", F.trim("tweet")).filter((F.col("tweet") != "") & F.col("sarcastic").isin("0", "1"))
    rows = S.repeated(rows, F.col("sarcastic").cast("int") + 1).withColumn("id", F.concat_ws(".", "id", "copy"))
    text = F.regexp_extract(state(x="tweet"), r'(?s)^\{"x":(.*)\}$', 1)
    return B.choices(rows, "isarcasm", F.col("id"), text, ASKS["isarcasm"], listed({"no": "No", "yes": "Yes"}), F.when(F.col("sarcastic") == "1", "yes").otherwise("no"), "sarcastic")


def vast(rows: DataFrame, n: int, seed: str = "vast", same: int = 200) -> DataFrame:
    """Rows: new_id, post, topic_str, label: n of those that are first, in drawn order, of a topic and a post's beginning."""
    rows = rows.withColumn("__p", F.substring("post", 1, same)).withColumn("__d", S.draw(seed, "new_id"))
    rows = S.first_of(rows, ["__p", "topic_str"], ["__d", "new_id"]).orderBy("__d", "new_id").limit(n)
    ask = F.concat(F.lit("Topic: "), "topic_str", F.lit("\nPost: "), "post", F.lit("\n" + ASKS["vast"]))
    return own_options(rows.withColumn("id", F.col("new_id")), "vast", ask, lettered(F.array(*map(F.lit, STANCES))), letter(F.col("label")))


def tfns(rows: DataFrame) -> DataFrame:
    """Rows: id, text, label."""
    return classed(rows, "tfns", MARKET, "label", "sentiment", post="text")


def fpb(rows: DataFrame) -> DataFrame:
    """Rows: id, sentence, label: options without descriptions."""
    bare = F.array(*(F.struct(F.lit(t).alias("key"), F.lit(None).cast("string").alias("desc")) for t in TONES))
    return B.choices(rows, "fpb", F.col("id"), state(sentence="sentence"), ASKS["fpb"], bare, F.get(F.array(*map(F.lit, TONES)), F.col("label").cast("int")), "sentiment")
