"""Builders of decision questions from public datasets. Each takes the dataset's table, under its own column names, and gives
questions (record_id, source, state, qkey, kind, instructions, criteria, gold); rows that make no question go. Sampling is left
to the caller (`sampling.sample`), but for caps by class, which are part of a builder."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import builders as B
from . import sampling as S

EMPTY = "{}"
#: Names of relevance classes and what they mean.
RELEVANCE = {
    "E": "Exact: the product satisfies the search query.",
    "S": "Substitute: a product that could substitute for the requested product.",
    "C": "Complement: a product that complements the requested product.",
    "I": "Irrelevant: the product does not address the requested product need.",
}
#: What the questions ask.
ASKS = {
    "anli": "Classify the relationship between the premise and hypothesis.",
    "winogrande": "Which option correctly fills the blank?",
    "hellaswag": "Which continuation is most plausible?",
    "ragtruth": "The response contains content that is not supported by the context in the prompt.",
    "nli4ct": "Classify the statement against the supplied clinical trial evidence:",
    "supergpqa": "Which option is the correct answer?",
    "corr2cause": "Is the hypothesis valid?",
    "banking77": "Classify the banking intent of this user request:",
    "clinc": "Classify the intent of this user request, or choose out of scope if none applies:",
    "esci": "Classify the relevance of this product to the search query using the ESCI categories.",
    "when2call": "Which response should the assistant give to the user's question, given the available tools?",
    "newyorker": "Which caption was written for this cartoon?",
}


def letter(i: Column) -> Column:
    """The i-th capital letter, from 0."""
    return F.get(F.array(*map(F.lit, string.ascii_uppercase)), i.cast("int"))


def lettered(values: Column) -> Column:
    """Criteria of an array of texts by capital letters."""
    return F.transform(values, lambda v, i: F.struct(letter(i).alias("key"), v.alias("desc")))


def listed(texts: dict[str, str]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("key"), F.lit(d).alias("desc")) for k, d in texts.items()))


def asked(name: str, *more: Column) -> Column:
    """What a builder asks and, each on its line, what about; null if that is."""
    return F.concat(F.lit(ASKS[name]), *(F.concat(F.lit("\n"), m) for m in more))


def anli(rows: DataFrame) -> DataFrame:
    """Rows: uid, premise, hypothesis, label (0 to 2)."""
    ask = asked("anli", F.concat(F.lit("Premise: "), F.col("premise")), F.concat(F.lit("Hypothesis: "), F.col("hypothesis")))
    names = F.array(*map(F.lit, ("entailment", "neutral", "contradiction")))
    return B.choices(rows, "anli", F.col("uid"), F.lit(EMPTY), ask, lettered(names), letter(F.col("label")))


def winogrande(rows: DataFrame) -> DataFrame:
    """Rows: id, sentence, option1, option2, answer (1 or 2)."""
    return B.choices(rows, "winogrande", F.col("id"), F.lit(EMPTY), asked("winogrande", F.col("sentence")), lettered(F.array("option1", "option2")), letter(F.col("answer").cast("int") - 1))


def hellaswag(rows: DataFrame) -> DataFrame:
    """Rows: ind, ctx, endings, label."""
    return B.choices(rows, "hellaswag", F.col("ind"), F.lit(EMPTY), asked("hellaswag", F.col("ctx")), lettered(F.col("endings")), letter(F.col("label")))


def ragtruth(rows: DataFrame) -> DataFrame:
    """Rows: id, query, context, output, hallucination_labels (a JSON list): yes where the list has entries."""
    state = F.to_json(F.struct(F.concat_ws("\n", "query", "context").alias("prompt"), F.col("output").alias("response")))
    found = F.json_array_length("hallucination_labels") > 0
    return B.yes_no(rows, "ragtruth", F.col("id"), state, ASKS["ragtruth"], found)


def nli4ct(rows: DataFrame) -> DataFrame:
    """Rows: id, Primary_id, Section_id, Primary_ct, Secondary_id, Secondary_ct, Statement, Label; the second trial may be absent."""
    trial = lambda which: F.struct(F.col(f"{which}_id").alias("id"), F.col("Section_id").alias("section"), F.col(f"{which}_ct").alias("text"))
    second = F.when(F.coalesce("Secondary_id", F.lit("")) != "", trial("Secondary"))
    state = F.to_json(F.struct(trial("Primary").alias("primary_trial"), second.alias("secondary_trial")))
    said = {"Entailment": "The clinical trial evidence entails the statement.", "Contradiction": "The clinical trial evidence contradicts the statement."}
    return B.choices(rows, "nli4ct", F.col("id"), state, asked("nli4ct", F.col("Statement")), listed(said), F.col("Label"), qkey="answer")


def supergpqa(rows: DataFrame) -> DataFrame:
    """Rows: uuid, question, options, answer_letter: questions of 2 to 10 options."""
    rows = rows.filter(F.size("options").between(2, 10))
    state = F.regexp_extract(F.to_json(F.struct(F.col("question").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return B.choices(rows, "supergpqa", F.col("uuid"), state, ASKS["supergpqa"], lettered(F.col("options")), F.col("answer_letter"))


def mmlu_aux(rows: DataFrame) -> DataFrame:
    """Rows: id, train (question, choices, answer)."""
    return B.choices(rows, "mmlu_aux", F.col("id"), F.lit(EMPTY), F.col("train.question"), lettered(F.col("train.choices")), letter(F.col("train.answer")))


def corr2cause(rows: DataFrame) -> DataFrame:
    """Rows: id, input, label (1 for yes)."""
    ask = F.concat(F.col("input"), F.lit("\n\n" + ASKS["corr2cause"]))
    return B.choices(rows, "corr2cause", F.col("id"), F.lit(EMPTY), ask, listed({"A": "yes", "B": "no"}), F.when(F.col("label").cast("int") == 1, "A").otherwise("B"))


def intents(rows: DataFrame, name: str, names: list[str], label: str) -> DataFrame:
    """Requests (id, text, and a class number): options by position, the classes' names as they are."""
    return B.choices(rows, name, F.col("id"), F.lit(EMPTY), asked(name, F.col("text")), B.positional(F.array(*map(F.lit, names))), F.concat(F.lit("option_"), F.col(label).cast("int").cast("string")))


def banking77(rows: DataFrame, names: list[str]) -> DataFrame:
    return intents(rows, "banking77", names, "label")


def clinc(rows: DataFrame, names: list[str]) -> DataFrame:
    """Names with spaces for underscores; oos is out of scope."""
    return intents(rows, "clinc", ["out of scope" if x == "oos" else x.replace("_", " ") for x in names], "intent")


def esci(rows: DataFrame, most: int, seed: str) -> DataFrame:
    """Rows: example_id, query, product_locale, esci_label, product_title, product_description, product_bullet_point, product_brand,
    product_color: American ones, at most a quarter of `most` of each class; what a product lacks isn't in its state."""
    rows = rows.withColumn("class", F.upper(F.substring("esci_label", 1, 1))).filter((F.col("product_locale") == "us") & F.col("class").isin(*RELEVANCE))
    rows = S.per_group(rows.withColumn("__d", S.draw(seed, "example_id")), ["class"], most // len(RELEVANCE), ["__d", "example_id"])
    product = F.struct(*(F.nullif(F.col(f"product_{k}"), F.lit("")).alias(k) for k in ("title", "description", "bullet_point", "brand", "color")))
    state = F.to_json(F.struct(F.trim("query").alias("search_query"), product.alias("product")))
    return B.choices(rows, "esci", F.col("example_id"), state, ASKS["esci"], listed(RELEVANCE), F.col("class"), qkey="answer")


def when2call(rows: DataFrame) -> DataFrame:
    """Rows: id, messages (role, content), tools (JSON texts), chosen, rejected: the last user message and two answers, calls
    without their wrapping; rows without a user message go."""
    user = F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(-1))["content"]
    bare = lambda c: F.regexp_replace(F.trim(c), r"(?s)^<TOOLCALL>\[(.*)\]</TOOLCALL>$", "$1")
    rows = rows.withColumn("user", user).filter(F.coalesce("user", F.lit("")) != "")
    state = F.concat(F.lit('{"tools":['), F.array_join("tools", ","), F.lit("],"), F.substring(F.to_json(F.struct(F.col("user").alias("question"))), 2, 2**31 - 1))
    return B.choices(rows, "when2call", F.col("id"), state, ASKS["when2call"], lettered(F.array(bare(F.col("chosen")), bare(F.col("rejected")))), F.lit("A"))


def newyorker(rows: DataFrame) -> DataFrame:
    """Rows: instance_id, image_location, image_description, image_uncanny_description, entities, caption_choices, label."""
    state = F.to_json(F.struct(F.col("image_location").alias("scene"), F.col("image_description").alias("description"), F.col("image_uncanny_description").alias("uncanny_description"), "entities"))
    return B.choices(rows, "newyorker", F.col("instance_id"), state, ASKS["newyorker"], lettered(F.col("caption_choices")), F.col("label"))
