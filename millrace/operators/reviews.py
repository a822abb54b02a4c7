"""Outcome labels of reviewed changes. Nested lists are handled by array functions, so a change is one row throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of the names of automatic accounts.
BOTS = ("dependabot", "renovate", "github-actions", "snyk", "greenkeeper", "pre-commit-ci", "mergify", "copilot", "codecov", "sonarcloud", "coderabbit")


def is_bot(login: Column, names: tuple[str, ...] = BOTS) -> Column:
    low = F.lower(login)
    return login.isNull() | (login == "") | login.endswith("[bot]") | low.rlike("|".join(names))


def outcome(author: Column, reviews: Column, commits: Column, threads: Column, reverted: Column) -> Column:
    """yes, no, ambiguous, bot_author or no_human_review. reviews: array<struct<login, state, at>>, commits: array of times.
    yes: changes were asked for, or it was reworked after the first review with two threads or more, or has four threads or
    more, or was reverted. no: approved without rework and with one thread at most."""
    human = F.filter(reviews, lambda r: ~is_bot(r["login"]) & ~r["login"].eqNullSafe(author))
    first = F.array_min(F.transform(human, lambda r: r["at"]))
    rework = F.size(F.filter(commits, lambda c: c > first))
    asked = F.exists(human, lambda r: r["state"] == "CHANGES_REQUESTED")
    approved = F.exists(human, lambda r: r["state"] == "APPROVED")
    yes = asked | ((rework >= 1) & (threads >= 2)) | (threads >= 4) | reverted
    return F.when(is_bot(author), "bot_author").when(F.size(human) == 0, "no_human_review").when(yes, "yes").when(approved & (threads <= 1) & (rework == 0), "no").otherwise("ambiguous")


def reverted(changes: DataFrame) -> DataFrame:
    """repo, number of changes (repo, number, title, body) that another one of the repository reverts, by quoted title or number."""
    undo = changes.filter(F.lower("title").startswith("revert"))
    title = F.regexp_extract("title", r'(?i)^revert\s+"(.+)"', 1)
    number = F.regexp_extract(F.concat_ws(" ", "title", F.substring("body", 1, 300)), r"#(\d+)", 1).try_cast("bigint")
    by_title = undo.select("repo", title.alias("title")).filter("title != ''").distinct()
    by_number = undo.select("repo", number.alias("number")).filter("number is not null").distinct()
    # Of several changes with one title, the latest.
    latest = changes.groupBy("repo", "title").agg(F.max("number").alias("number"))
    hit = latest.join(by_title, ["repo", "title"], "left_semi").select("repo", "number")
    return hit.unionByName(changes.select("repo", "number").join(by_number, ["repo", "number"], "left_semi")).distinct()


def eligible(repos: DataFrame, least_merged: int = 150, least_human: int = 10, least_rate: float = 0.4) -> DataFrame:
    """Repositories with enough merged changes, human ones and reviews among these (repo, merged, author, reviewed)."""
    human = ~is_bot(F.col("author"))
    by = repos.groupBy("repo").agg(F.sum(F.col("merged").cast("int")).alias("n_merged"), F.sum(human.cast("int")).alias("n_human"), F.avg(F.when(human, F.col("reviewed").cast("int"))).alias("rate"))
    return by.filter((F.col("n_merged") >= least_merged) & (F.col("n_human") >= least_human) & (F.col("rate") >= least_rate))
