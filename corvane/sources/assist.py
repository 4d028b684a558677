"""Titles asked of an assistant that a caller brings: any function from questions to answers.  None is asked by default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.titles import json_in

ANSWER = "title string, title_original string, year int, season int, episode int, artist string, album string, author string"


def question(path: Column, title: Column, year: Column, seen: Column) -> Column:
    """What is known of a file, one thing a line; nothing of what is null."""
    lines = F.array(F.lit("Which work is this file of? Answer with one JSON object of title, title_original, year, season, episode, artist, album and author."), F.concat(F.lit("path: "), path), F.concat(F.lit("title: "), title), F.concat(F.lit("year: "), year.cast("string")), F.concat(F.lit("seen in it: "), F.array_join(seen, "; ")))
    return F.array_join(F.array_compact(lines), "\n")


def identified(items: DataFrame, ask: Callable[[list[str]], list[str | None]], batch: int = 16) -> DataFrame:
    """(id, answer): what an assistant says of items (id, question), confidence 0.62; answers without a title are left out.

    ask: takes up to `batch` questions and gives their answers in order, None where it has none; it runs on the executors, in each task for
    itself.  An answer may hold its JSON in a marked block or in other text; what it doesn't name is null.
    """
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            asked = rows["question"].tolist()
            told = [a for i in range(0, len(asked), batch) for a in ask(asked[i : i + batch])]
            yield pd.DataFrame({"id": rows["id"], "text": pd.Series(told, dtype=object, index=rows.index)})

    kind = dict(items.dtypes)["id"]
    answers = items.filter("question is not null").select("id", "question").mapInPandas(run, f"id {kind}, text string")
    read = answers.select("id", F.from_json(json_in(F.col("text")), ANSWER).alias("a")).filter("trim(a.title) <> ''")
    return read.select("id", F.struct(F.lit("AiAssist").alias("source"), "a.*", F.lit(0.62).cast("float").alias("confidence")).alias("answer"))
