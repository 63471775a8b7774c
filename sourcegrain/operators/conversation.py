"""Questions about a method in turn: whether one wants detail, the prompt with the last turns, and answers without debris."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bind
from .prompts import fence, without_emphasis

#: What asks for a detailed answer, in any case; how many turns a prompt looks back; the first line of a prompt.
DETAIL_WORDS = ("detail", "detailed", "elaborate", "in depth", "in-depth", "thorough", "thoroughly", "comprehensive", "explain fully", "fully explain", "step by step", "step-by-step", "at length", "more detail")
HISTORY = 4
CONCISE = "Answer the question about this method using the metadata below. Be concise."
DETAILED = "Answer the question about this method using the metadata below. Give a detailed, thorough answer that covers relevant edge cases."
NO_QUESTION = "[Please enter a question.]"


def wants_detail(question: Column) -> Column:
    return F.lower(question).rlike("|".join(DETAIL_WORDS))


def clean_answer(answer: Column) -> Column:
    """An answer without emphasis, and without last lines that are blank, a lone mark or a lone number; blank and bracketed ones stay as they are."""
    debris = lambda line: F.trim(F.regexp_replace(line, r"[\t\r]", " ")).rlike(r"^(?:|[>*-]|\d+[.)]?)$")

    def kept(lines: Column) -> Column:
        last = F.array_max(F.transform(lines, lambda line, i: F.when(~debris(line), i + 1)))
        return F.array_join(F.slice(lines, 1, F.coalesce(last, F.lit(0))), "\n")

    tidy = F.regexp_replace(without_emphasis(bind(F.split(F.replace(answer, F.lit("\r\n"), F.lit("\n")), "\n", -1), kept)), r"(?U)^\s+|\s+$", "")
    return F.when(answer.rlike(r"(?U)^\s*(?:\[|$)"), answer).otherwise(tidy)


def conversation_prompts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, detailed, prompt of every question. A prompt holds the last HISTORY turns before it, so each is made in a window of as many rows.

    turns: conv_id, turn, question, answer (that was given), context (what is known of the method), explanation, language_note (may be empty).
    A blank question has no prompt but a message, and is no turn for those after it."""
    blank = F.trim(F.regexp_replace(F.coalesce("question", F.lit("")), r"(?U)\s", " ")) == ""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-HISTORY, -1)
    asked = turns.filter(~blank).withColumn("_turn", F.concat(F.lit("Q: "), "question", F.lit("\nA: "), clean_answer(F.coalesce("answer", F.lit(""))), F.lit("\n")))
    rows = asked.withColumn("_history", F.array_join(F.collect_list("_turn").over(before), "")).withColumn("detailed", wants_detail(F.col("question")))
    prompt = F.concat(
        F.when(F.col("detailed"), DETAILED).otherwise(CONCISE), F.lit("\n"), F.when(F.coalesce("language_note", F.lit("")) != "", F.concat("language_note", F.lit("\n"))).otherwise(""), F.lit("\n"),
        fence(F.concat("context", F.lit("\nInitial explanation: "), "explanation")), F.lit("\n\n"), F.when(F.col("_history") != "", F.concat(F.lit("Conversation so far:\n"), "_history", F.lit("\n"))).otherwise(""), F.lit("Question: "), "question", F.lit("\nAnswer:"),
    )
    return rows.select("conv_id", "turn", "detailed", prompt.alias("prompt")).unionByName(turns.filter(blank).select("conv_id", "turn", F.lit(False).alias("detailed"), F.lit(NO_QUESTION).alias("prompt")))
