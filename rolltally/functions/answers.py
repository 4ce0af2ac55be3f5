"""Final answers: extraction from ``\\boxed{...}``, normalisation and equivalence keys."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rolltally.functions import terms

# Markers in model output and the text shown when there is no answer.
THINK_END = "</think>"
BOX = "\\boxed"
BOX_OPEN = "\\boxed{"
NO_ANSWER = "[No boxed answer found]"

_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]++|[\s\x1c-\x1f]++\z"
_ANY_SPACE = r"(?U)[\s\x1c-\x1f]+"
_NUMBER = r"\d+(?:\.\d+)?"
_WHOLE_TEXT = 2147483647


def strip(text: Column) -> Column:
    """Trim every kind of white space; Spark's ``trim`` knows the plain space only."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def has_answer(answer: Column) -> Column:
    """Voting counts a missing and an empty answer alike; never null."""
    return F.coalesce(answer != "", F.lit(False))


def brace_content(body: Column) -> Column:
    """Text up to the brace closing the one that was open when ``body`` starts, else null.

    Without an inner brace the places of two braces are enough. Otherwise a fold over the pieces between
    braces adds up depth and length only, so the work stays linear in the text.
    """
    pieces = F.regexp_extract_all(body, F.lit(r"([{}]|[^{}]++)"), F.lit(1))

    def step(state: Column, piece: Column) -> Column:
        turn = F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        return F.when(state["depth"] == 0, state).otherwise(
            F.struct((state["depth"] + turn).alias("depth"), (state["size"] + F.length(piece)).alias("size"))
        )

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))
    size = F.aggregate(pieces, start, step, lambda s: F.when(s["depth"] == 0, s["size"] - 1))
    opened, closed = F.instr(body, "{"), F.instr(body, "}")
    flat = (closed > 0) & ((opened == 0) | (opened > closed))
    return F.when(flat, F.substring(body, F.lit(1), closed - 1)).otherwise(F.substring(body, F.lit(1), size))


def after_first_box(text: Column) -> Column:
    """What follows the first box after the last end-of-thinking mark; null without a box."""
    spoken = F.substring_index(text, THINK_END, -1)
    at = F.instr(spoken, BOX_OPEN)
    return F.when(at > 0, F.substring(spoken, at + len(BOX_OPEN), F.lit(_WHOLE_TEXT)))


def after_last_box(text: Column) -> Column:
    """What follows the last box anywhere; null when its brace does not come right after it."""
    tail = F.substring_index(text, BOX, -1)
    return F.when(
        (F.instr(text, BOX) > 0) & tail.startswith("{"), F.substring(tail, F.lit(2), F.lit(_WHOLE_TEXT))
    )


def extract_boxed_first(text: Column) -> Column:
    """Answer for voting; null without a closed box, ``''`` for an empty one."""
    return strip(brace_content(after_first_box(text)))


def extract_boxed_last(text: Column) -> Column:
    """Answer for evaluation: the last box counts even when it is broken (then null)."""
    return strip(brace_content(after_last_box(text)))


def ratio_to_fraction(answer: Column) -> Column:
    """``a:b`` becomes ``\\frac{a}{b}``; anything else is left alone."""
    signed = rf"-?{_NUMBER}"
    return F.regexp_replace(answer, rf"(?U)^\s*({signed})\s*:\s*({signed})\s*\z", r"\\frac{$1}{$2}")


def normalize_answer(answer: Column) -> Column:
    """Voting text form: no white space, lower case."""
    return F.lower(F.regexp_replace(answer, _ANY_SPACE, ""))


def normalize_answer_eval(answer: Column) -> Column:
    """Evaluation text form: no dollar signs or spaces, lower case, stripped."""
    return strip(F.lower(F.translate(answer, "$ ", "")))


#: Answers whose key needs no parsing: numbers of up to six decimals, and words of letters.
_NUMERAL = r"^[+-]?\d{1,30}(?:\.\d{1,6})?\z"
_LETTERS = r"^[A-Za-z]+\z"


def _keys(texts: pa.Array, evaluation: bool) -> pa.Array:
    found = texts.dictionary_encode()
    keys = [None if x is None else terms.answer_key(x, evaluation) for x in found.dictionary.to_pylist()]
    return pa.array(keys, pa.string()).take(found.indices)


@F.arrow_udf(StringType())
def term_keys(texts: pa.Array) -> pa.Array:
    """Keys of the distinct texts of a batch, from their normal form."""
    return _keys(texts, False)


@F.arrow_udf(StringType())
def term_keys_eval(texts: pa.Array) -> pa.Array:
    return _keys(texts, True)


def answer_key(answer: Column, parsed: Callable[[Column], Column] = term_keys) -> Column:
    """Canonical key: two answers are equivalent exactly when their keys are equal.

    Numbers compare by value (``n:``), sums of products by their normal form (``e:``), tuples, intervals, sets and lists element by element (``l:``), all
    else by its normalised text (``t:``). Null for a missing or empty answer, which therefore never matches. Numerals and words are keyed with built-in
    functions; only what is neither is handed on to be parsed, once per distinct text of a batch. General algebra is not attempted.
    """
    numeral, word = answer.rlike(_NUMERAL), answer.rlike(_LETTERS)
    return (
        F.when(numeral, F.concat(F.lit("n:"), answer.try_cast("decimal(38,6)").cast("string")))
        .when(word, F.concat(F.lit("t:"), F.lower(answer)))
        .otherwise(parsed(F.when(~(numeral | word), answer)))
    )


def answer_key_eval(answer: Column) -> Column:
    """Key with the evaluation's text form."""
    return answer_key(answer, term_keys_eval)


def ground_truth_or_solution(solution: Column) -> Column:
    """Boxed answer of a worked solution, or the whole solution when it has none."""
    return F.coalesce(extract_boxed_last(solution), solution)
