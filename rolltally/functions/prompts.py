"""Prompt texts and the repair of rollouts that stopped before an answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolltally.functions.answers import BOX_OPEN, THINK_END, has_answer, strip

# The wording the prompts must have.
INSTRUCTION = "Please reason step by step, and put your final answer within \\boxed{}."
TRANSITION = (
    "\n\nAfter reading the reference solution above, make sure you truly understand "
    "the reasoning behind each step — do not copy or paraphrase it. Now, using your "
    "own words and independent reasoning, derive the same final answer to the problem above. "
    "Think step by step, explore different approaches, and don't be afraid to backtrack "
    "or reconsider if something doesn't work out:\n"
)
ANALYSE = (
    "\n\nThe reference reasoning above arrives at the correct answer. "
    "Please analyze this solution and explain the key reasoning steps and problem-solving strategies employed. "
    "Do NOT use <think> tags. Do NOT derive your own solution. "
    "Simply analyze and explain the reference solution provided above.\n"
)


def student_prompt(problem: Column, style: str = "train") -> Column:
    """``train``: headed, blank line; ``compact``: headed, one line break; ``eval``: no heading."""
    head, gap = {"train": ("Problem: ", "\n\n"), "compact": ("Problem: ", "\n"), "eval": ("", "\n\n")}[style]
    return F.concat(F.lit(head), problem, F.lit(gap + INSTRUCTION))


def teacher_prompt(problem: Column, reference: Column, privilege: str = "answer") -> Column:
    """Prompt that also shows a reference; ``none`` hides it, a null reference is an empty block."""
    if privilege == "none":
        return student_prompt(problem)
    return F.concat(
        F.lit("Problem: "),
        problem,
        F.lit("\n\nHere is a reference solution to this problem:\n=== Reference Solution Begin ===\n"),
        F.coalesce(reference, F.lit("")),
        F.lit("\n=== Reference Solution End ===\n" + TRANSITION + "\n" + INSTRUCTION),
    )


def reason_first_prompt(problem: Column, solution: Column) -> Column:
    """Prompt asking to analyse a correct reasoning before teaching."""
    return F.concat(
        F.lit("Problem: "),
        problem,
        F.lit("\n\nHere is a correct reasoning to this problem:=== Reference Reasoning Start ===\n"),
        solution,
        F.lit("\n=== Reference Reasoning End ===\n\n" + ANALYSE),
    )


def reason_first_followup(prompt: Column, reasoning: Column) -> Column:
    """The analysis prompt with its answer and the move to teaching appended."""
    return F.concat(prompt, reasoning, F.lit("\n" + TRANSITION + "\n" + INSTRUCTION))


def strip_pad_token(prompt: Column, pad: str) -> Column:
    """Decoded prompt without its padding marks."""
    return F.replace(prompt, F.lit(pad), F.lit("")) if pad else prompt


def forced_prefix(completion: Column) -> Column:
    """Text that makes a stopped rollout state an answer, closing its thinking when still open."""
    opening = "\n\n" + BOX_OPEN
    return F.when(completion.contains(THINK_END), F.lit(opening)).otherwise(F.lit(THINK_END + opening))


def forced_answer(continuation: Column) -> Column:
    """Answer in a forced continuation: closing braces and white space cut, null when nothing is left."""
    return F.nullif(strip(F.regexp_replace(continuation, r"\}+\z", "")), F.lit(""))


def merge_repair(answer: Column, continuation: Column) -> Column:
    """The extracted answer, or the forced one where extraction found nothing (an empty box stays empty)."""
    return F.when(has_answer(answer), answer).otherwise(F.coalesce(forced_answer(continuation), answer))
