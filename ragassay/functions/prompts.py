"""Prompt and context-block text, built as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragassay.functions.numbers import fixed_text
from ragassay.functions.text import is_not_blank
from ragassay.schemas import INVALID_CHUNK, NO_CONTEXT, REJECTED

# --- fixed value: the text around context and question in the answer prompt ----
ANSWER_PROMPT_HEAD = (
    "You are a very capable AI assistant specializing in corporate and financial compliance data.\n"
    "    \n"
    "Use the following retrieved context chunks to answer the user's question. \n"
    "If the answer is not explicitly contained in the context, do not guess; simply state that "
    "the information is not available in the provided documents.\n\n"
    "Context:\n"
)
ANSWER_PROMPT_QUESTION = "\n\nQuestion:\n"
ANSWER_PROMPT_TAIL = "\n\nAnswer:"


def none_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def generator_context_block(contexts: Column) -> Column:
    """``[Source i | Score: s | page_number=p, token_count=t]`` blocks."""

    def one(context: Column, position: Column) -> Column:
        meta = context["metadata"]
        return F.concat(
            F.lit("[Source "),
            (position + 1).cast("string"),
            F.lit(" | Score: "),
            fixed_text(context["similarity_score"], 4),
            F.lit(" | page_number="),
            none_text(meta["page_number"]),
            F.lit(", token_count="),
            none_text(meta["token_count"]),
            F.lit("]\n"),
            context["text"],
        )

    return F.array_join(F.transform(contexts, one), "\n\n")


def answer_prompt(contexts: Column, question: Column) -> Column:
    return F.concat(
        F.lit(ANSWER_PROMPT_HEAD),
        generator_context_block(contexts),
        F.lit(ANSWER_PROMPT_QUESTION),
        question,
        F.lit(ANSWER_PROMPT_TAIL),
    )


def judge_context_block(contexts: Column) -> Column:
    """``[Document i]:`` blocks; a mark stands in when nothing was retrieved."""

    def one(context: Column, position: Column) -> Column:
        text = F.coalesce(context["text"], F.lit(""))
        return F.concat(F.lit("[Document "), (position + 1).cast("string"), F.lit("]:\n"), text)

    block = F.array_join(F.transform(contexts, one), "\n\n")
    return F.when(is_not_blank(F.coalesce(block, F.lit(""))), block).otherwise(NO_CONTEXT)


# --- tasks for outside models ----------------------------------------------------
# A task lists what its stage takes back: field, what it is about, allowed values.

SCORE = "number from 0 to 5 with a reason"
CORRECTNESS_FIELDS = {"correctness": ("answer against true answer", SCORE)}
TRIAD_FIELDS = {
    "context_relevance": ("contexts against question", SCORE),
    "faithfulness": ("answer against contexts", SCORE),
    "answer_relevance": ("answer against question", SCORE),
}
SYNTHESIS_FIELDS = {
    "question": ("asked of the passage", f"text, or {INVALID_CHUNK}"),
    "answer": ("found in the passage", f"text, or {REJECTED}"),
    "complexity": ("of the question", "Factoid or Reasoning"),
}


def task(fields: dict[str, tuple[str, str]], **inputs: Column) -> Column:
    """Inputs under their names, then the wanted fields, one to a line."""
    wanted = "".join(f"{name} ({about}): {values}\n" for name, (about, values) in fields.items())
    given = []
    for name, value in inputs.items():
        given += [F.lit(f"<{name}>\n"), F.coalesce(value, F.lit("")), F.lit(f"\n</{name}>\n")]
    return F.concat(*given, F.lit(f"Return JSON with these fields.\n{wanted}"))
