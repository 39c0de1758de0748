"""Column functions over chat messages (arrays of role and content) and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompts' wording.
QUESTION_PROMPT = (
    "Identify three distinct concepts discussed in the following paragraph. For each concept, generate one instruct-style "
    "question that would help a model understand its meaning and how it relates to the other two concepts. Prefix each "
    "question with 'Q>' on a new line.\n\nParagraph: {context}"
)
CURATION_PROMPT = (
    "You are grading candidate answers for fine-tuning data curation. Judge only against the provided context.\n\n"
    "Context:\n{context}\n\nQuestion: {question}\nCandidate answers:\n{answers}\n\nRate the best candidate from 1 (useless) "
    "to 5 (excellent, fully grounded in the context). Then write one synthesized best answer grounded only in the context. "
    "Respond exactly as two lines:\nRATING: <1-5>\nSYNTHESIS: <answer>"
)
ANSWER_PROMPT = "{question} Answer based only on this context:\n\n{context}"
# The system prompt of curated pairs.
TRAINING_PROMPT = (
    "You are the character this material describes -- not an assistant explaining it. Its ethics, concepts, and processes "
    "are how you think; speak from inside them, in their own voice, as things you live rather than facts you recite. Stay "
    "grounded in what you know, and never break frame to describe yourself as a model or the material as external."
)


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def exchange(system: str | Column, user: Column, assistant: Column) -> Column:
    """A system, user and assistant message."""
    return F.array(message("system", F.lit(system) if isinstance(system, str) else system), message("user", user), message("assistant", assistant))


def inverted(role: Column) -> Column:
    """The other side's view: assistant is user, user is assistant."""
    return F.when(role == "assistant", "user").when(role == "user", "assistant").otherwise(role)


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced; braces inside values stay."""
    pieces, rest = [], template
    while rest:
        name, at = min(((n, rest.find("{%s}" % n)) for n in values if "{%s}" % n in rest), key=lambda x: x[1], default=(None, -1))
        if name is None:
            pieces.append(F.lit(rest))
            break
        pieces += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def bullets(candidates: Column) -> Column:
    """A line with a dash a candidate, or one that says there are none."""
    return F.when(F.size(candidates) > 0, F.array_join(F.transform(candidates, lambda a: F.concat(F.lit("- "), a)), "\n")).otherwise("- (none)")


def transcript(messages: Column) -> Column:
    """Messages as lines of a plain prompt, ending with the assistant's turn."""
    line = lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])
    return F.concat(F.array_join(F.transform(messages, line), "\n"), F.lit("\nAssistant: "))
