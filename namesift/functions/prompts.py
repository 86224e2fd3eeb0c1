"""Prompt columns: JSON text holding the messages of one model call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from namesift.functions import fixed


def messages(*contents: Column) -> Column:
    """User messages in order as a JSON array. NULL if any content is NULL."""
    parts = [F.struct(F.lit("user").alias("role"), c.alias("content")) for c in contents]
    complete = contents[0].isNotNull()
    for c in contents[1:]:
        complete = complete & c.isNotNull()
    return F.when(complete, F.to_json(F.array(*parts)))


def entity_prompt(text: Column, entity: str) -> Column:
    return messages(
        F.lit(fixed.ENTITY_TASK.format(entity=entity)),
        text,
        F.lit(fixed.ENTITY_ONLY.format(entity=entity)),
        F.lit(fixed.ENTITY_MISSING.format(entity=entity)),
    )


def category_prompt(text: Column, categories: Sequence[str]) -> Column:
    listed = "[" + ", ".join(f"'{c}'" for c in categories) + "]"
    return messages(
        F.lit(fixed.CATEGORY_TASK),
        F.lit(fixed.CATEGORY_CHOICES.format(categories=listed)),
        text,
        F.lit(fixed.CATEGORY_ONLY),
        F.lit(fixed.CATEGORY_MISSING),
    )


def first_name_prompt(name: Column, full_name: Column) -> Column:
    before, between, after = fixed.NAME_QUESTION
    question = F.concat(F.lit(before), name, F.lit(between), full_name, F.lit(after))
    return messages(F.lit(fixed.NAME_TASK), question, F.lit(fixed.NAME_ONLY))


def attribute_prompt(text: Column, attribute: str = "occupation") -> Column:
    return messages(
        F.lit(fixed.ATTRIBUTE_TASK.format(attribute=attribute)),
        F.concat(F.lit(fixed.ATTRIBUTE_TEXT), text),
        F.lit(fixed.ATTRIBUTE_ONLY.format(attribute=attribute)),
        F.lit(fixed.ATTRIBUTE_ONE.format(attribute=attribute)),
        F.lit(fixed.ATTRIBUTE_MISSING.format(attribute=attribute)),
    )


def instruction_prompt(instruction: Column) -> Column:
    return F.concat(F.lit(fixed.INSTRUCTION_HEAD), instruction, F.lit(fixed.INSTRUCTION_TAIL))


def wrapped_question(sentence: Column, around: tuple[str, str] = fixed.COUNTRY_QUESTION) -> Column:
    return F.concat(F.lit(around[0]), sentence, F.lit(around[1]))
