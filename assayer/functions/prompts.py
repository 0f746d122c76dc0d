"""Rendering prompts from templates with named placeholders."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.textops import swap

# Placeholder syntax and the headers of the instruction texts.
PLACEHOLDER = r"(?<!\{)\{(\w+)\}(?!\})"
INSTRUCTION_HEADER = "\nFollow the instructions below to generate the query:"
REFLECTION_HEADER = "\nAdditionally, I was asked to follow the instructions below to generate the query:"
MESSAGES = "array<struct<role:string,content:string>>"


def reflections(instructions: Column) -> Column:
    """The instruction text as the answer would repeat it."""
    return F.concat(swap(instructions, INSTRUCTION_HEADER, REFLECTION_HEADER), F.lit("\n"))


def fill(template: str, values: dict[str, Column]) -> Column:
    """Fill named placeholders in one pass; doubled braces stand for single ones.

    The template is cut at its placeholders once, so that a row only pays for a
    concatenation. Inserted values are never searched again, and a name without
    a value is kept as it stands.
    """
    pieces = []
    for i, piece in enumerate(re.split(PLACEHOLDER, template)):
        if i % 2 == 0:
            pieces.append(F.lit(piece.replace("{{", "{").replace("}}", "}")))
        elif piece in values:
            pieces.append(F.coalesce(values[piece].cast("string"), F.lit("")))
        else:
            pieces.append(F.lit("{" + piece + "}"))
    return F.concat(*pieces)


def fill_messages(template: str, values: dict[str, Column]) -> Column:
    """Fill every message of a JSON chat template; an array of (role, content)."""
    return F.array(
        *[
            F.struct(F.lit(m["role"]).alias("role"), fill(m["content"], values).alias("content"))
            for m in json.loads(template)
        ]
    )


def render_prompts(questions: DataFrame, templates: dict[str, str], values: dict[str, Column]) -> DataFrame:
    """One row per question and template with ``template`` and ``prompt``.

    A template whose text starts with ``[`` is a JSON list of messages; its
    prompt is the filled list as JSON.
    """

    def prompt(body: str) -> Column:
        return F.to_json(fill_messages(body, values)) if body.startswith("[") else fill(body, values)

    listed = [F.struct(F.lit(name).alias("template"), prompt(body).alias("prompt")) for name, body in templates.items()]
    return questions.select("*", F.inline(F.array(*listed)))
