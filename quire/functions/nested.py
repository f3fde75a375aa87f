"""Text out of nested results of unknown shape, and JSON out of a tool's output."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: The keys under which recognisers give their text, the first that holds any wins.
TEXT_KEYS = ("latex", "text", "formula", "result", "rec_text", "content")


def strict(text: Column) -> Column:
    """VARIANT: a text that is JSON from end to end; the parser itself stops after the first value, so one is put behind it.

    A text is parsed once, and only if it begins as a value does: for others the parser would have to raise and catch an error a row."""
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"end of text"]')))
    whole = lambda v: (F.try_variant_get(v, "$[1]", "string") == "end of text") & F.try_variant_get(v, "$[2]", "variant").isNull()
    return F.when(text.rlike(r'^[ \t\r\n]*[\[{"\-0-9tfn]'), once(both, lambda v: F.when(whole(v), F.try_variant_get(v, "$[0]", "variant"))))


def recovered(output: Column) -> Column:
    """VARIANT: the output as JSON; where it is none as a whole, its last line that begins with a brace and is JSON; null without one.

    Lines that begin and end with a brace are parsed from the last one back, until one is JSON."""
    lines = F.filter(F.transform(F.split(output, "\r?\n", -1), lambda v: F.trim(v)), lambda v: v.startswith("{") & F.rtrim(v, F.lit(" \t\r")).endswith("}"))
    last = F.aggregate(F.reverse(lines), F.lit(None).cast("variant"), lambda found, v: F.coalesce(found, strict(v)))
    return F.coalesce(strict(output), last)


def _text(value: object) -> str:
    """Texts of a value in order, with a space between. The stack is a list, so that depth is no matter."""
    # a node holds text if a leaf under it does, so leaves are told first and nodes by their children
    order, stack = [], [value]
    while stack:
        node = stack.pop()
        order.append(node)
        if isinstance(node, dict):
            stack.extend(node.values())
        elif isinstance(node, list):
            stack.extend(node)
    told: dict[int, str] = {}
    for node in reversed(order):
        if node is None:
            text = ""
        elif isinstance(node, dict):
            known = [told[id(node[k])] for k in TEXT_KEYS if k in node]
            text = next(filter(None, known), "") or " ".join(filter(None, (told[id(v)] for v in node.values())))
        elif isinstance(node, list):
            text = " ".join(filter(None, (told[id(v)] for v in node)))
        else:
            text = str(node).strip()
        told[id(node)] = text
    return told[id(value)]


def _texts(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else _text(json.loads(v)))


def text_of(value: Column) -> Column:
    """The text of a VARIANT of any depth; empty without text, null for null."""
    return F.pandas_udf(_texts, "string")(F.to_json(value))
