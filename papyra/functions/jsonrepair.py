"""JSON out of free text: the whole, a fenced block, the first balanced braces that parse, or key: value lines."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

FENCE = r"```(?:json)?([^`]*)```"
# Fixed value: braces up to depth three.
BRACES = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"


def parsed(c: Column) -> Column:
    """The text if it is a JSON object, else null."""
    c = F.trim(c, F.lit(" \n\t\r"))
    return F.when(c.startswith("{") & F.call_function("try_parse_json", c).isNotNull(), c)


def repaired(reply: Column) -> Column:
    found = F.filter(F.transform(F.regexp_extract_all(reply, F.lit("(" + BRACES + ")"), F.lit(1)), parsed), lambda x: x.isNotNull())
    keys = F.regexp_extract_all(reply, F.lit(r'(?m)^\s*"?(\w+)"?\s*:\s*"?[^",\n\[\]]+'), F.lit(1))
    values = F.regexp_extract_all(reply, F.lit(r'(?m)^\s*"?\w+"?\s*:\s*"?([^",\n\[\]]+)'), F.lit(1))
    pairs = F.when(F.size(keys) > 0, F.to_json(F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: x.k.isNotNull()))))
    return F.coalesce(parsed(reply), parsed(F.regexp_extract(reply, FENCE, 1)), F.try_element_at(found, F.lit(1)), pairs)
