"""Property lookup inside generated code: a two-stage table as constant arrays, read by index."""

from __future__ import annotations

import functools
import json

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ucd import properties as U

#: Codepoints of one block.
BLOCK_BITS = 7


@functools.cache
def tables(prop: str) -> tuple[list[int], list[int], list[str]]:
    """(place of each block, values of the distinct blocks, text of each value): codepoint -> blocks[cp >> BLOCK_BITS] + rest -> value."""
    runs = U.runs(prop)
    names = sorted({v for _, _, v in runs})
    number = {v: i for i, v in enumerate(names)}
    of = np.repeat([number[v] for _, _, v in runs], [b - a + 1 for a, b, _ in runs]).reshape(-1, 1 << BLOCK_BITS)
    distinct, where = np.unique(of, axis=0, return_inverse=True)
    return (where.ravel() << BLOCK_BITS).tolist(), distinct.ravel().tolist(), names


def _array(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def value_code(cp: Column, prop: str) -> Column:
    """The number of the property's value; null for what is no codepoint."""
    blocks, leaves, _ = tables(prop)
    at = F.get(_array(blocks, "int"), F.shiftright(cp, BLOCK_BITS)) + cp.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    return F.when(cp.between(0, U.SIZE - 1), F.get(_array(leaves, "smallint"), at))


def property_value(cp: Column, prop: str) -> Column:
    """The value of an enumerated or binary property, script extensions or combining class as text; null for what is no codepoint."""
    return F.get(_array(tables(prop)[2], "string"), value_code(cp.cast("int"), prop))
