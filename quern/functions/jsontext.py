"""Strict JSON parsing shared by the operators that visit documents."""

from __future__ import annotations

import json
import sys
from typing import Any

sys.set_int_max_str_digits(0)  # integers of any length are read and written whole


class INVALID:
    """Stands for text that is not valid JSON.  A class, not an instance: it stays itself when functions are sent to workers."""



def _not_json(name: str) -> Any:
    raise ValueError(name)


_strict = json.JSONDecoder(parse_constant=_not_json)


def parse(text: str | None) -> Any:
    """The value, or INVALID: for NULL, text that is cut off, NaN and Infinity, or nesting deeper than the parser goes."""
    if text is None:
        return INVALID
    try:
        return _strict.decode(text)
    except (ValueError, RecursionError):
        return INVALID


def elements(value: Any) -> list:
    """An array's elements; a lone object stands for an array of one; anything else has none."""
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []
