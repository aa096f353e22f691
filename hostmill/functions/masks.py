"""Wildcard masks as column predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def wildcard(value: Column, mask: str) -> Column | None:
    """Mask predicate, or None for a blank mask.

    The text before the first star must start the value and the text after the last one must
    end it; the parts between follow the head in order. Head and tail may overlap, and a mask
    without a star is both head and tail.
    """
    mask = mask.strip()
    if not mask:
        return None
    head, *rest = mask.split("*")
    found = F.lit(True)
    if head:
        found = found & value.startswith(head)
    if not rest:
        return found & value.endswith(head)
    *middle, tail = rest
    middle = [m for m in middle if m]
    if middle:
        pattern = "(?s)^" + re.escape(head) + "".join(".*?" + re.escape(m) for m in middle)
        found = found & value.rlike(pattern)
    if tail:
        found = found & value.endswith(tail)
    return found


def any_mask(value: Column, masks: Iterable[str]) -> Column | None:
    """Whether one of the masks fits; None when every mask is blank."""
    result = None
    for mask in masks:
        p = wildcard(value, mask)
        if p is not None:
            result = p if result is None else result | p
    return result


def allowed(value: Column, keep: Iterable[str] = (), drop: Iterable[str] = ()) -> Column:
    """Kept by the keep masks (all, when there is none) and by none of the drop masks."""
    kept, dropped = any_mask(value, keep), any_mask(value, drop)
    result = F.lit(True) if kept is None else kept
    return result if dropped is None else result & ~dropped
