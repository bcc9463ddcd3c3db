"""How many tokens a text has, by the tokenizer of the model that will read it."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache

#: Named ways to count; anything else is the path of a tokenizer's JSON file.
CHARACTERS, WORDS, ESTIMATE = "characters", "words", "estimate"


def _estimate(text: str) -> int:
    """The greater of bytes / 3.15 and units * 1.1, rounded up: for planning, never in place of a tokenizer."""
    units = len(re.findall(r"[A-Za-z]+|\d{1,3}|[^\w\s]|[^\x00-\x7f]", text))
    return max(math.ceil(len(text.encode()) / 3.15), math.ceil(units * 1.1))


@lru_cache(maxsize=8)
def counter(by: str = CHARACTERS) -> Callable[[str], int]:
    """A counter of tokens; `by` is CHARACTERS, WORDS, ESTIMATE or the path of a tokenizer, which every task opens once."""
    if by == CHARACTERS:
        return len
    if by == WORDS:
        return lambda text: len(text.split())
    if by == ESTIMATE:
        return _estimate
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(by)
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)
