"""Pre-tokens of texts as numbers of a growing dictionary."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import regex

from tidemill.llm.common import Numbering

#: Beyond this many characters, a text's pre-tokens are not held as strings all at once.
LONG = 1_000_000


class Pretokens:
    """Splits texts by a pattern and numbers the distinct pre-tokens in order of their first use."""

    def __init__(self, pattern: str = public_tokenizers.PATTERN) -> None:
        self.split = regex.compile(pattern)
        self.number = Numbering()

    def __len__(self) -> int:
        return len(self.number)

    @property
    def words(self) -> list[str]:
        return list(self.number)

    def numbers(self, text: str | None) -> np.ndarray:
        """The numbers of the text's pre-tokens, in order; none for null and empty texts."""
        text = text or ""
        found = self.split.findall(text) if len(text) < LONG else (m.group() for m in self.split.finditer(text))
        return np.fromiter(map(self.number.__getitem__, found), np.uint32)
