"""Types of the expression language."""

from __future__ import annotations

from enum import Enum


class ExprType(Enum):
    NUMBER = "number"
    TEXT = "text"
    BOOLEAN = "boolean"
    DATE = "date"

    @property
    def ordered(self) -> bool:
        return self is not ExprType.BOOLEAN

    @property
    def spark(self) -> str:
        """How values of the type stand in a column; dates and date-times are both zoneless timestamps."""
        return {"number": "double", "text": "string", "boolean": "boolean", "date": "timestamp_ntz"}[self.value]
