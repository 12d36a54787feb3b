"""Reading of input tables and small helpers shared by the operators of this package."""

from __future__ import annotations

import os

from ..sources.tables import keep, read, spread

__all__ = ["keep", "read", "spread", "tokenizer_path"]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; ``TOKENIZER_DIR`` overrides the default folder."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)
