"""Every query of this folder with its SQL counterpart (None where SQL cannot say it)."""

from __future__ import annotations

from . import queries_dedup, queries_native, queries_selection, queries_text

QUERIES = {**queries_native.QUERIES, **queries_dedup.QUERIES, **queries_text.QUERIES, **queries_selection.QUERIES}
