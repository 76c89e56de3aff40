"""Text expressions: patterns and tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The line layouts and patterns that are recognised. The flags keep the usual text
# semantics (Unicode classes; a dot stops at newline only).
_FLAGS = "(?dU)"
SYSLOG_LINE = _FLAGS + r"^(\w{3})\s+(\d{1,2})\s(\d{2}:\d{2}:\d{2})\s([^\s]+)\s([^:]+):\s(.*)$"
CBS_LINE = _FLAGS + r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}),\s*(\w+)\s+([A-Za-z0-9_.-]+)\s+(.*)$"
IPV4 = _FLAGS + r"\b((?:\d{1,3}\.){3}\d{1,3})\b"
FAILED_USER = _FLAGS + r"Failed password for (?:invalid user\s+)?([\w\-\.\$]+)"
ACCEPTED_USER = _FLAGS + r"Accepted (?:password|publickey) for ([\w\-\.\$]+)"


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, or null where the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_ipv4(text: Column) -> Column:
    """The first thing in the text that is shaped like an IPv4 address."""
    return extract(text, IPV4)


def words(text: Column) -> Column:
    """The whitespace-separated tokens of a text."""
    return F.split(F.trim(text), r"\s+")
