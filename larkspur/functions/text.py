"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_SPACE = r"[\s\x1c-\x1f]"
# The patterns that mark where a plain-text book starts and ends.
BOOK_START = rf"(?isU)\A.*?((?:\A|\n)(?:chapter{_SPACE}+1|chapter{_SPACE}+i)\b)"
BOOK_END = rf"(?isU)\n{_SPACE}*end{_SPACE}+of{_SPACE}+(?:the{_SPACE}+)?project{_SPACE}+gutenberg.*\z"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def clean_book_text(text: Column) -> Column:
    """Cut the text before its first chapter and after its end mark, tidy blank lines."""
    body = F.regexp_replace(text, BOOK_START, "$1")
    body = F.regexp_replace(body, BOOK_END, "")
    return strip(F.regexp_replace(body, "\n{3,}", "\n\n"))
