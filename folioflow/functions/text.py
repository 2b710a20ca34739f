r"""Text expressions: Unicode-aware stripping, the token pattern, table cutting.

Java's ``\s`` and ``\w`` are ASCII unless ``(?U)`` is given, and its ``$`` knows
more line ends than ``\n`` unless ``(?d)`` is; the expressions here set both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The word characters of the token pattern (Vietnamese and ASCII).
TOKEN_CHARS = "a-zA-Z0-9_àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệđìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵ"
TOKEN = f"[{TOKEN_CHARS}]+(?:[,.][{TOKEN_CHARS}%]+)*%?"
#: The same characters in lower case with the block of U+1EA1 as a range: Java tries the members of a class one by one.
LOWER_CHARS = "a-z0-9_àáãâèéêìíòóõôùúý\u1ea1-\u1ef9ăđĩũơư"
LOWER_TOKEN = f"[{LOWER_CHARS}]+(?:[,.][{LOWER_CHARS}%]+)*%?"
EDGE_SPACE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
TABLE = r"(?i)<table[\s\S]*?</table>"
#: Fixed value: marks a heading that goes on from the page before.
CONTINUED = " (Tiếp tục)"


def quoted(value: str) -> str:
    """Return a string as a raw SQL literal."""
    return "r'" + value.replace("'", "''") + "'" if "'" not in value else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_sql(text: str) -> str:
    """SQL that removes all white space at both ends."""
    return f"regexp_replace({text}, {quoted(EDGE_SPACE)}, '')"


def strip(text: Column) -> Column:
    """Remove all white space at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def tokens(text: Column) -> Column:
    """Split a text into lower-case tokens that keep decimals and percentages whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(LOWER_TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    """The distinct lower-case tokens of two characters or more, for containment tests."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_.,]+"), F.lit(0)), lambda t: F.length(t) >= 2))


def contextual_text(chapter: Column, section: Column, heading: Column, content: Column) -> Column:
    """The text that is indexed for a chunk: its place in the document, then its content."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("Chương: "), part(chapter), F.lit(" | Mục: "), part(section), F.lit(" | Tiêu đề: "), part(heading), F.lit("\n\n"), part(content))


def parse_json(text: Column, schema: str) -> Column:
    """Parse JSON that may be fenced or have prose around it; null where it can't be.

    The text between a leading and a trailing fence is tried first, then the
    slice from the first ``{`` to the last ``}``.
    """
    bare = strip(F.regexp_replace(strip(text), r"\A```(?:json)?|```\z", ""))
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    valid = lambda t: F.get_json_object(t, "$").isNotNull()
    return F.when(valid(bare), F.from_json(bare, schema)).when(valid(braces), F.from_json(braces, schema))
