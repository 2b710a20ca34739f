"""Abbreviations: the dictionary from a glossary's tables, and their expansion in texts."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import strip

#: Header cells of the glossary, and what its chapter's name holds.
TERM_HEADER, DEFINITION_HEADER = "Thuật ngữ", "Định nghĩa"
GLOSSARY = ("thuật ngữ", "viết tắt")
DEFAULT_PAGES = (386, 387)


class _Cells(HTMLParser):
    """Collects the rows of all tables; a body's rows alone where a table has a body."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self._tables: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._tables.append({"all": [], "body": None, "in": False, "cell": None})
        elif self._tables:
            t = self._tables[-1]
            if tag == "tbody" and t["body"] is None:
                t["body"], t["in"] = [], True
            elif tag == "tr":
                t["row"] = []
                t["all"].append(t["row"])
                if t["in"]:
                    t["body"].append(t["row"])
            elif tag in ("td", "th") and t["all"]:
                t["cell"] = []
                t["all"][-1].append(t["cell"])

    def handle_endtag(self, tag):
        if not self._tables:
            return
        t = self._tables[-1]
        if tag in ("td", "th"):
            t["cell"] = None
        elif tag == "tbody":
            t["in"] = False
        elif tag == "table":
            self._close()

    def handle_data(self, data):
        if self._tables and self._tables[-1]["cell"] is not None and data.strip():
            self._tables[-1]["cell"].append(data.strip())

    def _close(self):
        t = self._tables.pop()
        rows = t["all"] if t["body"] is None else t["body"]
        self.rows += [["".join(c) for c in row] for row in rows]

    def close(self):
        super().close()
        while self._tables:
            self._close()


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def table_rows(html: pd.Series) -> pd.Series:
    """The cell texts of all table rows of a page."""

    def rows(text: str | None) -> list[list[str]]:
        parser = _Cells()
        parser.feed(text or "")
        parser.close()
        return parser.rows

    return html.map(rows)


def is_glossary(chapter: Column) -> Column:
    """Whether a chapter's name is that of the list of abbreviations."""
    name = F.lower(F.coalesce(chapter, F.lit("")))
    return name.contains(GLOSSARY[0]) & name.contains(GLOSSARY[1])


def glossary_pages(ranges: DataFrame) -> DataFrame:
    """Return the logical pages (page) of the glossary; the default ones if there is no such chapter."""
    own = ranges.where(is_glossary(F.col("chapter"))).select(F.explode(F.sequence("start", "end")).alias("page")).distinct()
    default = ranges.sparkSession.createDataFrame([(p,) for p in DEFAULT_PAGES], "page int")
    return own.unionByName(default.join(own.agg(F.count("*").alias("n")), F.col("n") == 0).select("page"))


def cell_pairs(rows: Column) -> Column:
    """The cells of each row in pairs (term, definition); an odd last cell is left out."""
    pairs = F.transform(rows, lambda r: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0)), F.lit(2)), lambda i: i + 1 < F.size(r)), lambda i: F.struct(F.get(r, i).alias("term"), F.get(r, i + 1).alias("definition"))))
    return F.flatten(pairs)


def dictionary(pairs: DataFrame) -> DataFrame:
    """Return (ord, term, definition) from pairs (seq, term, definition).

    ``Name (ABC)`` defines ABC as the name, whatever stands beside it; other terms
    need a definition.  Of repeated terms the last definition counts, at the place
    of the first.
    """
    form = r"(?Ud)^(.*?)\s*\(([^)]+)\)$"
    p = pairs.where((F.col("term") != TERM_HEADER) & (F.col("definition") != DEFINITION_HEADER)).select("seq", strip(F.col("term")).alias("term"), strip(F.col("definition")).alias("definition"))
    inverted = F.col("term").rlike(form)
    name, short = (strip(F.regexp_extract("term", form, i)) for i in (1, 2))
    p = p.where(F.col("term") != "").select("seq", F.when(inverted, short).otherwise(F.col("term")).alias("term"), F.when(inverted, name).otherwise(F.col("definition")).alias("definition"), inverted.alias("inverted"))
    p = p.where(F.col("inverted") | (F.col("definition") != ""))
    return p.groupBy("term").agg(F.min("seq").alias("ord"), F.max_by("definition", "seq").alias("definition")).select("ord", "term", "definition")


def _escaped(term: Column) -> Column:
    return F.regexp_replace(term, r"([\\^$.|?*+()\[\]{}/-])", r"\\$1")


def expand(texts: DataFrame, terms: DataFrame, text_col: str = "text", skip: Column | None = None) -> DataFrame:
    """Write ``TERM (definition)`` for the first free-standing occurrence of each term.

    Terms go from long to short, and each sees what the ones before it wrote.  The
    dictionary is one row of an array, and a fold tests ``contains`` before it runs
    a pattern.  Rows where ``skip`` holds stay as they are.
    """
    pattern = F.concat(F.lit(r"(?sU)\A(.*?)(?<![\w(])"), _escaped(F.col("term")), F.lit(r"(?![\w)])(?!\s*\()"))
    literal = F.regexp_replace(F.concat("term", F.lit(" ("), "definition", F.lit(")")), r"([\\$])", r"\\$1")
    entry = F.struct((-F.length("term")).alias("size"), "ord", F.col("term").alias("k"), pattern.alias("p"), F.concat(F.lit("$1"), literal).alias("r"))
    row = terms.agg(F.array_sort(F.collect_list(entry)).alias("_terms"))  # one row, a dictionary's size
    folded = f"aggregate(_terms, {text_col}, (t, x) -> if(contains(t, x.k), regexp_replace(t, x.p, x.r), t))"
    out = texts.crossJoin(F.broadcast(row))
    new = F.expr(folded) if skip is None else F.when(F.coalesce(skip, F.lit(False)), F.col(text_col)).otherwise(F.expr(folded))
    return out.withColumn(text_col, new).drop("_terms")
