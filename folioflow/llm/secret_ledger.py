r"""Secret scan over an incremental ledger of content-addressed blobs.

Every historical version of every path is addressed by the SHA-256 of its text.
The ledger, a Parquet table, has one row for each (blob, rule version) that has
been scanned, with its findings, also where there are none.  A scan takes the
distinct blobs of the versions given, drops those that the ledger already has
for the rule version, scans the rest once each, appends them to the ledger, and
joins the findings back to all paths and versions that hold the blob.

Copies are dropped on the map side before the shuffle (a group limit of one row
per blob), so a blob that a third of all rows hold reaches the scan from each
task at most once; the join back is by blob, narrow, and skewed keys split.

Findings are (kind, start, end) in code points, end exclusive, leftmost and
non-overlapping for each kind.  Defined edge cases: a null text counts as
empty; null paths and repeated rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.shared import give_back, materialize, new_path, small_batches
from folioflow.llm.sketch_join import TextFilter


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and which group of a match must have how many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ascii_any_case: bool = False
    #: Strings of which a text must have one for the pattern to match at all, in lower case.
    anchors: tuple[str, ...] = field(default=())


#: The base rules, in the order that breaks ties of their spans; fixed values.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, ("akia",)),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further rules, whose spans come beside the base ones.
EXTRA_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", anchors=("eyj",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", anchors=("-----begin",)),
    Rule("hook", r"https://hooks\.[a-z0-9.]+/[A-Za-z0-9/_-]{16,}", anchors=("https://hooks.",)),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{30,}", anchors=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE_RULES + EXTRA_RULES

FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def rule_version(rules: tuple[Rule, ...]) -> str:
    """Return a digest that changes with any rule."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


class Scanner:
    """Compiled rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, self._compile(r)) for r in rules]

    @staticmethod
    def _compile(rule: Rule) -> re.Pattern:
        pattern = rule.pattern
        if rule.group == 0 and pattern.endswith("]+") and pattern.startswith("[") and pattern.count("[") == 1:
            # A run of one class: shorter runs fail, so only long ones need to match.
            pattern = f"{pattern[:-1]}{{{rule.least},}}"
        return re.compile(pattern, re.ASCII | re.IGNORECASE if rule.ascii_any_case else 0)

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """Return (kind, start, end) by start, then by the order of the rules."""
        found = []
        lower = text.lower()
        for order, (rule, pattern) in enumerate(self.rules):
            if rule.anchors and not any(a in lower for a in rule.anchors):
                continue
            found += [(m.start(), order, rule.kind, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [(kind, start, end) for start, _, kind, end in sorted(found)]


def with_blob(versions: DataFrame, text_col: str) -> DataFrame:
    """Add ``blob``, the SHA-256 of the text (null: empty), in 32 bytes."""
    return versions.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)))


def scan_unseen(texts: DataFrame, known: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """Return (blob, rules, findings) for each distinct blob of ``texts`` (blob, text) that is not in ``known``."""
    version = rule_version(rules)
    if known is not None:
        seen = known.where(F.col("rules") == version).select("blob")
        texts = texts.join(seen, "blob", "left_anti")
    once = texts.withColumn("n", F.row_number().over(Window.partitionBy("blob").orderBy(F.lit(0)))).where("n = 1").select("blob", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scanner.scan(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array([version] * len(found)), pa.array(found, kind)], names=["blob", "rules", "findings"])
        give_back()

    schema = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rules", T.StringType()), T.StructField("findings", FINDINGS)])
    return once.mapInArrow(run, schema)


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        return None
    return spark.read.parquet(path)


def scan_history(versions: DataFrame, ledger: str, id_cols: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger at path ``ledger`` up to date and return the findings of all versions.

    Returns ``id_cols``, blob and findings, one row for each row of ``versions``.
    The append to the ledger is one committed Spark write; if it is repeated, the
    later rows equal the earlier ones and reading drops them.
    """
    spark = versions.sparkSession
    small_batches(spark)
    rows = with_blob(versions.select(*id_cols, F.col(text_col).alias("text")), "text")
    fresh = scan_unseen(rows.select("blob", F.coalesce("text", F.lit("")).alias("text")), _ledger(spark, ledger), rules)
    fresh.hint("rebalance").write.mode("append").parquet(ledger)  # findings are few, and so are files then
    known = spark.read.parquet(ledger).where(F.col("rules") == rule_version(rules)).where(F.size("findings") > 0)
    known = known.groupBy("blob").agg(F.first("findings").alias("findings"))
    narrow = rows.select(*id_cols, "blob")
    return narrow.join(known, "blob", "left").select(*id_cols, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def _count(kind: str) -> Column:
    return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")


def digest(found: DataFrame) -> DataFrame:
    """Return doc_id with the counts and digests of its findings."""
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in BASE_RULES]))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [_count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("findings")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """Return ``docs`` with every finding replaced by ``mark``; other columns stay, whatever their names.

    Each distinct text is scanned once through the ledger.  A filter of the blobs with
    findings, of a bounded size, tells most other texts, which are not shuffled again;
    the rest is looked up exactly.  Null texts stay null, repeated rows are kept.
    """
    spark = docs.sparkSession
    path = ledger or new_path(spark, "ledger")
    scan_history(docs.select(F.col(text_col).alias("text")), path, [], "text", rules)
    known = spark.read.parquet(path).where(F.col("rules") == rule_version(rules)).where(F.size("findings") > 0)
    mark_ = "_scan"
    while any(c.lower().startswith(mark_) for c in docs.columns):
        mark_ = "_" + mark_
    name, spans_col = mark_ + "_blob", mark_ + "_spans"
    known = materialize(known.groupBy("blob").agg(F.first("findings").alias("findings")), "findings")
    held = TextFilter(known.select(F.xxhash64("blob").alias("h")), known.count())
    # Code points are cut out piece by piece: the text between findings, then the mark.
    spans = F.transform(spans_col, lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.col(text_col)
    folded = F.aggregate(
        spans,
        start,
        lambda acc, x: F.when(x["a"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["b"]).alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["a"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"), x["b"].alias("at"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    rows = docs.withColumn(name, F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)))
    maybe = held.maybe(F.xxhash64(name))
    clean = rows.where(~maybe).select(*docs.columns)
    marked = rows.where(maybe).join(known.select(F.col("blob").alias(mark_ + "_own"), F.col("findings").alias(spans_col)), F.col(name) == F.col(mark_ + "_own"), "left")
    return clean.union(marked.select(*[F.when(F.col(spans_col).isNull(), text).otherwise(folded).alias(c) if c == text_col else F.col(c) for c in docs.columns]))
