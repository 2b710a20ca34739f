r"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame operations are used.  The size of a document is its number of
words.  Sources in code-point order (null last) weigh ``weights``, repeating, and
share ``share`` times all words; a target stops at ``cap`` times its source, and
what is beyond goes to the other sources by weight until none is above.

Every source is hashed into blocks of documents, and the blocks are permuted.  A
source's quota is the number of blocks, pass after pass over the permutation, that
its target needs; the last block drawn is trimmed to the target.  The quotas of all
sources are split among the output shards by a binary tree: a node gives half of its
draws to its left child, and how many of them come from each source is one draw from
the multivariate hypergeometric distribution, so a shard is an exact random sample
of the mix and all quotas are met exactly.  Each shard then draws as many blocks of
every source as its leaf says, from its own disjoint run of the permuted draws; what
is in no shard's run is not in the mix, and the words that a document gives are the
sum over the shards that draw its block.  A shard's rows are ordered by a hash,
which shuffles them locally.

The number of shards, a power of two, grows with the words of the mix
(``WORDS_PER_SHARD``), and the number of blocks of a source with it.  All random
choices are hashes of the seed, so reruns agree.  Documents are only hashed into
blocks: a source with a third of all rows is not gathered anywhere; tables by source
and block have as many rows a source as it has blocks.  What is worked out for all
sources together, the targets and a node's quotas, is a row or an array entry for
each source, so sources are taken to be far fewer than documents.

Defined edge cases: null texts have size 0, take no words and stay in the plan
with taken 0; repeated rows are separate documents; an empty table gives no
rows; a null source is a source of its own; the caller's columns stay as they are,
and columns of the mix whose names they bear get another underscore in front.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.shared import keep, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of a source, at least, and for each shard.
BLOCKS, BLOCKS_PER_SHARD = 1024, 16
#: Shards, at least, and words of a shard.
SHARDS, WORDS_PER_SHARD = 64, 1 << 25
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Return (source, idx, source_size, target) from (source, source_size).

    With sources in order of cap over weight, the ones before some point are at
    their cap and the others get their weight times one level; the level is that
    of the first source which its share of the rest does not fill.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("idx", F.row_number().over(order) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("idx") % len(weights) + 1).cast("double"))
    w = w.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "idx")
    every = Window.partitionBy()
    w = w.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    w = w.withColumn("filled", F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    w = w.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
    w = w.withColumn("level", F.min_by(F.col("level"), F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "idx"))).over(every))
    return w.select("source", "idx", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("level"))).alias("target"))


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _log_factorial(n: str) -> str:
    """SQL for ln n!, by Stirling's series at n + 8; the error is below 1e-10."""
    shift = " * ".join(f"(z - {i})" for i in range(1, 8))
    series = f"(z - 0.5D) * ln(z) - z + {0.5 * math.log(2 * math.pi)!r}D + 1 / (12D * z) - 1 / (360D * pow(z, 3)) + 1 / (1260D * pow(z, 5))"
    return _let("z", f"double({n}) + 8D", f"{series} - ln({shift})")


def _log_choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n}) - ({k})')})"


def hypergeometric(items: str, own: str, draws: str, u: str) -> str:
    """SQL that draws how many of ``own`` among ``items`` are in ``draws``, by the inverse of the distribution at u.

    The sum runs over ten standard deviations and ten more on both sides of the
    mean, outside of which less than 1e-20 of the distribution lies.
    """
    spread = "sqrt(greatest(m * k / greatest(n, 1D) * (1D - k / greatest(n, 1D)) * (n - m) / greatest(n - 1D, 1D), 0D))"
    bounds = f"named_struct('low', greatest(0D, m - (n - k), double(floor(m * k / greatest(n, 1D) - 10D * {spread} - 10D))), 'high', least(m, k, double(ceil(m * k / greatest(n, 1D) + 10D * {spread} + 10D))))"
    first = f"exp({_log_choose('k', 'b.low')} + {_log_choose('n - k', 'm - b.low')} - {_log_choose('n', 'm')})"
    start = f"named_struct('p', {first}, 'cum', 0D, 'x', b.high, 'found', false)"
    step = (
        "named_struct('p', a.p * (k - x) * (m - x) / ((x + 1D) * greatest(n - k - m + x + 1D, 1D)), 'cum', a.cum + a.p, "
        "'x', if(not a.found and v < a.cum + a.p, double(x), a.x), 'found', a.found or v < a.cum + a.p)"
    )
    walk = f"aggregate(sequence(bigint(b.low), bigint(b.high)), {start}, (a, x) -> {step}, a -> bigint(a.x))"
    body = _let("b", bounds, walk)
    for name, value in (("v", u), ("m", f"double({draws})"), ("k", f"double({own})"), ("n", f"double({items})")):
        body = _let(name, value, body)
    return body


def _uniform(*parts: str) -> str:
    return f"(double(xxhash64({', '.join(parts)}) & {(1 << 53) - 1}L) / {1 << 53}D)"


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Split (idx, quota) among ``shards`` (a power of two): rows (shard, idx, quota)."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("quota").cast("long").alias("quota")))).alias("own")).selectExpr("1L AS node", "own")
    drawn = hypergeometric("acc.items", "o.quota", "acc.draws", _uniform(str(seed), "node", "o.idx"))
    taken = "named_struct('items', acc.items - o.quota, 'draws', acc.draws - h, 'left', concat(acc.left, array(named_struct('idx', o.idx, 'quota', h))))"
    start = "named_struct('items', total, 'draws', bigint(floor(total / 2)), 'left', cast(array() AS array<struct<idx:int,quota:bigint>>))"
    left = f"aggregate(own, {start}, (acc, o) -> {_let('h', drawn, taken)}, acc -> acc.left)"
    right = "zip_with(own, side, (o, l) -> named_struct('idx', o.idx, 'quota', o.quota - l.quota))"
    for _ in range(shards.bit_length() - 1):
        nodes = nodes.selectExpr("node", "own", "aggregate(own, 0L, (t, o) -> t + o.quota) AS total").selectExpr("node", "own", f"{left} AS side")
        nodes = nodes.selectExpr(f"inline(array(named_struct('node', 2 * node, 'own', side), named_struct('node', 2 * node + 1, 'own', {right})))")
    return nodes.selectExpr(f"node - {shards} AS shard", "inline(own) AS (idx, quota)")


class Mix:
    """The plan of a mix: sources with targets, and which shard draws which block."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0):
        if share > cap:
            raise ValueError("the share must not exceed the cap")
        self.seed = seed
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
        #: One narrow row a document: the texts are read once for the plan.
        self.documents = keep(rows.withColumn("place", self._place(F.col("doc_id"), F.col("size"))))
        words = self.documents.agg(F.sum("size")).first()[0] or 0
        self.shards = shards or max(SHARDS, 1 << max(0, math.ceil(math.log2(max(1.0, words * share / WORDS_PER_SHARD)))))
        self.blocks = max(BLOCKS, BLOCKS_PER_SHARD * self.shards)
        blocks = materialize(self.documents.groupBy("source", self._block(F.col("place")).alias("block")).agg(F.sum("size").alias("words")), "blocks")
        sizes = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
        self.sources = materialize(targets(sizes, weights, share, cap), "sources")
        self.draws = materialize(self._dealt(self._drawn(blocks)), "draws")

    def _place(self, doc_id: Column, size: Column) -> Column:
        return F.xxhash64(F.lit(self.seed), doc_id, size)

    def _block(self, place: Column) -> Column:
        return F.pmod(place, F.lit(self.blocks)).cast("int")

    def _drawn(self, blocks: DataFrame) -> DataFrame:
        """Blocks in the order of the permutation, pass after pass, up to each target."""
        b = blocks.where("words > 0").join(self.sources, blocks["source"].eqNullSafe(self.sources["source"])).select("idx", "block", "words", "source_size", "target")
        order = Window.partitionBy("idx").orderBy(F.xxhash64(F.lit(self.seed + 1), "idx", "block"), "block")
        b = b.withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        b = b.withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1)))
        b = b.withColumn("take", F.least(F.col("words").cast("double"), F.col("target") - F.col("pass") * F.col("source_size") - F.col("before")))
        return b.where("take > 0").select("idx", "block", "pass", (F.col("take") / F.col("words")).alias("part"))

    def _dealt(self, drawn: DataFrame) -> DataFrame:
        """The draws (idx, block, pass, part) of all shards: each takes its run of every source's draws."""
        order = Window.partitionBy("idx").orderBy(F.xxhash64(F.lit(self.seed + 2), "idx", "block", "pass"), "block", "pass")
        ranked = drawn.withColumn("rank", F.row_number().over(order).cast("long"))
        split = split_quotas(ranked.groupBy("idx").agg(F.count("*").alias("quota")), self.shards, self.seed + 3)
        upto = F.sum("quota").over(Window.partitionBy("idx").orderBy("shard"))
        runs = split.withColumn("upto", upto).where("quota > 0").select("idx", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("rank"))
        return runs.join(ranked, ["idx", "rank"]).select("idx", "block", "pass", "part", "shard")

    def _by_block(self) -> DataFrame:
        """One row for each source and block, with the draws of all shards."""
        dealt = self.draws.groupBy("idx", "block").agg(F.array_sort(F.collect_list(F.struct("shard", "pass", "part"))).alias("draws"))
        return dealt.join(self.sources, "idx").select("source", "block", "draws")

    @staticmethod
    def _words(size: Column, part: Column) -> Column:
        return F.when(part >= 1, size).otherwise(F.floor(size * part)).cast("long")

    def taken(self) -> DataFrame:
        """Return doc_id, size, source_size, target, taken and shards for every document.

        ``shards`` lists shard:words of each draw that takes words of the document, and
        ``taken`` is their sum.
        """
        s, b = self.sources, self._by_block()
        d = self.documents.withColumn("block", self._block(F.col("place")))
        rows = d.join(b, d["source"].eqNullSafe(b["source"]) & (d["block"] == b["block"]), "left").select(d["doc_id"], d["source"], d["size"], "draws")
        none = F.array().cast("array<struct<shard:bigint,pass:int,part:double>>")
        runs = F.transform(F.coalesce("draws", none), lambda x: F.struct(x["shard"].alias("shard"), self._words(F.col("size"), x["part"]).alias("words")))
        rows = rows.withColumn("runs", F.filter(runs, lambda x: x["words"] > 0))
        words = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["words"])
        listed = F.array_join(F.transform("runs", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["words"].cast("string"))), ",")
        return rows.join(F.broadcast(s) if s.limit(10_001).count() <= 10_000 else s, rows["source"].eqNullSafe(s["source"])).select("doc_id", "size", "source_size", "target", words.alias("taken"), listed.alias("shards"))

    def rows(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
        """Return the mix itself: the columns of ``docs``, then ``mix_shard``, ``mix_pass`` and ``mix_slot``.

        A text of which only a part is taken keeps its first words.  Rows are
        partitioned by shard and ordered by slot, a hash, within it.
        """
        mark = "mix_"
        while any(c.lower().startswith(mark) for c in docs.columns):
            mark = "_" + mark
        c = lambda name: F.col(mark + name)
        d = docs.withColumn(mark + "size", word_count(F.col(text_col)))
        d = d.withColumn(mark + "block", self._block(self._place(F.col(id_col), c("size"))))
        b = self._by_block().select(F.col("source").alias(mark + "source"), F.col("block").alias(mark + "own"), F.col("draws").alias(mark + "draws"))
        d = d.where(c("size") > 0).join(b, F.col(source_col).eqNullSafe(c("source")) & (c("block") == c("own")))
        d = d.withColumn(mark + "draw", F.explode(c("draws"))).withColumn(mark + "words", self._words(c("size"), F.col(f"{mark}draw.part"))).where(c("words") > 0)
        parts = F.regexp_extract_all(F.col(text_col), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
        text = F.when(c("words") == c("size"), F.col(text_col)).otherwise(F.array_join(F.slice(parts, 1, c("words").cast("int")), ""))
        slot = F.xxhash64(F.lit(self.seed + 4), F.col(id_col), c("size"), F.col(f"{mark}draw.pass"))
        columns = [text.alias(name) if name == text_col else F.col(name) for name in docs.columns]
        out = d.select(*columns, F.col(f"{mark}draw.shard").alias(mark + "shard"), F.col(f"{mark}draw.pass").alias(mark + "pass"), slot.alias(mark + "slot"))
        return out.repartition(self.shards, mark + "shard").sortWithinPartitions(mark + "shard", mark + "slot")
