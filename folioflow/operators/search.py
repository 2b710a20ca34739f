"""Hybrid search over indexed chunks, and conversations that are answered from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import contextual_text, strip
from folioflow.operators import chat, hybrid, providers, vector
from folioflow.operators.lexical import Index
from folioflow.sources.scratch import written


class HybridSearch:
    """Search over chunks (chunk_id, chapter, section, current_heading, content, embedding, ...).

    The lexical index is built once, over all chunks; filters only say which chunks
    are candidates, and scores are scaled among these.
    """

    def __init__(self, chunks: DataFrame, embed: providers.Provider = providers.stub_embedding):
        self.chunks, self.embed = chunks, embed
        self.payload = hybrid.payload(chunks)
        text = contextual_text(F.col("chapter"), F.col("section"), F.col("current_heading"), F.col("content"))
        self.index = Index(self.payload, "chunk_id", text)

    def search(self, queries: DataFrame, top_k: int = 10, filters: dict[str, str | int | None] | None = None) -> DataFrame:
        """Return (query_id, rank, score, lexical, semantic, and the payload) of queries (query_id, query)."""
        asked = written(providers.embed(queries.select("query_id", "query"), "query", self.embed), "asked")
        keep = self.chunks.where(hybrid.metadata_filter(filters or {}, self.chunks.columns))
        semantic = vector.cosine(asked.select("query_id", F.col("embedding").alias("qv")), keep.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v")))
        best = hybrid.top_k(hybrid.fuse(semantic, self.index.scores(asked, "query_id", "query")), top_k)
        return best.join(self.payload, best["id"] == self.payload["chunk_id"]).drop("id")


#: The prompts' frames of a rewrite and of an answer, with places for their parts.
REWRITE = """Dưới đây là lịch sử hội thoại gần nhất giữa Người dùng và Trợ lý, cùng với câu hỏi mới của Người dùng.

[LỊCH SỬ HỘI THOẠI]:
{history}

[CÂU HỎI MỚI CỦA NGƯỜI DÙNG]:
"{question}"
"""
ANSWER = """[NGỮ CẢNH TÀI LIỆU ĐƯỢC CUNG CẤP]:
{context}

[CÂU HỎI HIỆN TẠI CỦA NGƯỜI DÙNG]:
{question}
"""


def _filled(frame: str, **parts: str):
    """A prompt's frame as an expression, with columns in its places."""
    out, rest = [], frame
    for name, column in parts.items():
        before, rest = rest.split("{" + name + "}")
        out += [F.lit(before), F.coalesce(F.col(column), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def guarded(provider: providers.Provider, failed: Callable[[Exception, str], object]) -> providers.Provider:
    """A provider that gives ``failed(error, input)`` for inputs that it raises an error for."""

    def run(inputs: list[str]) -> list:
        try:
            return provider(inputs)
        except providers.QuotaError:
            raise
        except Exception as error:  # whatever a service may raise; one input at a time finds which
            if len(inputs) == 1:
                return [failed(error, inputs[0])]
            return [x for i in inputs for x in run([i])]

    return run


def ask(questions: DataFrame, history: DataFrame, engine: HybridSearch, rewrite: providers.Provider, answer: providers.Provider, top_k: int = chat.CHAT_TOP_K) -> tuple[DataFrame, DataFrame]:
    """Answer the next question of many conversations; return the answers, and the history with two more entries each.

    ``questions`` is (session_id, question), one row a conversation, and ``history``
    (session_id, turn, role, text).  A question with a history before it is rewritten;
    where that fails or gives nothing, it is asked as it is.  Answers are (session_id,
    question, search_query, context, answer, sources); an error stands in the answer.
    """
    lines = history.where(F.col("text").isNotNull())
    last = lines.groupBy("session_id").agg(F.max("turn").alias("turn"))
    label = F.concat(F.when(F.col("role") == "user", chat.USER_LABEL).otherwise(chat.OTHER_LABEL), F.lit(": "), F.col("text"))
    recent = lines.join(last.withColumnRenamed("turn", "end"), "session_id").where(F.col("turn") > F.col("end") - chat.ANSWER_ENTRIES)
    said = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") > F.col("end") - n, F.struct("turn", label.alias("t"))))), lambda x: x["t"]), "\n")
    before = recent.groupBy("session_id").agg(said(chat.REWRITE_ENTRIES).alias("few"), said(chat.ANSWER_ENTRIES).alias("more"))
    now = questions.select("session_id", strip(F.col("question")).alias("question")).join(before, "session_id", "left")
    prompts = now.withColumn("prompt", _filled(REWRITE, history="few", question="question"))
    new = providers.apply(prompts.where(chat.needs_rewrite(F.length("few"))), guarded(rewrite, lambda _, __: None), "prompt", "new", T.StringType())
    new = new.select("session_id", F.expr("nullif(new, '')").alias("new")).withColumn("new", chat.unquoted(F.col("new")))
    asked = now.join(new, "session_id", "left").withColumn("search_query", F.coalesce(F.expr("nullif(new, '')"), "question")).drop("new")
    asked = written(asked.withColumn("query_id", F.col("session_id")), "asked")
    found = written(engine.search(asked.select("query_id", F.col("search_query").alias("query")), top_k), "found")
    blocks = found.withColumn("block", chat.context_block(F.col("logical_page"), F.col("chapter"), F.col("current_heading"), F.col("content")))
    both = asked.join(chat.context(blocks), "query_id", "left").join(chat.source_line(found), "query_id", "left")
    both = both.withColumn("prompt", F.concat_ws("\n", F.expr("nullif(more, '')"), _filled(ANSWER, context="context", question="question")))
    answered = providers.apply(both, guarded(answer, lambda e, _: f"Xin lỗi, đã xảy ra lỗi khi tạo câu trả lời: {e}"), "prompt", "answer", T.StringType())
    answers = written(answered.select("session_id", "question", "search_query", "context", strip(F.col("answer")).alias("answer"), "sources"), "answers")
    start = F.coalesce(F.col("turn"), F.lit(-1))
    pair = F.array(F.struct((start + 1).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct((start + 2).alias("turn"), F.lit("model").alias("role"), F.col("answer").alias("text")))
    entries = answers.join(last, "session_id", "left").select("session_id", F.explode(pair).alias("x")).select("session_id", F.col("x.turn").cast("int").alias("turn"), "x.role", "x.text")
    return answers, history.select("session_id", F.col("turn").cast("int").alias("turn"), "role", "text").unionByName(entries)


def converse(questions: DataFrame, engine: HybridSearch, rewrite: providers.Provider, answer: providers.Provider, top_k: int = chat.CHAT_TOP_K) -> DataFrame:
    """Answer all questions (session_id, turn, question) of conversations, turn by turn, all conversations at once.

    Returns the answers with their ``turn``.  There are as many rounds as the longest
    conversation has turns.
    """
    spark = questions.sparkSession
    placed = written(questions.select("session_id", F.expr("row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1").alias("k"), "turn", "question"), "questions")
    history = spark.createDataFrame([], f"session_id {dict(placed.dtypes)['session_id']}, turn int, role string, text string")
    rounds, out = placed.agg(F.max("k")).first()[0], None
    for k in range(-1 if rounds is None else rounds + 1):
        now = placed.where(F.col("k") == k)
        answers, history = ask(now.select("session_id", "question"), history, engine, rewrite, answer, top_k)
        history = written(history, "history")
        answers = answers.join(now.select("session_id", "turn"), "session_id")
        out = answers if out is None else out.unionByName(answers)
    if out is None:
        raise ValueError("there are no questions")
    return out
