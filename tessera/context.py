"""Context for a question: blocks, prompts and what an older reducer's output holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text as T
from tessera.functions import vectors as V

SEPARATOR = "\n\n---\n\n"
#: Fixed value: the instruction that the model gets.
SYSTEM = "You are a concise TA. Answer ONLY from the provided context. If the answer isn’t present, reply exactly: I can’t find that in the context."


def block(pos: Column, title: Column, section: Column, doc: Column, score: Column, snippet: Column) -> Column:
    return F.format_string("[%d] %s — %s (docId=%s, score=%.4f)\n%s", pos, title, section, doc, V.rounded(score, 4), snippet)


def hit_block(source: Column, doc: Column, chunk: Column, score: Column, text: Column) -> Column:
    return F.format_string("[%s #%d | score=%.4f]\n%s", F.when(F.length(F.coalesce(source, F.lit(""))) > 0, source).otherwise(doc), chunk, V.rounded(score, 4), text)


def joined(df: DataFrame, group: list[str], order: list[str], text: str, separator: str = SEPARATOR) -> DataFrame:
    """One string of each group's texts, in order."""
    one = F.struct(*order, F.col(text).alias("_text"))
    return df.groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["_text"]), separator).alias("context"))


def first_by_prefix(df: DataFrame, text: str, order: list[str], group: list[str] | None = None, prefix: int = 160) -> DataFrame:
    """Rows whose first `prefix` characters come up for the first time in order (within group)."""
    w = Window.partitionBy(*(group or []), F.substring(F.col(text), 1, prefix)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def messages(question: str, context: str, config: Config | None = None) -> list[dict[str, str]]:
    c = config or Config()
    user = f"Question: {question[: c.max_question]}\n\nUse ONLY this context (truncated):\n{context[: c.max_context]}"
    return [{"role": "system", "content": SYSTEM}, {"role": "user", "content": user}]


def prompt(question: Column, context: Column, config: Config | None = None) -> Column:
    """The user's message, as an expression."""
    c = config or Config()
    return F.concat(F.lit("Question: "), F.substring(question, 1, c.max_question), F.lit("\n\nUse ONLY this context (truncated):\n"), F.substring(context, 1, c.max_context))


HITS_JSON = "question string, topK int, hits array<struct<score:double,doc_id:string,chunk_id:int,source:string,text:string,preview:string>>, context string"


#: A JSON string's body, for lines that don't parse as a whole.
STRING = r'"((?:\\.|[^"\\])*)"'


def _field(value: Column, name: str) -> Column:
    """A string field found by pattern, unescaped; null where there is none."""
    body = F.regexp_extract(value, rf'"{name}"\s*:\s*{STRING}', 1)
    return F.when(F.length(body) > 0, F.from_json(F.concat(F.lit('{"c":"'), body, F.lit('"}')), "c string")["c"])


def _texts(value: Column) -> Column:
    """Texts of the hits of a line that doesn't parse, with a score of 0, in their order."""
    found = F.regexp_extract_all(value, F.lit(rf'"text"\s*:\s*{STRING}'), F.lit(1))
    hit = lambda t: F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("int").alias("chunk_id"), F.lit(None).cast("string").alias("source"), F.from_json(F.concat(F.lit('{"c":"'), t, F.lit('"}')), "c string")["c"].alias("text"), F.lit(None).cast("string").alias("preview"))
    return F.when(value.contains('"hits"') & (F.size(found) > 0), F.transform(found, hit))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of hits or context as JSON; `bad` marks those that don't parse or hold neither."""
    p = lines.select("*", F.from_json(F.trim(F.col(value)), HITS_JSON).alias("j"))
    return p.withColumn("bad", F.col("j.hits").isNull() & F.col("j.context").isNull())


def context_from_hits(lines: DataFrame, group: str, value: str = "value", most: int = 2048) -> DataFrame:
    """group, context: of its context line, if there is one; else of its hits (best first, without repeats by
    prefix, blocks under 40 characters and reference lists); else of all its lines. Clipped with an ellipsis."""
    p = parse_lines(lines, value)
    tidy = lambda t: F.trim(F.replace(F.regexp_replace(t, r"\s+", " "), F.lit(" ? "), F.lit("? ")))
    direct = p.where(F.col(value).contains('"context"')).groupBy(group).agg(F.min(F.coalesce("j.context", _field(F.col(value), "context"), F.trim(F.col(value)))).alias("c")).select(group, T.clip(tidy(F.col("c")), most, "…").alias("context"))
    left = p.join(direct, group, "left_anti")
    left = left.withColumn("_hits", F.coalesce("j.hits", _texts(F.col(value))))
    hits = left.where("_hits IS NOT NULL").select(group, F.posexplode("_hits").alias("pos", "h")).select(group, "pos", "h.*").withColumn("text", F.coalesce("text", "preview")).where("length(text) > 0")
    block = tidy(hit_block(F.col("source"), F.lit(""), F.coalesce("chunk_id", F.lit(-1)), F.coalesce("score", F.lit(0.0)), F.col("text")))
    hits = hits.select(group, F.coalesce(-F.col("score"), F.lit(0.0)).alias("neg"), "pos", block.alias("block"))
    hits = first_by_prefix(hits, "block", ["neg", "pos"], [group]).where((F.length("block") >= 40) & ~T.is_references(F.col("block")))
    of_hits = joined(hits, [group], ["neg", "pos"], "block", "\n\n")
    seen = left.where("_hits IS NOT NULL").select(group).distinct().join(of_hits, group, "left").select(group, T.clip(F.coalesce("context", F.lit("")), most, "…").alias("context"))
    plain = left.join(seen.select(group), group, "left_anti").where(F.length(F.trim(F.col(value))) > 0).withColumn("_line", F.trim(F.col(value)))
    rest = joined(plain, [group], ["_line"], "_line", "\n").select(group, T.clip(tidy(F.col("context")), most, "…").alias("context"))
    return direct.unionByName(seen).unionByName(rest)
