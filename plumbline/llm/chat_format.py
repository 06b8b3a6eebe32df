"""Chat formatting: reply trees become conversations.

Messages form trees by (tree, message, parent). Iterative self-joins with doubling jumps give each message its
depth and the score of its path from the root in a logarithmic number of rounds; leaves are ranked by that
score within their tree; only the chosen leaves' ancestors are then enumerated, again by the jumps, and each
chosen path is formatted as one conversation.

Template. A turn is BEGIN role newline, the escaped text, END newline. Inside roles and texts, every `\\` is
doubled and every control string (BEGIN, END, or one of CONTROLS) gets `\\-` after its first character, so no
control string can occur inside a text and unescaping gives back the exact text. The loss mask is the list
of spans of the escaped text of assistant turns.
"""
from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from plumbline.llm.common import discard, materialize, table

NAME = "op2_chat_format"

#: The marks of the template, and control strings of common templates that texts may hold.
BEGIN, END = "<|turn|>", "<|end|>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|user|>", "<|assistant|>", "<|system|>")
TRAINED = ("assistant",)

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted((BEGIN, END, *CONTROLS), key=len, reverse=True)))


def escape(text: str) -> str:
    """Reversible: backslashes are doubled, and each control string gets `\\-` after its first character."""
    text, before = text.replace("\\", "\\\\"), None
    while before != text:  # what an insertion leaves may hold a control string that overlapped
        before = text
        text = _CONTROL.sub(lambda m: m[0][0] + "\\-" + m[0][1:], text)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|-)", lambda m: "\\" if m[1] == "\\" else "", text)


def render(turns) -> tuple[str, list[list[int]]]:
    """The conversation of (role, text) turns, and the spans of it that the loss covers."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        if role in TRAINED:
            spans.append([at + len(head), at + len(head) + len(body)])
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


_TURN = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    role = lambda s: re.sub(r"\\(\\|-|n)", lambda m: {"\\": "\\", "-": "", "n": "\n"}[m[1]], s)
    return [(role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def chosen_paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, position, message) of the top branches of each tree.

    messages(tree, message, parent, score): ids of any type, unique in a tree; a null parent, or one that is
    missing from the tree, makes a root; null scores count 0. A branch scores the sum over its messages; ties go
    to the smaller leaf. top None keeps all branches. Messages on a cycle reach no root and are in no path.
    """
    spark = messages.sparkSession
    m = messages.select(F.struct("tree").alias("tree"), "message", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))  # a struct, as null trees must meet too
    known = m.select("tree", F.col("message").alias("parent"), F.lit(True).alias("known"))
    start = m.join(known, ["tree", "parent"], "left").select("tree", "message", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("steps"), "score")
    now, path = materialize(start, "reply-jumps")
    paths, rounds, closed, before = [path], [now.filter("up is not null")], now.filter("up is null"), None
    while (count := rounds[-1].count()) not in (0, before):  # the same count again: only cycles are left
        before, open_ = count, rounds[-1]
        far = closed.unionByName(open_).select("tree", F.col("message").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"), F.col("score").alias("plus"))
        longer = open_.join(far, ["tree", "up"]).select("tree", "message", F.col("up2").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("score") + F.col("plus")).alias("score"))
        now, path = materialize(longer, "reply-jumps")  # rows that have reached their root are written once
        paths.append(path)
        rounds.append(now.filter("up is not null"))
        closed = closed.unionByName(now.filter("up is null"))
    done = closed
    replied = m.select("tree", F.col("parent").alias("message")).distinct()
    leaves = done.join(replied, ["tree", "message"], "left_anti")
    if top is not None:
        rank = F.row_number().over(W.partitionBy("tree").orderBy(F.col("score").desc(), "message"))
        leaves = leaves.withColumn("rank", rank).filter(F.col("rank") <= top)
    else:
        leaves = leaves.withColumn("rank", F.lit(None).cast("int"))
    out, last = materialize(leaves.select("tree", F.col("message").alias("leaf"), "rank", F.col("score").alias("branch_score"), "message", F.col("steps").alias("position")), "reply-paths")
    for jumps in reversed(rounds[:-1]):  # each row adds the message that many steps above it
        up = jumps.select("tree", "message", "up", F.col("steps").alias("by"))
        above = out.join(up, ["tree", "message"]).select("tree", "leaf", "rank", "branch_score", F.col("up").alias("message"), (F.col("position") - F.col("by")).alias("position"))
        out, path = materialize(out.unionByName(above), "reply-paths")
        paths.append(last)
        last = path
    discard(spark, *paths)
    return out.withColumn("tree", F.col("tree.tree"))


def format_trees(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, branch_score, n_turns, formatted, loss_spans) of each chosen path.

    messages(tree, message, parent, role, text, score); null roles and texts are empty. A conversation is one
    value, so its turns come together in one task; texts travel to it once.
    """
    path = chosen_paths(messages, top).withColumn("tree", F.struct("tree"))
    said = messages.select(F.struct("tree").alias("tree"), "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = path.join(said, ["tree", "message"]).groupBy("tree", "leaf", "rank", "branch_score").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))

    @F.pandas_udf("formatted string, loss_spans array<array<int>>")
    def formatted(turns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([render([(t["role"], t["text"]) for t in x]) for x in turns], columns=["formatted", "loss_spans"])

    out = turns.withColumn("out", formatted(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))))
    return out.select(F.col("tree.tree").alias("tree"), "leaf", "rank", "branch_score", F.size("turns").cast("long").alias("n_turns"), "out.formatted", "out.loss_spans")


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the formatted text and the loss spans alone."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def digest(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(formatted, spans):
            turns = parse(text)
            loss = "".join(unescape(text[a:b]) for a, b in own)
            sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return conversations.select("tree", digest("formatted", "loss_spans").alias("d")).select(F.col("tree").alias("conv_id"), "d.*")


def conversation_trees(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as trees with one branch: each row answers the one before it.

    Rows of one turn are ordered by role, then text (nulls as empty); exact repeats stay, one after another.
    Rows with a null turn come first; those with a null conv_id form one conversation of their own.
    """
    rows = conversations.select(F.col("conv_id").alias("tree"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return rows.withColumn("message", at).select("tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    trees, _ = materialize(conversation_trees(rows), "reply-trees")
    return read_back(format_trees(trees))


ORACLE_SQL = """
WITH own AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
  replace(text, chr(92), chr(92) || chr(92)) AS e FROM own)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>') + length(role) + 1 + length(e) + 2 * len(regexp_extract_all(text, '<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<\\|(im_start|im_end|endoftext|eot_id|user|assistant|system|turn|end)\\|>')) + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
