"""Chat formatting over reply trees, with DataFrame functions only.

Messages name their parents. The paths from root to leaf come from self-joins that double the distance each time; the
paths of a conversation are ranked by the sum of their messages' scores, and each chosen one is written as a text:

    <s>role\\ntext</s><s>role\\ntext</s>...

A control string within a text gets one backslash after its first character, and one that has backslashes there gets
one more: so taking one away from each restores every text. loss holds the places of the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

#: In Java's regular expressions, as SQL literals have them.
PLAIN_CONTROL = r"(<|\\[)(\\\\*)(/?s>|/?INST\\]|/?<SYS>>|<SYS>>|</SYS>>)"
ESCAPED_CONTROL = r"(<|\\[)\\\\(\\\\*)(/?s>|/?INST\\]|/?<SYS>>|<SYS>>|</SYS>>)"
MOST_ROUNDS = 40  # of doubling: 2**40 turns


def escaped(x: str) -> str:
    return f"regexp_replace({x}, '{PLAIN_CONTROL}', '$1\\\\\\\\$2$3')"


def unescaped(x: str) -> str:
    return f"regexp_replace({x}, '{ESCAPED_CONTROL}', '$1$2$3')"


def role_text(x: str) -> str:
    """A role on one line."""
    return f"replace(replace({escaped(x)}, '~', '~0'), '\\n', '~1')"


def role_back(x: str) -> str:
    return unescaped(f"replace(replace({x}, '~1', '\\n'), '~0', '~')")


def branches(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """conv_id, branch (its leaf), rank, place (from 0 at the root), node: the `top` best branches of each conversation
    (None: all). messages: conv_id, node (long, unique in its conversation), parent (null: a root), score.

    A parent that isn't there makes its message a root; a null score is 0; ties go to the smaller leaf; a null conv_id
    is a conversation. A cycle, and all that hangs off one, has no root and is left out: a path longer than its
    conversation isn't followed, and a branch counts if it reaches a root.
    """
    m = messages.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    sizes = m.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n_messages"))
    there = m.select(F.col("conv_id").alias("c"), F.col("node").alias("up"))
    jump = m.where("parent is not null").join(there, F.expr("conv_id <=> c and parent = up")).select("conv_id", "node", "up")
    jump = replies = stored(jump, "replies")
    leaf = m.join(jump.select(F.col("conv_id").alias("c"), F.col("up").alias("p")).distinct(), F.expr("conv_id <=> c and node = p"), "left_anti")
    leaf = leaf.join(sizes, F.expr("conv_id <=> c"))
    rounds = [stored(leaf.select("conv_id", F.col("node").alias("branch"), "node", F.lit(0).cast("long").alias("distance"), "n_messages"), "paths")]
    for k in range(MOST_ROUNDS):
        step = jump.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up"))
        so_far = rounds[0]
        for r in rounds[1:]:
            so_far = so_far.union(r)
        more = so_far.join(step, F.expr("conv_id <=> c and node = n")).select("conv_id", "branch", F.col("up").alias("node"), (F.col("distance") + (1 << k)).alias("distance"), "n_messages")
        more = stored(more.where("distance < n_messages"), "paths")
        if more.isEmpty():
            break
        rounds.append(more)
        jump = stored(jump.join(step.withColumnRenamed("up", "far"), F.expr("conv_id <=> c and up = n")).select("conv_id", "node", F.col("far").alias("up")), "replies")
    paths = rounds[0]
    for r in rounds[1:]:
        paths = paths.union(r)
    first_jump = replies.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.lit(False).alias("root"))
    scores = m.select("conv_id", "node", "score").join(first_jump, F.expr("conv_id <=> c and node = n"), "left").select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "score", F.coalesce("root", F.lit(True)).alias("root"))
    scored = paths.join(scores, F.expr("conv_id <=> c and node = n")).groupBy("conv_id", "branch").agg(F.sum("score").alias("score"), F.max("distance").alias("length"), F.bool_or("root").alias("rooted")).where("rooted")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "branch")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    ranked = ranked.select(F.col("conv_id").alias("c"), F.col("branch").alias("b"), "rank", "length")
    return paths.join(ranked, F.expr("conv_id <=> c and branch = b")).select("conv_id", "branch", "rank", (F.col("length") - F.col("distance")).alias("place"), "node")


def formatted(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """conv_id, branch, rank, formatted, loss (start and end of each assistant's text, in code points) of each chosen
    branch. messages also have role and text; nulls there are empty. An empty table gives an empty one."""
    chosen = branches(messages, top)
    said = messages.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = chosen.join(said, F.expr("conv_id <=> c and node = n"))
    turns = turns.withColumn("head", F.expr(f"concat('<s>', {role_text('role')}, '\\n')")).withColumn("body", F.expr(escaped("text")))
    whole = turns.groupBy("conv_id", "branch", "rank").agg(F.array_sort(F.collect_list(F.struct("place", "role", "head", "body"))).alias("turns"))
    out = whole.withColumn("formatted", F.expr("array_join(transform(turns, t -> concat(t.head, t.body, '</s>')), '')"))
    spans = """aggregate(turns, struct(0L as at, cast(array() as array<struct<start: bigint, end: bigint>>) as spans), (a, t) -> struct(
        a.at + length(t.head) + length(t.body) + 4L as at,
        if(t.role = 'assistant', concat(a.spans, array(struct(a.at + length(t.head) as start, a.at + length(t.head) + length(t.body) as end))), a.spans) as spans), a -> a.spans)"""
    return out.withColumn("loss", F.expr(spans)).drop("turns")


def parsed(out: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), trained (the text under the loss mask), read back from formatted and loss."""
    pieces = "filter(split(formatted, '</s>'), (x, i) -> x <> '')"
    after = "substring(x, instr(x, '\\n') + 1)"
    turns = F.expr(f"transform({pieces}, x -> struct({role_back("substring(x, 4, instr(x, '\\n') - 4)")} as role, {unescaped(after)} as text))")
    trained = F.expr(f"array_join(transform(loss, s -> {unescaped('substring(formatted, cast(s.start + 1 as int), cast(s.end - s.start as int))')}), '')")
    return out.withColumn("turns", turns).withColumn("trained", trained)


def threads(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees of one branch: a row's parent is the row before it."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return conversations.select("conv_id", "role", "text", place.alias("node")).withColumn("parent", F.expr("nullif(node - 1, 0)")).withColumn("score", F.lit(0.0))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.sql(f"select * from values (-1L, 0L, 'user', '{text}'), (-1L, 1L, 'assistant', '{text}') as t(conv_id, turn, role, text)")
    messages = stored(threads(given.unionByName(own)), "messages")
    back = parsed(stored(formatted(messages), "chats"))
    digest = F.sha2(F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')").cast("binary"), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
