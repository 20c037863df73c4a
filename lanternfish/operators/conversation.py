"""Conversations: history under a token budget, tool prompts, image counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE_TOKENS = 257


def cost(tokens: Column, has_image: Column, is_user: Column, accounting: str = "full") -> Column:
    """Tokens that a message counts for.  In 'reference' accounting only responses were ever added to the running
    total; 'full' counts everything."""
    whole = tokens + F.when(has_image, IMAGE_TOKENS).otherwise(0)
    return whole if accounting == "full" else F.when(is_user, 0).otherwise(tokens)


def evict(messages: DataFrame, budget: int, cost_column: str = "cost", total: Column | None = None) -> DataFrame:
    """Messages (conv_id, turn, cost) that stay: the oldest go while what is left reaches the budget.  Costs are not
    negative, so that is a prefix, and a running sum decides each row."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    left = (F.sum(cost_column).over(whole) if total is None else total) - (F.sum(cost_column).over(before) - F.col(cost_column))
    return messages.withColumn("__left", left).where(F.col("__left") < budget).drop("__left")


def inject_tools(messages: DataFrame, prompt: str, family: str = "general") -> DataFrame:
    """The tools prompt stands before the first text message of the user in each conversation; in the function
    family the user's turn is wrapped here."""
    first = messages.where("is_user and type = 'text'").groupBy("conv_id").agg(F.min("turn").alias("__first"))
    joined = messages.join(first, "conv_id", "left")
    if family == "function":
        text = F.concat(F.lit(prompt + "<start_of_turn>user\n"), F.col("text"), F.lit("\n<end_of_turn>\n<start_of_turn>model\n"))
    else:
        text = F.concat(F.lit(prompt + "\n"), F.col("text"))
    hit = F.coalesce((F.col("turn") == F.col("__first")) & F.col("is_user") & (F.col("type") == "text"), F.lit(False))
    return joined.withColumn("text", F.when(hit, text).otherwise(F.col("text"))).select(messages.columns)


def image_messages(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count_if(F.col("image_bytes").isNotNull()).alias("images"))


def fold_responses(events: DataFrame) -> DataFrame:
    """(stream_id, text, thinking, call, result) of classified events (stream_id, out_seq, kind, text, fn_name):
    pieces in order, the last call, and call, else text, else '...'."""
    part = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("out_seq", "text")))), lambda x: x["text"]), "")
    call = F.max_by(F.when(F.col("kind") == "call", F.col("fn_name")), F.when(F.col("kind") == "call", F.col("out_seq")))
    folded = events.groupBy("stream_id").agg(part("text").alias("text"), part("thinking").alias("thinking"), call.alias("call"))
    return folded.withColumn("result", F.coalesce("call", F.nullif(F.col("text"), F.lit("")), F.lit("...")))
