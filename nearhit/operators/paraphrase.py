"""Paraphrase-pair generation: number statements, batch them into prompts,
parse the provider's answers back into variants and pair them up.

A statement's position is its place in its own text plus the running total
of statements in earlier texts (``running_total``: bucketed sums, no window
over statements). A batch holds at most ``batch_size`` statements, so
collecting a batch's lines into one prompt is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhit.functions.text import clean_lines, strip_numbering, strip_ws
from nearhit.operators.rank import running_total

BATCH_SIZE = 10
# The prompt wording around the numbered statements.
PROMPT_HEAD = ("Generate semantically equivalent statements that convey the same meaning as the following "
               "statements, but using different words and phrasing.\n\nFor each statement below, provide ONLY "
               "the rephrased version without any numbering, explanation, or additional text. Separate each "
               "rephrased statement with a newline.\n\n")
PROMPT_TAIL = "\nProvide the rephrased statements in order, one per line:"


def read_statement_lines(df: DataFrame, text_col: str = "text", key: str = "item_id") -> DataFrame:
    """Non-blank stripped lines of a text column, with their line number and
    their place ``nth`` among the text's non-blank lines."""
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(i.alias("line_no"), strip_ws(x).alias("statement"))),
                     lambda x: x["statement"] != "")
    return df.select(key, F.posexplode_outer(lines).alias("nth", "_l")).where(F.col("nth").isNotNull()).select(
        key, "_l.line_no", "_l.statement", "nth")


def statement_batches(statements: DataFrame, key: str = "item_id", batch_size: int = BATCH_SIZE) -> DataFrame:
    """Global 0-based position, batch number (``position div batch_size``) and slot of each statement.

    ``key`` numbers the texts (numeric, one text each); ``nth`` is the place within a text."""
    sizes = statements.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    before = running_total(sizes, key, "_n").select(key, "_before")
    return (statements.join(before, key).withColumn("position", F.col("_before") + F.col("nth")).drop("_before", "nth")
             .withColumn("batch", F.floor(F.col("position") / batch_size).cast("long"))
             .withColumn("slot", F.pmod(F.col("position"), F.lit(batch_size)).cast("int")))


def batch_prompts(batches: DataFrame) -> DataFrame:
    """One prompt per batch: ``k. statement`` lines in position order."""
    g = batches.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("slot", "statement"))).alias("_items"),
                                     F.count(F.lit(1)).alias("n_statements"))
    lines = F.transform("_items", lambda x: F.concat((x["slot"] + 1).cast("string"), F.lit(". "), x["statement"]))
    body = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    return g.select("batch", "n_statements", F.concat(F.lit(PROMPT_HEAD), body, F.lit(PROMPT_TAIL)).alias("prompt"))


def parse_variants(responses: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lines of the answer, stripped, blanks dropped, numbering removed, then
    padded with '' or cut to the batch size; one row per (batch, answer, slot).
    A failed batch (null response, or no answer at all) yields '' for every slot.

    ``keys`` are the columns that tell a batch's answers apart, where a batch is answered more than
    once; they are null for a batch without an answer. The batch table has one narrow row a
    batch; answers are split where they lie and joined by batch, so a batch with a large share of all answers
    is split by the adaptive skew join."""
    j = sizes.join(responses, "batch", "left")
    cleaned = F.transform(clean_lines(F.coalesce(F.col("response"), F.lit(""))), lambda x: strip_numbering(x))
    padded = F.slice(F.concat(cleaned, F.array_repeat(F.lit(""), F.col("n_statements").cast("int"))), 1, F.col("n_statements").cast("int"))
    return j.select("batch", *keys, F.posexplode(padded).alias("slot", "variant"))


def paraphrase_pairs(batches: DataFrame, variants: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(statement, semantically_same_statement) for non-empty variants, with the ``keys`` of their answer."""
    return (batches.join(variants, ["batch", "slot"])
                   .where(F.col("variant") != "")
                   .select("position", *keys, F.col("statement"), F.col("variant").alias("semantically_same_statement")))


def paraphrase_yield(variants: DataFrame) -> DataFrame:
    """(statements, pairs, yield_pct): slots asked for over all answers, and how many hold a variant."""
    got = variants.agg(F.count(F.lit(1)).alias("statements"), F.count_if(F.col("variant") != "").alias("pairs"))
    return got.withColumn("yield_pct", F.when(F.col("statements") > 0, F.col("pairs") / F.col("statements") * 100).otherwise(0.0))
