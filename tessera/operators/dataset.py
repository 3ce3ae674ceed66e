"""Dataset creation: entities, template expansion, variants, seeded sampling,
batch numbers and (question, context, response) triples (D1-D4, A4, T5, U3, J2, W3, K3)."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import (COURSE_NAMES, N_PROFESSORS, SAMPLE_SEED, SEED_TEMPLATES, SEMESTER,
                            SLOT_PRIORITY, TOPICS)

TRIPLE_TEMPLATE = "Question:\n%s\nContext:\n%s\nResponse:\n%s"


def distinct_values(df: DataFrame, col: str, out: str = "value") -> DataFrame:
    """A4: distinct non-null values (partial aggregation before the shuffle)."""
    return df.select(F.col(col).alias(out)).where(F.col(out).isNotNull()).distinct()


def seeded_sample(df: DataFrame, key_col: str, n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """T5: deterministic sample of n rows without replacement: the n smallest
    md5(key || seed). Runs as a top-n per partition plus a merge of n rows each."""
    return (df.withColumn("_h", F.md5(F.concat(F.col(key_col).cast("string"), F.lit(str(seed)))))
            .orderBy("_h").limit(n).drop("_h"))


def templates(spark: SparkSession, items=SEED_TEMPLATES, slots=SLOT_PRIORITY) -> DataFrame:
    """Seed templates with the slot each one expands on (by slot priority; None = no slot)."""
    rows = []
    for i, t in enumerate(items):
        slot = next((s for s in slots if "{" + s + "}" in t), None)
        rows.append((i, t, slot))
    return spark.createDataFrame(rows, "template_id int, template string, slot string")


def fixed_entities(spark: SparkSession) -> DataFrame:
    rows = [("semester", SEMESTER)] + [("course_name", c) for c in COURSE_NAMES] + \
        [("topic", t) for t in TOPICS]
    return spark.createDataFrame(rows, "kind string, value string")


def entities(spark: SparkSession, courses: DataFrame, n_professors: int = N_PROFESSORS,
             seed: int = SAMPLE_SEED) -> DataFrame:
    """Fixed entity lists plus ``n_professors`` sampled distinct faculty names."""
    profs = seeded_sample(distinct_values(courses, "faculty_name"), "value", n_professors, seed)
    return fixed_entities(spark).unionByName(profs.select(F.lit("professor_name").alias("kind"), "value"))


def expand(tmpl: DataFrame, ents: DataFrame) -> DataFrame:
    """D1 + J2: equi-join on the slot kind (a per-kind product, bounded by the
    entity lists), templates without a slot kept by the left join."""
    j = tmpl.join(F.broadcast(ents), tmpl.slot == ents.kind, "left")
    q = F.when(F.col("slot").isNull(), F.col("template")).otherwise(
        F.replace(F.col("template"), F.concat(F.lit("{"), F.col("slot"), F.lit("}")), F.col("value")))
    return j.select("template_id", F.col("value").alias("entity"), q.alias("question"))


VARIANTS_SCHEMA = T.StructType([T.StructField("question", T.ArrayType(T.StringType()))])


def parse_variants(df: DataFrame, response_col: str = "response") -> DataFrame:
    """D2 + U3: model response {"question": [...]} -> one row per variant (malformed -> none)."""
    v = df.withColumn("_v", F.from_json(response_col, VARIANTS_SCHEMA)["question"])
    return v.select("*", F.posexplode(F.coalesce("_v", F.array().cast("array<string>")))
                    .alias("variant_idx", "variant")).drop("_v")


def consecutive_index(df: DataFrame, order_cols: list[str], out: str = "row_idx") -> DataFrame:
    """0-based consecutive index in the given order without a single-partition window:
    range-partition and sort, count rows per partition (one small row per
    partition to the driver), then each partition numbers its rows from its offset."""
    # A reliable checkpoint (in the shared checkpoint folder) fixes the
    # partitioning, so the counting pass and the numbering pass see the same rows.
    cached = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols).persist()
    s = cached.checkpoint()
    cached.unpersist()
    counts = dict(s.groupBy(F.spark_partition_id().alias("p")).count().collect())
    offsets, acc = {}, 0
    for p in range(s.rdd.getNumPartitions()):
        offsets[p] = acc
        acc += counts.get(p, 0)
    schema = T.StructType(s.schema.fields + [T.StructField(out, T.LongType())])

    def number(batches):
        start = offsets.get(TaskContext.get().partitionId(), 0)
        for pdf in batches:
            pdf = pdf.copy()
            pdf[out] = range(start, start + len(pdf))
            start += len(pdf)
            yield pdf
    return s.mapInPandas(number, schema)


def batch_numbers(df: DataFrame, order_cols: list[str], size: int = 5) -> DataFrame:
    """Consecutive groups of ``size`` rows in order."""
    return consecutive_index(df, order_cols).withColumn(
        "batch", F.floor(F.col("row_idx") / size).cast("long"))


def triples(questions: DataFrame, contexts: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """(question, context array, response) and the rendered text form.
    Without a response table the offline default answers with the first line of
    the top context document."""
    t = questions.join(contexts, "query_id", "left").withColumn(
        "docs", F.coalesce("docs", F.array().cast("array<string>")))
    if responses is not None:
        t = t.join(responses, "query_id", "left")
    else:
        t = t.withColumn("response", F.coalesce(F.get(F.split(F.get("docs", 0), "\n"), 0), F.lit("")))
    return t.select("query_id", "question", F.col("docs").alias("context"), "response",
                    F.format_string(TRIPLE_TEMPLATE, F.col("question"), F.array_join("docs", "\n"),
                                    F.col("response")).alias("text"))


def chat_messages(system_prompt: str, user_col: str, assistant_col: str):
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
                   F.struct(F.lit("user").alias("role"), F.col(user_col).alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.col(assistant_col).alias("content")))

