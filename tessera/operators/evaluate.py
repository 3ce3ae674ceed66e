"""Evaluation metrics as DataFrame jobs.

n-gram metrics work on exploded, counted grams joined per pair (clipped counts
by ``least``), so a pair's work is proportional to its length and pairs are
spread over partitions. ROUGE-L needs a longest-common-subsequence per pair:
an Arrow-batched pandas UDF computes it bit-parallel on each pair's whole
token lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import explode_nonempty, tokens


def ngram_counts(df: DataFrame, key: str, toks_col: str, n: int, out: str = "cnt") -> DataFrame:
    """(key, gram, cnt) for word n-grams of a token array column."""
    t = F.col(toks_col)
    if n == 1:
        grams = t
    else:
        grams = F.when(F.size(t) >= n, F.transform(
            F.sequence(F.lit(0), F.size(t) - n),
            lambda i: F.array_join(F.slice(t, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    g = df.select(key, grams.alias("_g")).select(key, explode_nonempty("_g", "gram")).where(
        F.col("gram").isNotNull())
    return g.groupBy(key, "gram").agg(F.count(F.lit(1)).alias(out))


def rouge_n(pairs: DataFrame, key: str, cand_col: str, ref_col: str, n: int = 1,
            digits: int = 6) -> DataFrame:
    """Per pair recall, precision, F1 of clipped n-gram overlap."""
    t = pairs.select(key, tokens(cand_col).alias("ct"), tokens(ref_col).alias("rt"))
    c = ngram_counts(t, key, "ct", n, "c")
    r = ngram_counts(t, key, "rt", n, "r")
    overlap = c.join(r, [key, "gram"]).groupBy(key).agg(F.sum(F.least("c", "r")).alias("ov"))
    tot_c = c.groupBy(key).agg(F.sum("c").alias("nc"))
    tot_r = r.groupBy(key).agg(F.sum("r").alias("nr"))
    x = (t.select(key).join(tot_c, key, "left").join(tot_r, key, "left").join(overlap, key, "left")
         .fillna(0, ["nc", "nr", "ov"]))
    rec = F.when(F.col("nr") > 0, F.col("ov") / F.col("nr")).otherwise(0.0)
    prec = F.when(F.col("nc") > 0, F.col("ov") / F.col("nc")).otherwise(0.0)
    f1 = F.when(rec + prec > 0, 2 * rec * prec / (rec + prec)).otherwise(0.0)
    return x.select(key, F.round(rec, digits).alias("recall"), F.round(prec, digits).alias("precision"),
                    F.round(f1, digits).alias("f1"))


def bleu_corpus(pairs: DataFrame, key: str, cand_col: str, ref_col: str, max_n: int = 4,
                digits: int = 6) -> DataFrame:
    """Corpus BLEU: clipped n-gram precisions (1..max_n) summed over all pairs,
    geometric mean, brevity penalty exp(1 - r/c) when c < r. One row."""
    t = pairs.select(key, tokens(cand_col).alias("ct"), tokens(ref_col).alias("rt"))
    rows = [t.select(F.lit(0).alias("n"), F.size("ct").cast("long").alias("m"),
                     F.size("rt").cast("long").alias("t"))]
    for n in range(1, max_n + 1):
        c = ngram_counts(t, key, "ct", n, "c")
        r = ngram_counts(t, key, "rt", n, "r")
        rows.append(c.join(r, [key, "gram"], "left").select(
            F.lit(n).alias("n"), F.least("c", F.coalesce("r", F.lit(0))).cast("long").alias("m"),
            F.col("c").cast("long").alias("t")))
    u = rows[0]
    for x in rows[1:]:
        u = u.unionByName(x)
    # One global aggregate over the union: partial sums per partition, one row out.
    s = u.agg(*[F.sum(F.when(F.col("n") == n, F.col("m"))).alias(f"m{n}") for n in range(max_n + 1)],
              *[F.sum(F.when(F.col("n") == n, F.col("t"))).alias(f"t{n}") for n in range(max_n + 1)])
    s = s.withColumnRenamed("m0", "c_len").withColumnRenamed("t0", "r_len")
    logp = sum(F.log(F.col(f"m{n}") / F.col(f"t{n}")) for n in range(1, max_n + 1)) / max_n
    bp = F.when(F.col("c_len") < F.col("r_len"), F.exp(1 - F.col("r_len") / F.col("c_len"))).otherwise(1.0)
    ok = F.lit(True)
    for n in range(1, max_n + 1):
        ok = ok & (F.coalesce(F.col(f"m{n}"), F.lit(0)) > 0)
    bleu = F.when(ok, bp * F.exp(logp)).otherwise(0.0)
    return s.select(F.round(bleu, digits).alias("bleu"), F.round(bp, digits).alias("brevity_penalty"),
                    F.col("c_len").cast("long"), F.col("r_len").cast("long"))


def _lcs_len(a, b) -> int:
    """Length of the longest common subsequence, a bit per token of ``a``: a token of
    ``b`` costs a few operations on one integer of len(a) bits."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full  # a zero bit ends one more common token
    for y in b:
        match = open_ & places.get(y, 0)
        open_ = ((open_ + match) | (open_ - match)) & full
    return len(a) - open_.bit_count()


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common token subsequence, per row (whole lists)."""
    return pd.Series([_lcs_len(list(x) if x is not None else [], list(y) if y is not None else [])
                      for x, y in zip(a, b)], dtype="int64")


def rouge_l(pairs: DataFrame, key: str, cand_col: str, ref_col: str, digits: int = 6) -> DataFrame:
    """E1 ROUGE-L: LCS-based recall, precision, F1 per pair."""
    t = pairs.select(key, tokens(cand_col).alias("ct"), tokens(ref_col).alias("rt"))
    t = t.withColumn("lcs", lcs_length("ct", "rt"))
    rec = F.when(F.size("rt") > 0, F.col("lcs") / F.size("rt")).otherwise(0.0)
    prec = F.when(F.size("ct") > 0, F.col("lcs") / F.size("ct")).otherwise(0.0)
    f1 = F.when(rec + prec > 0, 2 * rec * prec / (rec + prec)).otherwise(0.0)
    return t.select(key, "lcs", F.round(rec, digits).alias("recall"), F.round(prec, digits).alias("precision"),
                    F.round(f1, digits).alias("f1"))


def judge_aggregate(scores: DataFrame, group_col: str, json_col: str, metrics: list[str],
                    digits: int = 6) -> DataFrame:
    """Parse judge score JSON, then avg / sample stddev / count per group."""
    schema = T.StructType([T.StructField(m, T.DoubleType()) for m in metrics])
    p = scores.select(group_col, F.from_json(json_col, schema).alias("s"))
    aggs = []
    for m in metrics:
        aggs += [F.round(F.avg(f"s.{m}"), digits).alias(f"{m}_avg"),
                 F.round(F.stddev_samp(f"s.{m}"), digits).alias(f"{m}_std"),
                 F.count(f"s.{m}").alias(f"{m}_n")]
    return p.groupBy(group_col).agg(*aggs)


def overlap_at_k(a: DataFrame, b: DataFrame, qid: str, id_col: str, k: int) -> DataFrame:
    """Per query |A ∩ B| / k of two top-k lists."""
    both = a.select(qid, id_col).join(b.select(qid, id_col), [qid, id_col])
    qs = a.select(qid).unionByName(b.select(qid)).distinct()
    cnt = both.groupBy(qid).agg(F.count(F.lit(1)).alias("n_common"))
    return qs.join(cnt, qid, "left").select(qid, F.coalesce("n_common", F.lit(0)).cast("long").alias("n_common"),
                                            F.round(F.coalesce("n_common", F.lit(0)) / k, 6).alias("overlap"))


def hit_metrics(ranked: DataFrame, qid: str, hit_col: str, rank_col: str = "rank") -> DataFrame:
    """Per query hit (any relevant in the list) and reciprocal rank of the first hit."""
    return ranked.groupBy(qid).agg(
        F.max(F.col(hit_col).cast("int")).alias("hit"),
        F.round(F.coalesce(F.max(F.when(F.col(hit_col), 1.0 / F.col(rank_col))), F.lit(0.0)), 6).alias("rr"))
