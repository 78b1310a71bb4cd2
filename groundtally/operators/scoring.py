"""Scoring aggregates: task scores, clustered intervals, tests, leakage splits, text overlap metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundtally.functions import fixed_values as V
from groundtally.session import cut_lineage


def ratio(a: Column, b: Column) -> Column:
    """a/b with 0/0 -> 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def score_tasks(scored: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("task",)
    g = scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(~F.col("abstained")).alias("n_attempted"), F.count_if("correct").alias("n_correct"),
        F.count_if("abstained").alias("n_abstained"))
    return g.withColumns({"strict_accuracy": ratio(F.col("n_correct"), F.col("n")), "attempted_accuracy": ratio(F.col("n_correct"), F.col("n_attempted")),
                          "abstain_rate": ratio(F.col("n_abstained"), F.col("n"))})


def top_reasons(scored: DataFrame, keep: int = 8) -> DataFrame:
    n = scored.filter("abstained").groupBy("task", "reason").agg(F.count("*").alias("n"))
    w = Window.partitionBy("task").orderBy(F.desc("n"), "reason")
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def spread_rank(df: DataFrame, keys: list[str], item: str, digits: int = 2) -> DataFrame:
    """0-based rank of `item` within keys, ordered by (md5 prefix, item), without one task per key.

    Rows are ranked inside md5-prefix buckets; bucket offsets come from 16^digits counts per key.
    """
    d = df.withColumn("_b", F.substring(F.md5(F.col(item).cast("string")), 1, digits))
    inner = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(item)))
    size = d.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = size.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(before.drop("_n"), [*keys, "_b"]).withColumn("rank", F.col("_before") + F.col("_r") - 1).drop("_b", "_r", "_before")


#: 16-bit thresholds of a Poisson draw with mean 1: a draw of u counts as many resamplings as thresholds it reaches.
POISSON_16 = (24109, 48219, 60273, 64291, 65296, 65497, 65531, 65535)
DRAWS_A_DIGEST = 8


def bootstrap_ci(scored: DataFrame, resamples: int = 1000, seed: int = 1337, level: float = 0.95) -> DataFrame:
    """Percentile interval of strict accuracy, resampling whole patches.

    How often replicate b draws a patch is a Poisson count read off 16 bits of md5(seed:b div 8:patch), so it is known where the patch's
    row lies and any other engine finds the same. Weighted sums of all replicates are made before anything moves: what is shuffled is tasks x replicates,
    however many patches there are. A replicate that draws no patch at all has no accuracy and is left out.
    """
    per = scored.groupBy("task", "patch_id").agg(F.count("*").alias("total"), F.count_if("correct").alias("hits"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // DRAWS_A_DIGEST) - 1))).alias("block")
    key = F.concat_ws(":", F.lit(str(seed)), F.col("block").cast("string"), F.col("patch_id").cast("string"))
    drawn = per.select("task", "patch_id", "total", "hits", blocks).withColumn("bits", F.md5(key))
    width = 32 // DRAWS_A_DIGEST

    def times(k: int) -> Column:
        u = F.conv(F.substring("bits", 1 + width * k, width), 16, 10).cast("int")
        return sum(((u >= t).cast("int") for t in POISSON_16[1:]), (u >= POISSON_16[0]).cast("int"))

    counted = drawn.select("task", "block", "total", "hits", *[times(k).alias(f"w{k}") for k in range(DRAWS_A_DIGEST)])
    sums = counted.groupBy("task", "block").agg(*[F.sum(F.col(c) * F.col(f"w{k}")).alias(f"{c}{k}") for k in range(DRAWS_A_DIGEST) for c in ("hits", "total")])
    each = F.explode(F.array(*[F.struct((F.col("block") * DRAWS_A_DIGEST + k).alias("b"), F.col(f"hits{k}").alias("hits"), F.col(f"total{k}").alias("total"))
                               for k in range(DRAWS_A_DIGEST)])).alias("r")
    acc = sums.select("task", each).filter((F.col("r.b") < resamples) & (F.col("r.total") > 0)).select("task", (F.col("r.hits") / F.col("r.total")).alias("acc"))
    whole = Window.partitionBy("task")  # `resamples` rows per task
    pos = acc.withColumn("k", F.row_number().over(whole.orderBy("acc")) - 1).withColumn("m", F.count("*").over(whole))
    lo = F.floor(F.lit((1 - level) / 2) * F.col("m") + 1e-9)
    hi = F.least(F.floor(F.lit((1 + level) / 2) * F.col("m") + 1e-9), F.col("m") - 1)
    return pos.groupBy("task").agg(F.max(F.when(F.col("k") == lo, F.col("acc"))).alias("ci_low"), F.max(F.when(F.col("k") == hi, F.col("acc"))).alias("ci_high"))


def macro_gap(per_task: DataFrame) -> DataFrame:
    """(task, oracle_strict, oracle_attempted, blind, majority) -> macro means and gap over the better baseline."""
    return per_task.agg(
        F.avg("oracle_strict").alias("oracle_strict"), F.avg("oracle_attempted").alias("oracle_attempted"),
        F.avg(F.greatest("blind", "majority")).alias("best_blind")).withColumn("gap", F.col("oracle_strict") - F.col("best_blind"))


def per_group_accuracy(hits: DataFrame, group: str, *keys: str) -> DataFrame:
    """Mean of per-group accuracies beside the pooled rate: two levels of partial sums."""
    per = hits.groupBy(*keys, group).agg(F.count_if("hit").alias("h"), F.count("*").alias("m"))
    agg = [F.avg(F.col("h") / F.col("m")).alias("per_group_acc"), (F.sum("h") / F.sum("m")).alias("pooled_acc"),
           F.sum("m").alias("n"), F.count("*").alias("n_groups")]
    return per.groupBy(*keys).agg(*agg) if keys else per.agg(*agg)


def _log_gamma(x: Column) -> Column:
    """Stirling series, shifted by eight so that small arguments keep twelve digits."""
    z = x + 8.0
    head = sum((F.log(x + float(i)) for i in range(1, 8)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - head


def mcnemar(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, x_right, y_right) -> discordant counts and the exact binomial p.

    The binomial tail is summed downwards from its largest term over the last 40*sqrt(n)+60 terms;
    all earlier ones are below double precision.
    """
    agg = [F.count_if(F.col("x_right") & ~F.col("y_right")).alias("b"), F.count_if(~F.col("x_right") & F.col("y_right")).alias("c")]
    d = pairs.groupBy(*keys).agg(*agg) if keys else pairs.agg(*agg)
    d = d.withColumns({"_n": (F.col("b") + F.col("c")).cast("double"), "_k": F.least("b", "c").cast("double")})
    n, k = F.col("_n"), F.col("_k")
    log_top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) - n * F.log(F.lit(2.0))
    terms = F.sequence(F.lit(0), F.least(k, F.floor(40 * F.sqrt(n)) + 60).cast("int"))
    tail = F.aggregate(
        terms, F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["log"] + F.when(k > i, F.log((k - i) / (n - k + i + 1))).otherwise(F.lit(0.0))).alias("log"),
                              (s["sum"] + F.exp(s["log"])).alias("sum")))
    p = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(log_top) * tail["sum"]))
    return d.withColumn("p_value", p).drop("_n", "_k")


def coverage_precision(parsed: DataFrame) -> DataFrame:
    """(type, category, parsed, right) -> coverage, precision and end-to-end per task, pooled, and as the mean over tasks."""
    g = parsed.rollup(F.struct("type", "category").alias("t")).agg(
        F.count("*").alias("n"), F.count_if("parsed").alias("n_parsed"), F.count_if("right").alias("n_right"))
    told = g.select(F.coalesce("t.type", F.lit("POOLED")).alias("type"), F.coalesce("t.category", F.lit("POOLED")).alias("category"), "n", "n_parsed", "n_right",
                    ratio(F.col("n_parsed"), F.col("n")).alias("coverage"), ratio(F.col("n_right"), F.col("n_parsed")).alias("precision"),
                    ratio(F.col("n_right"), F.col("n")).alias("end_to_end"))
    counts, rates = ("n", "n_parsed", "n_right"), ("coverage", "precision", "end_to_end")
    macro = told.filter("type <> 'POOLED'").agg(*[F.sum(c).alias(c) for c in counts], *[F.round(F.avg(c), 9).alias(c) for c in rates])
    return told.unionByName(macro.filter("n is not null").select(F.lit("MACRO").alias("type"), F.lit("MACRO").alias("category"), *counts, *rates))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.filter(F.col(truth) != F.col(predicted)).groupBy(truth, predicted).agg(F.count("*").alias("n"))


def label_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn and F1 of every label seen on either side."""
    per = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    t = per.groupBy(F.col(truth).alias("label")).agg(
        F.sum(F.when(F.col(truth).eqNullSafe(F.col(predicted)), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("_t"))
    q = per.filter(F.col(predicted).isNotNull()).groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("_p"))
    j = t.join(q, "label", "full").select("label", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("_t", F.lit(0)).alias("_t"), F.coalesce("_p", F.lit(0)).alias("_p"))
    j = j.select("label", "tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_t") - F.col("tp")).alias("fn"))
    return j.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def leakage_split(test: DataFrame, train: DataFrame, text: str = "text") -> DataFrame:
    """Accuracy on texts seen verbatim in train beside texts never seen."""
    keyed = test.withColumn("_h", F.sha2(text, 256))
    seen = train.select(F.sha2(text, 256).alias("_h")).distinct().withColumn("seen", F.lit(True))
    return keyed.join(seen, "_h", "left").groupBy(F.coalesce("seen", F.lit(False)).alias("seen_in_train")).agg(
        F.count("*").alias("n"), F.count_if("correct").alias("n_correct")).withColumn("accuracy", ratio(F.col("n_correct"), F.col("n")))


def reason_examples(df: DataFrame, keep: int = 3, width: int = 160) -> DataFrame:
    w = Window.partitionBy("reason").orderBy("id")
    return df.filter("reason is not null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).select(
        "reason", "rank", "id", F.substring("input", 1, width).alias("example"))


def needed_field(reason: Column) -> Column:
    """struct<field, fixable>: which specification field an abstention reason was missing."""
    out = None
    for pattern, field in V.ABSTENTION_NEEDS:
        row = F.struct(F.lit(field).cast("string").alias("field"), F.lit(field is not None).alias("fixable"))
        out = F.when(reason.rlike(pattern), row) if out is None else out.when(reason.rlike(pattern), row)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("field"), F.lit(False).alias("fixable")))


def abstention_gap(scored: DataFrame, specs: DataFrame) -> DataFrame:
    """Per task and reason: abstentions, and how many the free reading could have supplied a field for."""
    s = specs.select("id", "class_a", "class_b", "stated_value", "comparator", "options", F.col("reason").alias("_declined"))
    need = scored.filter("abstained").withColumn("need", needed_field(F.col("reason"))).join(s, "id", "left")
    f = F.col("need.field")
    has = (F.when(f == "class_a", F.col("class_a").isNotNull()).when(f == "class_b", F.col("class_b").isNotNull())
           .when(f == "stated_value", F.col("stated_value").isNotNull()).when(f == "comparator", F.col("comparator").isNotNull())
           .when(f == "options", F.size("options") > 0).otherwise(F.lit(False)))
    supplied = F.coalesce(F.col("_declined").isNull() & F.col("need.fixable") & has, F.lit(False))
    return need.groupBy("task", "reason").agg(
        F.count("*").alias("abstained"), F.count_if(supplied).alias("supplied"), F.count_if(~F.col("need.fixable")).alias("unfixable")).withColumn(
        "fix_rate", ratio(F.col("supplied"), F.col("abstained")))


# ------------------------------------------------------------------------------ text overlap
def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def ngram_list(t: Column, n: int) -> Column:
    """Space-joined n-grams of a token array."""
    if n == 1:
        return t
    idx = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.array_join(F.slice(t, i, n), " "))


def common_count(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two string arrays: both sorted together, then counted along the runs of equals."""
    side = lambda values, own: F.transform(values, lambda g: F.struct(g.alias("g"), F.lit(own).alias("own")))
    start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        same, own = x["g"].eqNullSafe(acc["g"]), x["own"]
        return F.struct(x["g"].alias("g"), (F.when(same, acc["a"]).otherwise(0) + F.when(own, 1).otherwise(0)).alias("a"),
                        (F.when(same, acc["b"]).otherwise(0) + F.when(own, 0).otherwise(1)).alias("b"),
                        (acc["hits"] + F.when(same, 0).otherwise(F.least(acc["a"], acc["b"]))).alias("hits"))

    return F.aggregate(F.sort_array(F.concat(side(a, True), side(b, False))), start, step, lambda acc: acc["hits"] + F.least(acc["a"], acc["b"]))


def corpus_bleu(pairs: DataFrame, max_n: int = 4) -> DataFrame:
    """(id, hyp, ref) -> one row: clipped n-gram precisions, brevity penalty and BLEU-4 (0-100).

    N-grams are counted and clipped inside the row; sums alone are shuffled.
    """
    t = pairs.select(tokens(F.col("hyp")).alias("h"), tokens(F.col("ref")).alias("r"))
    sums = [F.sum(F.size("h").cast("long")).alias("hyp_len"), F.sum(F.size("r").cast("long")).alias("ref_len")]
    for n in range(1, max_n + 1):
        t = t.withColumn(f"num{n}", common_count(ngram_list(F.col("h"), n), ngram_list(F.col("r"), n)))
        sums += [F.sum(F.col(f"num{n}").cast("long")).alias(f"num{n}"), F.sum(F.greatest(F.size("h") - (n - 1), F.lit(0)).cast("long")).alias(f"den{n}")]
    row = t.agg(*sums).select("hyp_len", "ref_len", *[F.coalesce(F.try_divide(f"num{n}", f"den{n}"), F.lit(0.0)).alias(f"p{n}") for n in range(1, max_n + 1)])
    ps = [F.col(f"p{n}") for n in range(1, max_n + 1)]
    geo = F.when(F.least(*ps) <= 0, F.lit(0.0)).otherwise(F.exp(sum((F.log(p) for p in ps[1:]), F.log(ps[0])) / max_n))
    bp = F.when(F.col("hyp_len") > F.col("ref_len"), F.lit(1.0)).when(F.col("hyp_len") == 0, F.lit(0.0)).otherwise(
        F.exp(1 - F.col("ref_len") / F.col("hyp_len")))
    return row.withColumns({"brevity_penalty": bp, "bleu4": 100 * bp * geo})


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays, 64 or more cells per word operation."""
    def one(x, y):
        at: dict[str, int] = {}
        for i, tok in enumerate(x):
            at[tok] = at.get(tok, 0) | (1 << i)
        full = (1 << len(x)) - 1
        v = full
        for tok in y:
            m = at.get(tok, 0)
            u = v & m
            v = ((v + u) | (v - u)) & full
        return len(x) - bin(v).count("1")
    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def rouge_l(pairs: DataFrame, *keys: str) -> DataFrame:
    """Mean ROUGE-L F1 (0-100); a pair with an empty side scores zero."""
    t = pairs.select(*keys, tokens(F.col("hyp")).alias("h"), tokens(F.col("ref")).alias("r")).withColumn("lcs", lcs_length("h", "r"))
    p, r = F.col("lcs") / F.size("h"), F.col("lcs") / F.size("r")
    f1 = F.when((F.size("h") == 0) | (F.size("r") == 0) | (F.col("lcs") == 0), F.lit(0.0)).otherwise(2 * p * r / (p + r))
    t = t.withColumn("f1", f1)
    agg = [F.count("*").alias("n"), F.sum("lcs").alias("lcs_total"), F.round(100 * F.avg("f1"), 6).alias("rouge_l")]
    return t.groupBy(*keys).agg(*agg) if keys else t.agg(*agg)


def score_captions(captions: DataFrame, annotations: DataFrame, split: str = "validation") -> DataFrame:
    """One row: BLEU-4 with its parts, ROUGE-L and the verdict of made (patch_id, caption) against the split's released captions.

    Released captions of patches without a made one are left out, as are null ones; a patch with several meets each.
    Without any pair the scores are zero, and ROUGE-L is null.
    """
    released = annotations.filter((F.col("type") == "captioning") & (F.col("split") == split)).select("id", "patch_id", F.col("output").alias("ref")).dropna()
    pairs = cut_lineage(released.join(captions.select("patch_id", F.col("caption").alias("hyp")), "patch_id").select("id", "hyp", "ref"))
    rouge = rouge_l(pairs).select(F.lit(1).alias("one"), F.col("n").alias("n_captions"), "rouge_l")
    return corpus_bleu(pairs).withColumn("one", F.lit(1)).join(rouge, "one").drop("one").withColumn("verdict", bleu_verdict(F.col("bleu4")))


def bleu_verdict(bleu: Column) -> Column:
    return F.when(bleu >= 35, "templates suffice").when(bleu >= 10, "rewrite style").otherwise("drop symbolic captions")


def coverage_verdict(coverage: Column) -> Column:
    return F.when(coverage < 0.5, "below floor").otherwise("ok")


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(task, value) twice -> delta per task; a task on one side only keeps a null delta."""
    b, a = before.select("task", F.col("value").alias("before")), after.select("task", F.col("value").alias("after"))
    return b.join(a, "task", "full").select("task", "before", "after", (F.col("after") - F.col("before")).alias("delta"),
                                            (~F.col("after").eqNullSafe(F.col("before"))).alias("moved"))
