"""Quality rules as a ledger: every rule is evaluated once into a bit, policies and ablations read the bits."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtally.llm.common import map_rows

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_capitals", "n_chars")

#: Rules by name, in bit order: the condition under which a document fails. New rules are appended;
#: a bit keeps its meaning for ever, so that stored ledgers stay readable.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 10 * n_words",
    "word_length": "word_chars < 3 * n_words or word_chars > 15 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "shouting": "100 * n_exclaims > 20 * n_words",
    "capitals": "100 * n_capitals > 30 * n_chars",
}
BASE = ("few_words", "repeated_windows")


def mask_of(*names: str) -> int:
    return sum(1 << list(RULES).index(n) for n in names)


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules. A document is rejected when it fails any of them."""

    version: str
    mask: int


POLICIES = {p.version: p for p in (Policy("v1", mask_of(*BASE)), Policy("v2", mask_of(*BASE, "many_symbols", "repeated_lines")), Policy("v3", mask_of(*RULES)))}
CURRENT = POLICIES["v3"]


def _measure_one():
    blanks, symbols, capitals = "\x20\x09\x0a\x0b\x0c\x0d", "#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def one(text: str | None) -> tuple[int, ...]:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # of bytes: at 20 and 09-0D alone
        windows = list(zip(words, words[1:], words[2:]))
        repeated = 0
        if len(set(windows)) < len(windows):
            seen, end = Counter(windows), 0
            for i, window in enumerate(windows):
                if seen[window] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
        lines = [x for x in raw.split(b"\n") if x.strip()]
        return (len(words), len(text) - sum(map(text.count, blanks)), sum(map(text.count, symbols)), len(lines) - len(set(lines)),
                repeated, len(lines), text.count("!"), len(raw) - len(raw.translate(None, capitals)), len(text))

    return one


def _measure():
    one = _measure_one()

    def batch(rows: dict) -> dict:
        made = [one(t) for t in rows["text"]]
        return {"id": rows["id"], **{name: [m[i] for m in made] for i, name in enumerate(MEASURES)}}

    return batch


def _failures() -> Column:
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return mask


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measures, failures): every measurement and one bit per failed rule.

    One row per row of ``docs``, in the same partitions; nothing is shuffled. A null text has no
    words and fails ``few_words``. Repeated rows and null ids are judged like any others; an
    empty table gives an empty ledger; other columns are not read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    measured = map_rows(rows, "id long, " + ", ".join(f"{m} long" for m in MEASURES), _measure)
    return measured.withColumn("failures", _failures())


def passes(policy: Policy, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(policy.mask)) == 0


def keep_passing(docs: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass ``policy``, with their columns, measured where they lie."""
    one = _measure_one()

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=list(MEASURES))

    rows = docs.select(F.struct("*").alias("doc"), measured(docs[text_col]).alias("m")).select("doc", "m.*")
    return rows.withColumn("failures", _failures()).filter(passes(policy)).select("doc.*")


def ablations(entries: DataFrame, policies: dict[str, Policy] | None = None) -> DataFrame:
    """(version, rule, failed, rejected, rejected_without): how many documents a rule fails under a policy, how many
    the policy rejects, and how many it would reject without the rule.

    The ledger shrinks first to one count per distinct bit pattern, at most 2 to the number of rules.
    """
    policies = POLICIES if policies is None else policies
    patterns = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    tries = [F.struct(F.lit(p.version).alias("version"), F.lit(p.mask).alias("mask"), F.lit(rule).alias("rule"), F.lit(1 << k).alias("bit"))
             for p in policies.values() for k, rule in enumerate(RULES) if p.mask >> k & 1]
    hit = lambda c: F.col("failures").bitwiseAND(c) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0))
    return (patterns.select("failures", "n", F.inline(F.array(*tries))).groupBy("version", "rule")
            .agg(total(hit(F.col("bit"))).alias("failed"), total(hit(F.col("mask"))).alias("rejected"),
                 total(hit(F.col("mask").bitwiseAND(F.bitwise_not("bit")))).alias("rejected_without")))
