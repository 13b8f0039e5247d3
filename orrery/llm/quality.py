"""Quality rules: a ledger of failure bits and measurements, judged later by versioned policies.

Every rule is evaluated once. The ledger keeps what was measured and one bit for
each failed rule; a policy is a mask over these bits, so a new policy, or the
question what a rule costs, needs no second look at the texts. The whole path is
native column expressions: one scan, no shuffle.

Defined cases: a null or empty text has no words, fails ``too_short`` and measures
zero everywhere; repeated rows each get their row; rows are independent, so ties
and hot sources do not matter; other columns are ignored. An empty table gives an
empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import let, words

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]


RULES = (
    Rule(0, "too_short", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)
BASE = Policy("base", 1, ("too_short", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(r.name for r in RULES))


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    by = {r.name: r.bit for r in rules}
    return sum(1 << by[n] for n in policy.rules)


def repeat_words(w: Column) -> Column:
    """Words of array ``w`` inside an 8-word window that occurs twice or more in it."""
    n = F.size(w) - (WINDOW - 1)
    starts = F.sequence(F.lit(1), n)
    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    grams = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("g"), i.alias("i"))))

    def covered(s: Column) -> Column:
        twice = F.transform(s, lambda x, k: F.when((x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]), x["i"]))
        return let(F.array_sort(F.filter(twice, lambda i: i.isNotNull())), lambda q: F.aggregate(F.transform(q, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(q, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    # Equal windows have equal hashes: without a repeated hash there is nothing to compare.
    some = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(grams, covered)))
    return F.when(n < 2, F.lit(0)).otherwise(some)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with struct ``m`` of the measurements of its text column."""
    t = F.coalesce(F.col(text), F.lit(""))

    def of(w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                repeat_words(w).cast("long").alias("n_repeat_words"),
            ),
        )

    return docs.withColumn("m", let(words(F.col(text)), of))


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    return sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules), F.lit(0).cast("long"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the id, every measurement, and ``fail_bits``."""
    measured = measure(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "m.*")
    return measured.withColumn("fail_bits", failure_bits(rules))


def fails(policy: Policy, bits: Column | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    """Does a row of a ledger made with ``rules`` break the policy?"""
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(mask(policy, rules))) != 0


def ablation(rows: DataFrame, policies: tuple[Policy, ...] = (BASE, STANDARD), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule: documents failing it, and those that only it rejects.

    One aggregation over the stored bits; the sums combine before the shuffle.
    """
    sums, keys = [], []
    for p in policies:
        m = mask(p, rules)
        hit = F.col("fail_bits").bitwiseAND(F.lit(m))
        for r in rules:
            if m >> r.bit & 1:
                keys.append((p.name, p.version, r.name))
                k = len(keys) - 1
                sums += [F.count_if(hit.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"f{k}"), F.count_if(hit == (1 << r.bit)).alias(f"o{k}")]
    one = rows.agg(*sums)
    return one.select(F.inline(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(v).alias("version"), F.lit(n).alias("rule"), F.col(f"f{k}").alias("failed"), F.col(f"o{k}").alias("only_this_rule")) for k, (p, v, n) in enumerate(keys)])))


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", policy: Policy = STANDARD, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's ``kept``; ``rules`` must have those of ``BASE``."""
    base = fails(BASE, rules=rules)
    return ledger(docs, id_col, text, rules).withColumns({"base_failed": base, "kept": ~(base | fails(policy, rules=rules))})


def keep(docs: DataFrame, text: str = "text", policy: Policy = STANDARD, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass the policy, with their own columns."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(text).alias("text"))
    rows = measure(own).select("d", "m.*").withColumn("fail_bits", failure_bits(rules))
    return rows.where(~(fails(BASE, rules=rules) | fails(policy, rules=rules))).select("d.*")
