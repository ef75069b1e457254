"""Quality rules as a bitmask ledger.

`ledger` measures every whole text once and stores the measurements with one bit for each
rule that fails. Policies are versioned sets of rules: `apply_policy` compares the bits with the
policy's mask, `ablations` counts, by bit operations over the ledger, what each rule alone removes.
Neither looks at the texts again. Only DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

#: A word; the complement of ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Low bits of a sort key that hold the position of a word window.
POSITION_BITS = 24

#: name -> SQL over the measurements, true where the rule fails. The order gives the bits; append only.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 5 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", BASE.rules + ("symbols", "duplicate_lines")), Policy("v2", tuple(RULES)))}


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows that start at the sorted positions `starts`."""
    first = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("words"))
    add = lambda a, p: F.struct((p + 3).alias("end"), (a["words"] + p + 3 - F.greatest(p, a["end"])).alias("words"))
    return F.aggregate(starts, first, add, lambda a: a["words"])


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every whole text.

    Null and blank texts measure 0 throughout. Rows with equal ids are measured one by one; other columns are not looked at.

    Repeated windows are found by sorting 64-bit keys, a window's hash above its position. Neighbours of
    equal hash are compared word by word; a text where they differ, or with more words than
    POSITION_BITS hold, takes the exact path over the windows themselves.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    n, words = F.size("words"), F.col("words")
    low = (1 << POSITION_BITS) - 1
    at = lambda i: (F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    starts = F.when(n > 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    keys = base.select(
        "doc_id", "words", "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(starts, lambda i: F.xxhash64(*at(i)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))).alias("keys"),
    )
    top = lambda x: F.shiftright(x, POSITION_BITS)
    twice = keys.withColumn("twice", F.filter("keys", lambda x, i: _same(top(x), top(F.get("keys", i - 1))) | _same(top(x), top(F.get("keys", i + 1)))))
    position = lambda x: x.bitwiseAND(F.lit(low)).cast("int")

    def differs(x: Column, i: Column) -> Column:
        before = F.get("twice", i - 1)
        return _same(top(x), top(before)) & ~(F.struct(*at(position(x))) == F.struct(*at(position(before))))

    clash = F.exists(F.transform("twice", differs), lambda x: x) | (n > low)
    fast = _covered(F.sort_array(F.transform("twice", lambda x: x.bitwiseAND(F.lit(low)))))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("w"), i.cast("long").alias("i"))))
    again = F.transform(F.array(windows), lambda s: F.filter(s, lambda x, i: _same(x["w"], F.get(s, i - 1)["w"]) | _same(x["w"], F.get(s, i + 1)["w"])))[0]
    exact = _covered(F.sort_array(F.transform(again, lambda x: x["i"])))
    repeated = F.when(F.size("twice") == 0, F.lit(0).cast("long")).when(clash, exact).otherwise(fast)
    return twice.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeated.alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """`measured` with `failed`, the bits of the rules that fail."""
    failed = F.lit(0).cast("long")
    for name, fails in RULES.items():
        failed = failed.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failed", failed)


def apply_policy(book: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    """The ledger with a boolean column: no rule of the policy fails."""
    return book.withColumn(name, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of the policy: version, rule, n_fail, n_only (removed by this rule alone), n_kept_without; counts of documents."""
    bits = F.col("failed").bitwiseAND(F.lit(policy.mask))
    counts = book.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]
    each = counts.select("bits", "n", F.explode(F.array(*rules)).alias("r")).select("bits", "n", "r.*")
    has, other = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("bit")) != 0
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(some(has).alias("n_fail"), some(has & ~other).alias("n_only"), some(~other).alias("n_kept_without")).withColumn("version", F.lit(policy.version))


def only_rule(policy: Policy) -> Column:
    """Of a document's failures under the policy the bit, where there is one alone, else 0: without that rule the policy keeps it."""
    bits = F.col("failed").bitwiseAND(F.lit(policy.mask))
    return F.when(F.bit_count(bits) == 1, bits).otherwise(F.lit(0).cast("long"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored; the policies' verdicts and the ablation of each document are bit operations on what was stored."""
    book = written(ledger(table(spark, sf_dir, "documents")))
    book = apply_policy(apply_policy(book, BASE, "base_ok"), POLICIES["v2"]).withColumn("only_rule", only_rule(POLICIES["v2"]))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_ok")).alias("base_failed"), "kept", "n_lines", "failed", "only_rule")


_FAILED = " + ".join(f"case when {fails} then {BIT[name]} else 0 end" for name, fails in RULES.items())
SQL = rf"""
with split as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (select doc_id, i, words[i:i+2] as w from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from split)),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, w) > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by doc_id),
lines as (select doc_id, count(*) as n, count(distinct line) as d from (select doc_id, unnest(string_split(text, chr(10))) as line from split) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (
  select s.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(l.n, 0)::bigint as n_lines, coalesce(l.n - l.d, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from split s left join covered c using (doc_id) left join lines l using (doc_id)),
f as (select *, ({_FAILED})::bigint as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {BASE.mask} <> 0 as base_failed, failed & {POLICIES["v2"].mask} = 0 as kept, n_lines, failed,
  (case when bit_count(failed & {POLICIES["v2"].mask}) = 1 then failed & {POLICIES["v2"].mask} else 0 end)::bigint as only_rule from f
"""
