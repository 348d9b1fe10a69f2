"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Boolean column that is true where a document is rejected. Its cost (seconds per row)
and its selectivity (share rejected) are measured on a sample, and the rules then run in the order of
rejection per cost: ``CASE`` evaluates a rule only where all rules before it have passed. The order
changes the work, never the verdict.

Defined results: a null or blank text has no words and is rejected by the word-count rule. Other
columns, whatever their names, pass through untouched; one named like the result is overwritten.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SAMPLE_ROWS = 1_000


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def only(text: Column, kind: str) -> Column:
    """Number of the text's characters that are in a character class."""
    t = F.coalesce(text, F.lit(""))
    return F.char_length(F.regexp_replace(t, f"[^{kind}]+", "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return only(text, "#*$%&|<>")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


POSITION_BITS = 20


def window_hashes(w: Column) -> Column:
    """One 64-bit hash for each window of three words."""
    joined = F.transform(
        F.array(F.transform(w, lambda x: F.xxhash64(x))),
        lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))),
    )
    return F.get(joined, 0)


def covered(h: Column) -> Column:
    """Words inside windows whose hash is there twice or more.

    Hashes are sorted together with their positions, so equal windows are neighbours; each repeated
    window then adds the words up to the next repeated one, three at most. Position and hash share one
    long (neighbours are compared by the whole hash); longer texts than that allows sort pairs.
    """
    low = F.lit((1 << POSITION_BITS) - 1)

    def place(x: Column) -> Column:
        return x.bitwiseAND(low).cast("int")

    def same(s: Column, x: Column, k: Column) -> Column:
        y = F.get(s, k)
        near = F.shiftright(x.bitwiseXOR(y), POSITION_BITS) == 0
        return F.coalesce(near & (F.get(h, place(x)) == F.get(h, place(y))), F.lit(False))

    def starts(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)), place))

    def equal(s: Column, x: Column, k: Column) -> Column:
        return F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))

    def starts_long(s: Column) -> Column:
        hit = F.filter(s, lambda x, k: equal(s, x, k - 1) | equal(s, x, k + 1))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def total(p: Column) -> Column:
        gains = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gains, F.lit(0).cast("bigint"), lambda a, x: a + x)

    packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint"))))
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # a one-element array binds each step's result, so that it is made once and not per element
    once = F.when(F.size(h) < (1 << POSITION_BITS), F.transform(F.array(packed), starts)).otherwise(F.transform(F.array(pairs), starts_long))
    return F.get(F.transform(once, total), 0)


def n_repeat_words(w: Column) -> Column:
    """Words in three-word windows that are found twice or more in the text, the first included."""
    per = F.transform(
        F.array(window_hashes(w)),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)),
    )
    return F.get(per, 0)


def rules(text: Column, w: Column, known: Mapping[str, Column] | None = None, min_words: int = 50) -> dict[str, Column]:
    """Rejection rules in no particular order. ``known`` may name columns that hold counts already."""
    known = known or {}
    n = F.size(w)
    chars = F.greatest(known.get("word_chars", F.char_length(F.array_join(w, ""))), F.lit(1))
    return {
        "few_words": n < min_words,
        "repetition": 100 * known.get("n_repeat_words", n_repeat_words(w)) > 50 * n,
        "symbols": 10 * known.get("n_symbols", n_symbols(text)) > n,
        "bars": F.coalesce(F.regexp_count(text, F.lit(r" \| ")), F.lit(0)) * 10 > n,
        "shouting": only(text, r"\p{Lu}") * 10 > chars * 4,
        "punctuation": only(text, r"\p{Punct}") * 10 > chars * 4,
        "word_length": (chars > 15 * n) | (chars < 2 * n),
        "exclamations": only(text, "!?") * 10 > n * 3,
        "duplicate_lines": known.get("n_dup_lines", n_dup_lines(text)) * 10 > F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)) * 5,
    }


def measure(sample: DataFrame, rejects: Mapping[str, Column]) -> dict[str, tuple[float, float]]:
    """(seconds, share rejected) of each rule over a stored sample; reading alone is taken off."""

    def seconds(flag: Column) -> tuple[float, float]:
        t = time.perf_counter()
        row = sample.agg(F.avg(F.coalesce(flag, F.lit(False)).cast("double")).alias("share")).first()
        return time.perf_counter() - t, row["share"] or 0.0

    seconds(F.size("_w") < 0)  # start-up
    base, _ = seconds(F.size("_w") < 0)
    out = {}
    for name, flag in rejects.items():
        t, share = seconds(flag)
        out[name] = (max(t - base, 1e-3), share)
    return out


def order_of(seen: Mapping[str, tuple[float, float]]) -> list[str]:
    """Most rejection per second first; ties by name."""
    return sorted(seen, key=lambda k: (-seen[k][1] / seen[k][0], k))


def cascade_order(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text", min_words: int = 50) -> list[str]:
    """Order of the rules, measured on about ``sample_rows`` documents drawn over the whole input."""
    from altigrid.model import cut

    n = docs.select(text).count()
    part = docs.select(F.col(text).alias("_t")).sample(min(1.0, sample_rows / max(n, 1)), seed=7)
    held = cut(part.coalesce(8)).withColumn("_w", words(F.col("_t")))
    return order_of(measure(held, rules(F.col("_t"), F.col("_w"), min_words=min_words)))


def verdict(rejects: Mapping[str, Column], order: list[str]) -> Column:
    """The name of the rule that rejects the document, null if all pass; later rules stay unevaluated."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(F.coalesce(rejects[name], F.lit(False)), F.lit(name)).otherwise(out)
    return out


def judge(docs: DataFrame, order: list[str] | None = None, text: str = "text", out: str = "rejected_by", min_words: int = 50) -> DataFrame:
    """Adds the rejecting rule. One pass, no shuffle."""
    order = order or cascade_order(docs, text=text, min_words=min_words)
    # a one-element array binds the words: however the planner moves the verdict, a text is split once
    bound = F.transform(F.array(words(F.col(text))), lambda w: verdict(rules(F.col(text), w, min_words=min_words), order))
    return docs.withColumn(out, F.get(bound, 0))


def profile(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The measured counts of every document, with the base verdict and that of the whole cascade."""
    order = order or cascade_order(docs)
    t, w = F.col("text"), F.col("_w")
    counts = {
        "word_chars": F.char_length(F.array_join(w, "")).cast("bigint"), "n_symbols": n_symbols(t),
        "n_dup_lines": n_dup_lines(t), "n_repeat_words": n_repeat_words(w),
    }
    base = docs.select("doc_id", "text").withColumn("_w", words(t)).select("*", *[c.alias(k) for k, c in counts.items()])
    rejects = rules(t, w, {k: F.col(k) for k in counts})
    failed = rejects["few_words"] | rejects["repetition"]
    return base.select(
        "doc_id", F.size(w).cast("bigint").alias("n_words"), *counts, failed.alias("base_failed"),
        (~failed & verdict(rejects, order).isNull()).alias("kept"),
    )
