"""Quality rules: text statistics and a learned decision list, all in DataFrame expressions.

Sequential covering learns conjunctions of thresholds from labelled statistics: it grows a
rule for low quality on two thirds of the labelled rows left, prunes it on the other third,
keeps it while it is precise there, and takes the covered rows out. The ordered list becomes
one CASE expression that Spark evaluates beside the statistics.

Only the learning sees a sample: `SAMPLE` labelled rows at most, those with the smallest hash
of their id. Statistics and verdicts cover every row.

Defined results: null and empty texts have no word and all counts 0, so they fail the base
rule; a text with fewer than eight words has no window; no labels, no learned rules; labels
that disagree about an id count as low quality; null labels are ignored; rows that repeat are
rows of their own. A kept column with the name of a result column is called keep_ and that name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, bind, kept_names

#: Labelled rows that the rules are learned from, at most.
SAMPLE = 20_000
WINDOW = 8
#: Fixed character classes of the statistics.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"


def _taken_out(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more, by 64-bit hashes of windows."""

    def covered(windows: Column) -> Column:
        def starts(ordered: Column) -> Column:
            same = lambda e, i: (
                F.coalesce(F.get(ordered, i - 1)["w"] == e["w"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["w"] == e["w"], F.lit(False))
            )
            at = F.array_sort(F.transform(F.filter(ordered, same), lambda e: e["i"]))
            zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(at, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])

        ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), bind(ordered, starts)).otherwise(0)

    def windows(hashes: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
        return bind(every, covered)

    return F.when(F.size(words) >= WINDOW, bind(F.transform(words, lambda w: F.xxhash64(w)), windows)).otherwise(0)


def statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and further statistics."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def from_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            _repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        )

    def from_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumn(f"{prefix}w", bind(words, from_words)).withColumn(f"{prefix}l", bind(lines, from_lines))
    return out.withColumns({
        f"{prefix}n_words": F.col(f"{prefix}w.n_words"), f"{prefix}word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        f"{prefix}n_symbols": _taken_out(t, SYMBOLS).cast("long"), f"{prefix}n_dup_lines": F.col(f"{prefix}l.n_dup_lines"),
        f"{prefix}n_repeat_words": F.col(f"{prefix}w.n_repeat_words"), f"{prefix}n_distinct": F.col(f"{prefix}w.n_distinct"), f"{prefix}n_lines": F.col(f"{prefix}l.n_lines"),
        f"{prefix}n_capitals": _taken_out(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"), f"{prefix}n_digits": _taken_out(t, "0123456789").cast("long"),
        f"{prefix}n_marks": _taken_out(t, "!?").cast("long"),
    }).drop(f"{prefix}w", f"{prefix}l")


def features(p: str = "") -> dict[str, Column]:
    """What rules can ask about; each a double in proportion to the text, so that length alone decides little."""
    c = lambda x: F.col(p + x).cast("double")
    chars, words = F.greatest(c("word_chars"), F.lit(1.0)), F.greatest(c("n_words"), F.lit(1.0))
    return {
        "mean_word": c("word_chars") / words, "symbols": c("n_symbols") / words, "dup_lines": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1.0)),
        "repeats": c("n_repeat_words") / words, "distinct": c("n_distinct") / words, "capitals": c("n_capitals") / chars,
        "digits": c("n_digits") / chars, "marks": c("n_marks") / words, "words": c("n_words"),
    }


def base_failed(p: str = "") -> Column:
    return (F.col(f"{p}n_words") < 20) | (100 * F.col(f"{p}n_repeat_words") > 30 * F.col(f"{p}n_words"))


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, names: list[str], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, op, cut in rule:
        v = x[:, names.index(name)]
        hit &= v <= cut if op == "<=" else v > cut
    return hit


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precise: float = 0.9, least: int = 3, most_rules: int = 12, most_tests: int = 4) -> list[Rule]:
    """Sequential covering: rules for the bad rows, in order. Deterministic; ties go to the earlier feature."""
    rules: list[Rule] = []
    part = np.arange(len(x)) % 3 == 2  # every third row prunes
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (left & bad).sum() >= least:
        grow, prune = left & ~part, left & part
        rule: Rule = []
        now = grow.copy()
        while len(rule) < most_tests and (now & ~bad).any():
            p0, n0 = (now & bad).sum(), now.sum()
            if not p0:
                break
            best = (1e-9, None)
            for f, name in enumerate(names):
                v = x[now, f]
                order = np.argsort(v, kind="stable")
                v, b = v[order], bad[now][order]
                ends = np.flatnonzero(v[1:] > v[:-1])
                if not len(ends):
                    continue
                pos = np.cumsum(b)[ends]
                for op, p, n in (("<=", pos, ends + 1), (">", p0 - pos, n0 - ends - 1)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (name, op, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
            if best[1] is None:
                break
            rule.append(best[1])
            now = grow & _covers(rule, names, x)

        def worth(r: Rule) -> float:
            hit = prune & _covers(r, names, x)
            return ((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = left & _covers(rule, names, x)
        held = prune & hit
        if not rule or (hit & bad).sum() < least or (hit & bad).sum() < precise * hit.sum() or (held & bad).sum() < precise * held.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rejected(rules: list[Rule], p: str = "") -> Column:
    """The number of the first rule that fires, else null: an ordered conditional expression."""
    f = features(p)
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        test = F.lit(True)
        for name, op, cut in rules[i]:
            test &= f[name] <= cut if op == "<=" else f[name] > cut
        out = F.when(test, i + 1).otherwise(out)
    return out


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Rules from the rows of docs that labels (doc_id, quality 0 or 1) names."""
    said = labels.select(F.col("doc_id").cast("long").alias("id_"), F.col("quality").alias("q_")).dropna().groupBy("id_").agg(F.min("q_").alias("q_"))
    said = F.broadcast(said.orderBy(F.xxhash64("id_"), "id_").limit(sample))  # `sample` rows at most
    seen = statistics(docs.select(F.col(doc_id).cast("long").alias("id_"), F.col(text).alias("text_")).join(said, "id_"), "text_")
    f = features()
    rows = seen.filter(~base_failed()).select("id_", "q_", *[c.alias(k) for k, c in f.items()]).dropDuplicates().orderBy(F.xxhash64("id_"), "id_", *f).limit(2 * sample).collect()
    rows.sort(key=lambda r: (r.id_ * 0x9E3779B97F4A7C15 % (1 << 64), tuple(r)))
    if not rows:
        return []
    names = list(f)
    return learn(np.array([[r[n] for n in names] for r in rows], float), np.array([r.q_ == 0 for r in rows]), names)


_RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def judge(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """One row for each row of docs: doc_id, statistics, base_failed, rule (that rejects, or null), kept; and `keep`."""
    one = docs.select(F.col(doc_id).cast("long").alias("q_id"), F.col(text).cast("string").alias("q_text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    s = statistics(one, "q_text")
    s = s.withColumn("base_failed", base_failed()).withColumn("rule", rejected(rules))
    return s.select(
        F.col("q_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule", *[F.col(f"keep_{c}").alias(name) for c, name in kept_names(keep, _RESULT)],
    )
