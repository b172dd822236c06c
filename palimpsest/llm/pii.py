"""Personal data: base patterns, and candidate spans judged by gradient-boosted trees.

Per kind a strict pattern with a check (parts up to 255, Luhn, digit counts) gives the base spans. A broad
pattern per kind proposes further, overlapping candidates; each gets features of its format and context. The trees
learn from disguised personal data: positives are base spans rewritten so that the base pattern does not fit them
(``name (at) host (dot) org``, numbers without plus, other separators) in their own context, negatives the candidates
that touch no base span; all of them, as equal examples are summed up to one row with a weight, and so many bins that
the trees' splits come from all rows as well. A threshold per kind is calibrated on all examples of the fifth of the ids
held back so that the wanted precision is met. Candidates above it that touch no base span are added. As true disguised
data count as negatives there, the precision is underrated rather than overrated. Everything per document is built-in
functions over arrays of its own row: no shuffle, and the trees are written into the plan as CASE expressions.

Defined cases: null text is empty and has no spans; spans are in code points, end exclusive; of the matches that
fail their check none is retried; repeated rows are judged alike; an empty table gives an empty result; if
the examples are of one class only, nothing is added to the base spans; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
#: Examples a node of a tree has at least.
NODE = 10
RUN = 64
#: Leftmost non-overlapping matches, written without backtracking over long runs: a match starts where a run of its
#: characters does, or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried at all.
TRIGGER = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
BROAD = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:[.,][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ .-]?[0-9]){11,20}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|\(|(?=[0-9]))[0-9][0-9() .-]{6,18}[0-9](?![0-9])",
}
BROAD_TRIGGER = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9][.,][0-9]++[.,][0-9]++[.,][0-9]", "card": r"[0-9](?:[ .-]?[0-9]){11}", "phone": r"[0-9][0-9() .-]{6}"}
_CUES = {"email": r"(?i)(mail|contact|write)", "ip": r"(?i)(ip|host|server|address)", "card": r"(?i)(card|visa|pay|account)", "phone": r"(?i)(tel|phone|call|fax|mobile)"}
#: How @ and . of an address are written so that readers understand and patterns don't.
DISGUISES = ((" (at) ", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "."), (" [at] ", " [dot] "))
FEATURES = ("kind", "length", "digits", "letters", "dots", "separators", "plus", "paren", "luhn", "parts_ok", "after_word", "before_word", "cue", "line_start")


def _spans(text: Column, pattern: str, trigger: str) -> Column:
    """array of (start, end, match, before, after) of the non-overlapping matches, with some context.

    Matches are placed one after the other, ``RUN`` of them into an array of their own, as appending to one array would copy
    it for each match.
    """
    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    parts = F.split(text, pattern, -1)
    both = F.zip_with(found, F.slice(parts, 2, F.size(parts)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    zero = F.struct(F.length(F.get(parts, 0)).alias("at"), F.substring(F.reverse(F.get(parts, 0)), 1, 24).alias("left"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["m"])
        span = F.struct(acc["at"].alias("start"), end.alias("end"), x["m"].alias("match"), F.reverse(acc["left"]).alias("before"), F.substring(x["p"], 1, 2).alias("after"))
        return F.struct((end + F.length(x["p"])).alias("at"), F.substring(F.reverse(x["p"]), 1, 24).alias("left"), F.concat(acc["out"], F.array(span)).cast(kind).alias("out"))

    zipped = F.filter(both, lambda x: x["m"].isNotNull())
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / RUN).cast("int")), lambda g: F.slice(zipped, g * RUN + 1, F.lit(RUN)))
    runs = F.when(F.size(zipped) > 0, runs).otherwise(F.array().cast("array<array<struct<m:string,p:string>>>"))

    def run(acc: Column, matches: Column) -> Column:
        placed = F.aggregate(matches, F.struct(acc["at"].alias("at"), acc["left"].alias("left"), F.array().cast(kind).alias("out")), step)
        return F.get(F.transform(F.array(placed), lambda r: F.struct(r["at"].alias("at"), r["left"].alias("left"), F.concat(acc["outs"], F.array(r["out"])).cast(f"array<{kind}>").alias("outs"))), 0)

    start = F.struct(zero["at"].alias("at"), zero["left"].alias("left"), F.array().cast(f"array<{kind}>").alias("outs"))
    spans = F.aggregate(runs, start, run, lambda acc: F.flatten(acc["outs"]))
    return F.when(text.rlike(trigger), spans).otherwise(F.array().cast(kind))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _passes(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _features(kind: int, s: Column) -> Column:
    m, digits = s["match"], _digits(s["match"])
    count = lambda p: F.length(F.regexp_replace(m, p, "")).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    values = [
        F.lit(float(kind)), F.length(m).cast("double"), F.length(digits).cast("double"), count("[^A-Za-z]"), count(r"[^.]"), count(r"[^ -]"), count(r"[^+]"), count(r"[^()]"),
        flag((F.length(digits) >= 12) & F.call_function("luhn_check", digits)), flag(F.forall(F.split(m, r"[.,]"), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))),
        flag(s["before"].rlike(r"[A-Za-z0-9]$")), flag(s["after"].rlike(r"^[A-Za-z0-9]")), flag(s["before"].rlike(_CUES[KINDS[kind]])), flag(s["before"].rlike(r"(^|\n)$")),
    ]
    return F.struct(*[v.alias(n) for v, n in zip(values, FEATURES, strict=True)])


def _base_of(n: int) -> Column:
    good = F.filter(f"base_{KINDS[n]}", lambda s: _passes(KINDS[n], s["match"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end")))


def _broad_of(n: int) -> Column:
    return F.transform(f"broad_{KINDS[n]}", lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"), _features(n, s).alias("f")))


def _disguised(n: int, match: Column) -> Column:
    """Another way to write the data, which the base pattern does not fit."""
    if KINDS[n] == "email":
        form, out = F.pmod(F.xxhash64(match), F.lit(len(DISGUISES))), match
        for k, (at, dot) in enumerate(DISGUISES):
            out = F.when(form == k, F.replace(F.replace(match, F.lit("@"), F.lit(at)), F.lit("."), F.lit(dot))).otherwise(out)
        return out
    if KINDS[n] == "ip":
        return F.replace(match, F.lit("."), F.lit(","))
    if KINDS[n] == "card":
        return F.regexp_replace(match, "[ -]", ".")
    return F.regexp_replace(match, r"^\+", "")


def _taught_of(n: int) -> Column:
    good = F.filter(f"base_{KINDS[n]}", lambda s: _passes(KINDS[n], s["match"]))
    return F.transform(good, lambda s: _features(n, F.struct(_disguised(n, s["match"]).alias("match"), s["before"].alias("before"), s["after"].alias("after"))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base: array of (start, kind, end), broad: array of (start, kind, end, f), taught: array of features, per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", *[_spans(F.col("text"), BASE[k], TRIGGER[k]).alias(f"base_{k}") for k in KINDS], *[_spans(F.col("text"), BROAD[k], BROAD_TRIGGER[k]).alias(f"broad_{k}") for k in KINDS])
    base = [_base_of(n) for n in range(len(KINDS))]
    broad = [_broad_of(n) for n in range(len(KINDS))]
    taught = [_taught_of(n) for n in range(len(KINDS))]
    return rows.select("id", F.array_sort(F.concat(*base)).alias("base"), F.concat(*broad).alias("broad"), F.concat(*taught).alias("taught"))


def _untouched(spans: Column, s: Column) -> Column:
    return ~F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def _tree(lines: list[str], at: int):
    """Nested (feature, split, low, high) or a leaf value from the printed form of a tree."""
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1]), at + 1
    feature, split = re.match(r"If \(feature (\d+) <= ([-0-9.Ee]+)\)", line).groups()
    low, at = _tree(lines, at + 1)
    high, at = _tree(lines, at + 1)
    return (int(feature), float(split), low, high), at


def trees_of(model) -> list[tuple]:
    """(weight, tree) of each tree of a fitted spark.ml model."""
    out = []
    for part in re.split(r"\n\s*Tree \d+ ", model.toDebugString)[1:]:
        head, *lines = part.split("\n")
        out.append((float(re.search(r"weight ([-0-9.Ee]+)", head).group(1)), _tree(lines, 0)[0]))
    return out


def score(trees: list[tuple], f: Column) -> Column:
    """The trees' probability that a candidate with features ``f`` is personal data."""

    def value(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        feature, split, low, high = tree
        return F.when(f[FEATURES[feature]] <= split, value(low)).otherwise(value(high))

    total = sum((F.lit(w) * value(t) for w, t in trees), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * total))


def weighted_examples(found: DataFrame) -> DataFrame:
    """Features, label, held and weight: how many examples of all rows have these."""
    open_ = F.transform(F.filter("broad", lambda s: _untouched(F.col("base"), s)), lambda s: F.struct(s["f"].alias("f"), F.lit(0.0).alias("label")))
    taught = F.transform("taught", lambda f: F.struct(f.alias("f"), F.lit(1.0).alias("label")))
    each = found.select("id", F.explode(F.concat(open_, taught)).alias("s"))
    each = each.select("s.f.*", "s.label", (F.pmod(F.xxhash64("id", F.lit(4)), F.lit(5)) == 0).alias("held"))
    return each.groupBy(*each.columns).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def least_scores(scored: DataFrame, precision: float) -> list[float]:
    """(kind, p, label, weight) -> per kind the least p from which on that share of the examples is good; 2 if none.

    A kind has as many different p as its examples have combinations of leaves.
    """
    by_p = scored.groupBy("kind", "p").agg(F.sum(F.col("weight") * F.col("label")).alias("good"), F.sum("weight").alias("n"))
    down = Window.partitionBy("kind").orderBy(F.desc("p"))
    above = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # sums of other leaves differ in their last digits
    last = F.coalesce(F.lead("p").over(down) < F.col("p") - 1e-9, F.lit(True))
    fits = by_p.select("kind", "p", (F.sum("good").over(above) / F.sum("n").over(above) >= precision).alias("fits"), last.alias("last"))
    least = {int(r.kind): r.p - 1e-9 for r in fits.where("fits and last").groupBy("kind").agg(F.min("p").alias("p")).collect()}
    return [least.get(n, 2.0) for n in range(len(KINDS))]


def fit(found: DataFrame, precision: float = PRECISION) -> tuple[list[tuple], list[float]] | None:
    """Trees and a threshold per kind from all examples, those of a fifth of the ids held back."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = materialize(weighted_examples(found))
    size = {(r.held, r.label): (r.rows, r.weight) for r in rows.groupBy("held", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("weight")).collect()}
    if not {(False, 0.0), (False, 1.0)} <= size.keys():
        return None
    n, weight = (sum(size[False, label][k] for label in (0.0, 1.0)) for k in range(2))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.where("not held"))
    # Spark looks for splits in at most bins^2 or 10,000 rows: in all of them here.
    bins = 32 if n <= 10_000 else math.isqrt(n) + 1
    model = GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.3, maxBins=bins, minInstancesPerNode=1, minWeightFractionPerNode=min(0.49, NODE / weight), weightCol="weight", seed=1).fit(data)
    trees = trees_of(model)
    return trees, least_scores(rows.where("held").select("kind", "label", "weight", score(trees, F.struct(*FEATURES)).alias("p")), precision)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans per row."""
    found = materialize(candidates(docs, id_col, text_col))
    fitted = fit(found)
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    spans = plain
    if fitted is not None:
        trees, thresholds = fitted
        wanted = F.filter("broad", lambda s: _untouched(F.col("base"), s) & (score(trees, s["f"]) >= F.get(F.array(*map(F.lit, thresholds)), s["kind"])))
        spans = F.array_sort(F.array_distinct(F.concat(plain, F.transform(wanted, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda n: F.size(F.filter("base", lambda b: b["kind"] == n)).cast("long")
    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(said(plain), 256).alias("base_sha256"), said(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))

