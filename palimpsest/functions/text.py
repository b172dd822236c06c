"""Text scalars as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARTICLES = ("a", "an", "the")
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def answer_tokens(text: Column) -> Column:
    """Lower-cased words without ASCII punctuation and articles; none for null."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(bare, r"\s+"), lambda t: ~t.isin("", *ARTICLES))


TOKENS_SQL = r"list_filter(string_split_regex(regexp_replace(lower(coalesce({0}, '')), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


def normalize_answer(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def exact_match(one: Column, two: Column) -> Column:
    return (normalize_answer(one) == normalize_answer(two)).cast("int")


def whitespace_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""))


def overlap(one: Column, two: Column) -> Column:
    """Size of the multiset intersection of two short token lists."""
    times = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_distinct(one), F.lit(0), lambda n, t: n + F.least(times(one, t), times(two, t)))


def f1(shared: Column, n_one: Column, n_two: Column) -> Column:
    """Harmonic mean of precision and recall; if either side is empty, whether both are."""
    empty = (n_one == 0) | (n_two == 0)
    return F.when(empty, (n_one == n_two).cast("double")).when(shared == 0, 0.0).otherwise(2.0 * shared / (n_one + n_two))


def token_f1(gold: Column, predicted: Column) -> Column:
    g, p = answer_tokens(gold), answer_tokens(predicted)
    return f1(overlap(g, p), F.size(g), F.size(p))


def best_f1(references: Column, predicted: Column) -> Column:
    """struct(score, reference): the first of the references with the highest token F1."""
    start = F.struct(F.lit(-1.0).alias("score"), F.lit(None).cast("string").alias("reference"))

    def step(best: Column, ref: Column) -> Column:
        score = token_f1(ref, predicted)
        return F.when(score > best["score"], F.struct(score.alias("score"), ref.alias("reference"))).otherwise(best)

    return F.aggregate(references, start, step)


def hops(qid: Column, missing: Column | None = None) -> Column:
    """Integer before ``hop`` at the start of an id; else ``missing``."""
    n = F.regexp_extract(qid, r"^(\d+)hop", 1).try_cast("int")
    return n if missing is None else F.coalesce(n, missing)


def aliases(text: Column, gold: Column, sep: str = r"\|\|") -> Column:
    """Trimmed alias list of a joined cell, the gold answer put first if it is not in it."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), sep), lambda x: F.trim(x)), lambda a: a != "")
    return F.when(gold.isNull() | F.array_contains(parts, gold), parts).otherwise(F.concat(F.array(gold), parts))


def topic(text: Column, fallback: Column, size: int = 200) -> Column:
    """The first line that isn't blank, cut to ``size`` characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.substring(F.get(lines, 0), 1, size), fallback)


def decode_spans(spans: Column, text: Column) -> Column:
    """Text of ``start:end[,start:end]`` (0-based, half open), parts joined by a space; NULL if it can't be parsed."""
    pairs = F.transform(F.split(spans, ","), lambda s: F.transform(F.split(s, ":"), lambda x: x.try_cast("int")))
    fine = F.forall(pairs, lambda p: (F.size(p) == 2) & F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull() & (F.get(p, 0) >= 0))
    parts = F.transform(pairs, lambda p: F.trim(F.substring(text, F.get(p, 0) + 1, F.greatest(F.get(p, 1) - F.get(p, 0), F.lit(0)))))
    joined = F.array_join(F.filter(parts, lambda x: x != ""), " ")
    return F.when(fine & (joined != ""), joined)


def votes(cell: Column) -> Column:
    """JSON object of span -> votes as an array of (votes, span), most votes first, then by span; NULL if malformed."""
    entries = F.map_entries(F.from_json(cell, "map<string,int>"))
    return F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("span"))))


#: Keys of a cell of votes that are no spans: no answer, and a question that makes no sense.
NO_ANSWER, BAD_QUESTION = "none", "badQuestion"


def parsed_votes(cell: Column, story: Column) -> Column:
    """JSON object of span -> votes as answers (votes, answer; most votes first, then as they stand in the cell), n_none
    and n_bad. Spans that can't be read are left out; a null or malformed cell has no answers and no votes."""
    entries = F.coalesce(F.map_entries(F.from_json(cell, "map<string,int>")), F.array().cast("array<struct<key:string,value:int>>"))
    given = lambda key: F.coalesce(F.get(F.transform(F.filter(entries, lambda e: e["key"] == key), lambda e: e["value"]), 0), F.lit(0))
    spans = F.filter(entries, lambda e: ~e["key"].isin(NO_ANSWER, BAD_QUESTION))
    read = F.transform(spans, lambda e, i: F.struct((-e["value"]).alias("neg"), i.alias("at"), decode_spans(e["key"], story).alias("answer")))
    answers = F.transform(F.array_sort(F.filter(read, lambda r: r["answer"].isNotNull())), lambda r: F.struct((-r["neg"]).alias("votes"), r["answer"].alias("answer")))
    return F.struct(answers.alias("answers"), given(NO_ANSWER).alias("n_none"), given(BAD_QUESTION).alias("n_bad"))


def agreed_answers(votes: Column, least: int = 2) -> Column:
    """Answers of ``parsed_votes`` that at least two gave, if the first of them beats both kinds of refusal; else NULL."""
    agreed = F.filter(votes["answers"], lambda a: a["votes"] >= least)
    first = F.get(F.transform(agreed, lambda a: a["votes"]), 0)
    return F.when(first > F.greatest(votes["n_none"], votes["n_bad"]), agreed)


def atomic_facts(block: Column) -> Column:
    """Facts of the first run of ``- `` lines, each ended with a full stop unless it ends in punctuation."""
    start = F.struct(F.array().cast("array<string>").alias("facts"), F.lit(False).alias("done"))

    def step(acc: Column, line: Column) -> Column:
        item = F.trim(line)
        fact = F.trim(F.substring(item, 3, 1_000_000))
        ended = F.when(fact.rlike(PUNCTUATION + "$"), fact).otherwise(F.concat(fact, F.lit(".")))
        take = ~acc["done"] & item.startswith("- ")
        stop = acc["done"] | (~item.startswith("- ") & (F.size(acc["facts"]) > 0))
        return F.struct(F.when(take & (fact != ""), F.concat(acc["facts"], F.array(ended))).otherwise(acc["facts"]).alias("facts"), stop.alias("done"))

    text = F.regexp_replace(F.replace(F.coalesce(block, F.lit("")), F.lit("<|eot_id|>"), F.lit("")), r"-\s*\n", "")
    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: acc["facts"])


def sentences(text: Column) -> Column:
    """Sentences by a rule: after . ! or ? and white space, unless a single initial stands before; a line break ends one.
    Sentences of one word are joined to the one before. An approximation, as no trained tokenizer is at hand."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<!(?:^|[\s.])[A-Z])([.!?])\s+", "$1\n")
    parts = F.filter(F.transform(F.split(marked, "\n"), lambda x: F.trim(x)), lambda s: s != "")

    def step(acc: Column, s: Column) -> Column:
        single = ~s.contains(" ") & (F.size(acc) > 0)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.element_at(acc, -1), F.lit("")), F.lit(" "), s)))
        return F.when(single, joined).otherwise(F.concat(acc, F.array(s)))

    return F.when(F.size(parts) == 0, parts).otherwise(F.aggregate(F.slice(parts, 2, 1_000_000), F.slice(parts, 1, 1), step))


# What replies begin with before the answer itself.
LEAD_IN = r"(?i)^(the answer is\s*:?\s*|based on (the )?(text|passage|context)[,.]?\s*|according to (the )?(text|passage)[,.]?\s*|the .{0,60} is not explicitly mentioned[^.]*\.\s*)"
_EDGES = r"^\s+|\s+$"


def short_answer(reply: Column) -> Column:
    """The first sentence behind a lead-in; all that is left if there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(reply, F.lit("")), LEAD_IN, ""), _EDGES, "")
    first = F.regexp_replace(F.get(F.split(bare, r"(?<=[.!?])\s+"), 0), _EDGES, "")
    return F.when(F.coalesce(first, F.lit("")) == "", bare).otherwise(first)
