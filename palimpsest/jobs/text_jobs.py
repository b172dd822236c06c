"""Queries over chains, answers, facts and labels, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import labels, text
from palimpsest.operators import aggregates, chains, facts, matching, retrieval
from palimpsest.sources.adapters import CHAINS_SQL, INSTRUCTIONS, table
from palimpsest.sources.adapters import chains as load_chains
from palimpsest.sources.sinks import keep_last

KEYS = ["qid", "group", "instruction_type", "run"]
T = text.TOKENS_SQL
_PAIR_SQL = f"""
tok AS (SELECT qid, step, unnest(CASE WHEN len({T.format('text')}) = 0 THEN [NULL] ELSE {T.format('text')} END) AS token FROM chains),
cnt AS (SELECT qid, step, token, count(token) AS n FROM tok GROUP BY ALL),
tot AS (SELECT qid, step, CAST(sum(n) AS BIGINT) AS n FROM cnt GROUP BY ALL),
sh AS (SELECT a.qid, a.step, b.step AS other, CAST(sum(least(a.n, b.n)) AS BIGINT) AS s FROM cnt a JOIN cnt b ON a.qid = b.qid AND a.token = b.token AND b.step IN (0, a.step - 1) GROUP BY ALL),
sim AS (SELECT c.qid, c.grp, c.instruction_type, c.run, c.step,
    CASE WHEN t.n = 0 OR z.n = 0 THEN CASE WHEN t.n = z.n THEN 1.0 ELSE 0.0 END WHEN coalesce(s0.s, 0) = 0 THEN 0.0 ELSE 2.0 * s0.s / (t.n + z.n) END AS f1_original,
    CASE WHEN p.n IS NULL THEN NULL WHEN t.n = 0 OR p.n = 0 THEN CASE WHEN t.n = p.n THEN 1.0 ELSE 0.0 END WHEN coalesce(s1.s, 0) = 0 THEN 0.0 ELSE 2.0 * s1.s / (t.n + p.n) END AS f1_consecutive
  FROM chains c JOIN tot t USING (qid, step) LEFT JOIN tot z ON z.qid = c.qid AND z.step = 0 LEFT JOIN tot p ON p.qid = c.qid AND p.step = c.step - 1
  LEFT JOIN sh s0 ON s0.qid = c.qid AND s0.step = c.step AND s0.other = 0 LEFT JOIN sh s1 ON s1.qid = c.qid AND s1.step = c.step AND s1.other = c.step - 1
  WHERE c.step > 0)
"""


def rewrite_similarity(spark, sf_dir):
    """Mean token F1 of each step against the original and the step before (JN4, JN5, SC1-SC4, MT1, AG1)."""
    sim = chains.step_similarity(load_chains(spark, sf_dir), KEYS)
    long = sim.unpivot(["step"], ["f1_original", "f1_consecutive"], "metric", "score").where("score is not null")
    return aggregates.describe(long, ["metric", "step"], "score")


REWRITE_SIMILARITY = f"""WITH {CHAINS_SQL}, {_PAIR_SQL},
l AS (SELECT 'f1_original' AS metric, step, f1_original AS score FROM sim UNION ALL SELECT 'f1_consecutive', step, f1_consecutive FROM sim)
SELECT metric, step, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(median(score), 6) AS median, count(score) AS n,
  round(stddev_samp(score) / sqrt(count(score)), 6) AS sem, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE 1.96 * stddev_samp(score) / sqrt(count(*)) END, 6) AS ci95
FROM l WHERE score IS NOT NULL GROUP BY metric, step"""


def similarity_by_chain(spark, sf_dir):
    """Both F1 values of every step of every chain (MT1)."""
    sim = chains.step_similarity(load_chains(spark, sf_dir), KEYS)
    return sim.select("qid", "run", "step", F.round("f1_original", 6).alias("f1_original"), F.round("f1_consecutive", 6).alias("f1_consecutive"))


SIMILARITY_BY_CHAIN = f"WITH {CHAINS_SQL}, {_PAIR_SQL} SELECT qid, run, step, round(f1_original, 6) AS f1_original, round(f1_consecutive, 6) AS f1_consecutive FROM sim"


def normalized_answers(spark, sf_dir):
    """Normalised text, its hash and size for every document (SC1, SC2, SC23)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.normalize_answer(F.col("text"))).alias("normalized_md5"), F.size(text.answer_tokens(F.col("text"))).alias("n_tokens"))


NORMALIZED_ANSWERS = f"SELECT doc_id, md5(array_to_string({T.format('text')}, ' ')) AS normalized_md5, CAST(len({T.format('text')}) AS INTEGER) AS n_tokens FROM documents"


def best_reference(spark, sf_dir):
    """Each conversation's last turn against its earlier turns as references: best F1, first on ties (MT2).

    Tokens are counted per turn and met by joins, so no conversation is gathered in a row.
    """
    c = load_chains(spark, sf_dir).select("qid", "step", "text", text.answer_tokens(F.col("text")).alias("tokens"))
    last = c.groupBy("qid").agg(F.max("step").alias("last"))
    count = c.select("qid", "step", F.explode("tokens").alias("token")).groupBy("qid", "step", "token").agg(F.count(F.lit(1)).alias("n")).join(last, "qid")
    final = count.where("step = last").select("qid", "token", F.col("n").alias("m"))
    shared = count.where("step < last").join(final, ["qid", "token"]).groupBy("qid", "step").agg(F.sum(F.least("n", "m")).alias("shared"))
    sized = c.select("qid", "step", "text", F.size("tokens").alias("n")).join(last, "qid")
    pairs = sized.where("step < last").join(sized.where("step = last").select("qid", F.col("n").alias("m")), "qid").join(shared, ["qid", "step"], "left")
    scored = pairs.select("qid", text.f1(F.coalesce("shared", F.lit(0)), F.col("n"), F.col("m")).alias("score"), (-F.col("step")).alias("first"), F.md5("text").alias("reference_md5"))
    best = scored.groupBy("qid").agg(F.max(F.struct("score", "first", "reference_md5")).alias("best"))
    return best.select("qid", F.round("best.score", 6).alias("score"), "best.reference_md5")


BEST_REFERENCE = f"""WITH {CHAINS_SQL}, c AS (SELECT qid, step, text AS line, max(step) OVER (PARTITION BY qid) AS last FROM chains),
tok AS (SELECT qid, step, unnest({T.format('line')}) AS token FROM c), cnt AS (SELECT qid, step, token, count(*) AS n FROM tok GROUP BY ALL),
tot AS (SELECT qid, step, CAST(len({T.format('line')}) AS BIGINT) AS n, line, last FROM c),
sh AS (SELECT a.qid, a.step, CAST(sum(least(a.n, b.n)) AS BIGINT) AS s FROM cnt a JOIN tot t ON t.qid = a.qid AND t.step = a.step JOIN cnt b ON b.qid = a.qid AND b.token = a.token AND b.step = t.last GROUP BY ALL),
f AS (SELECT r.qid, r.step, r.line, CASE WHEN r.n = 0 OR p.n = 0 THEN CASE WHEN r.n = p.n THEN 1.0 ELSE 0.0 END WHEN coalesce(s, 0) = 0 THEN 0.0 ELSE 2.0 * s / (r.n + p.n) END AS score
  FROM tot r JOIN tot p ON p.qid = r.qid AND p.step = r.last LEFT JOIN sh ON sh.qid = r.qid AND sh.step = r.step WHERE r.step < r.last)
SELECT qid, round(score, 6) AS score, md5(line) AS reference_md5 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, step) AS rn FROM f) WHERE rn = 1"""


def compression(spark, sf_dir):
    """Token share of step 0 by instruction and step, and the hop count of the id (PRJ1, PRJ5, PRJ6, AG21)."""
    c = chains.compression(load_chains(spark, sf_dir), KEYS).withColumn("n_hop", text.hops(F.col("qid"), F.lit(0)))
    return c.groupBy("instruction_type", "n_hop", "step").agg(F.round(F.avg("compression_ratio"), 6).alias("ratio"), F.round(F.avg(F.ln(F.greatest("n_tokens", F.lit(1)))), 6).alias("log_tokens"), F.count(F.lit(1)).alias("n"))


COMPRESSION = f"""WITH {CHAINS_SQL}, c AS (SELECT *, CAST(n_tokens AS DOUBLE) / nullif(max(n_tokens) FILTER (WHERE step = 0) OVER (PARTITION BY qid), 0) AS r FROM chains)
SELECT instruction_type, CAST(regexp_extract(qid, '^(\\d+)hop', 1) AS INTEGER) AS n_hop, step, round(avg(r), 6) AS ratio, round(avg(ln(greatest(n_tokens, 1))), 6) AS log_tokens, count(*) AS n FROM c GROUP BY ALL"""


def resume(spark, sf_dir):
    """Steps still to be scored when every third conversation is done (JN11), without re-reading what is done."""
    c = load_chains(spark, sf_dir)
    done = c.where("run = 0")
    return chains.unfinished(c, done, [*KEYS, "step"]).select("qid", "run", "step", "n_tokens")


RESUME = f"WITH {CHAINS_SQL} SELECT qid, run, step, n_tokens FROM chains c WHERE NOT EXISTS (SELECT 1 FROM chains d WHERE d.run = 0 AND d.qid = c.qid AND d.step = c.step)"


def upsert(spark, sf_dir):
    """Old scores, and new ones for the even turns, the newer winning (SNK3, SO1)."""
    c = load_chains(spark, sf_dir).select("qid", "step", "n_tokens")
    new = c.where("step % 2 = 0").withColumn("n_tokens", F.col("n_tokens") * 10)
    return keep_last(c, new, ["qid", "step"])


UPSERT = f"WITH {CHAINS_SQL} SELECT qid, step, CAST(CASE WHEN step % 2 = 0 THEN n_tokens * 10 ELSE n_tokens END AS INTEGER) AS n_tokens FROM chains"


def original_scores(spark, sf_dir):
    """Step 0 scored once per (hop, run) and given to every chain of that key (JN6, WN4, SO2)."""
    c = load_chains(spark, sf_dir).withColumn("n_hop", text.hops(F.col("qid")))
    first = chains.keep_first(c.where("step = 0"), ["n_hop", "run"], ["qid"]).select("n_hop", "run", "n_tokens")
    return chains.spread_original(first, c, ["n_hop", "run"], ["qid", "n_hop", "run"]).select("qid", "n_hop", "run", "n_tokens")


ORIGINAL_SCORES = f"""WITH {CHAINS_SQL}, c AS (SELECT *, CAST(regexp_extract(qid, '^(\\d+)hop', 1) AS INTEGER) AS n_hop FROM chains),
f AS (SELECT n_hop, run, n_tokens, row_number() OVER (PARTITION BY n_hop, run ORDER BY qid) AS rn FROM c WHERE step = 0)
SELECT DISTINCT c.qid, c.n_hop, c.run, f.n_tokens FROM c JOIN f ON f.rn = 1 AND f.n_hop = c.n_hop AND f.run = c.run"""


def plan(spark, sf_dir):
    """Questions x instructions x wordings x repetitions (SO7, UD4)."""
    q = load_chains(spark, sf_dir).select("qid").distinct()
    kinds = [("style" if k < 2 else "content", i) for k, i in enumerate(INSTRUCTIONS)]
    return chains.rewriting_plan(q, kinds, 3, 2)


PLAN = f"""WITH {CHAINS_SQL} SELECT qid, g AS "group", i AS instruction_type, CAST(r AS INTEGER) AS run, CAST(p AS INTEGER) AS repetition FROM (SELECT DISTINCT qid FROM chains),
(VALUES ('style', 'paraphrase'), ('style', 'formality'), ('content', 'shorten'), ('content', 'elaborate')) k(g, i), range(3) a(r), range(2) b(p)"""


def trajectories(spark, sf_dir):
    """What became of chains whose length fell below that of step 0 (WN8, AG22)."""
    c = chains.compression(load_chains(spark, sf_dir), KEYS).where("step between 1 and 3")
    wide = aggregates.wide(c, ["qid", "instruction_type"], "step", [1, 2, 3], F.max((F.coalesce("compression_ratio", F.lit(0.0)) >= 1).cast("int"))).na.fill(0)
    lost = wide.where("s1 = 0").withColumn("category", labels.trajectory(F.col("s2"), F.col("s3")))
    return aggregates.share(lost, ["instruction_type", "category"], ["instruction_type"])


TRAJECTORIES = f"""WITH {CHAINS_SQL}, c AS (SELECT *, CAST(n_tokens AS DOUBLE) / nullif(max(n_tokens) FILTER (WHERE step = 0) OVER (PARTITION BY qid), 0) AS r FROM chains),
w AS (SELECT qid, instruction_type, {', '.join(f"coalesce(max(CASE WHEN coalesce(r, 0) >= 1 THEN 1 ELSE 0 END) FILTER (WHERE step = {k}), 0) AS s{k}" for k in (1, 2, 3))} FROM c WHERE step BETWEEN 1 AND 3 GROUP BY ALL),
t AS (SELECT instruction_type, CASE WHEN s2 = 0 AND s3 = 0 THEN 'STAYED_ZERO' WHEN s3 > 0 THEN 'LATE_RECOVERY' ELSE 'TRANSIENT_RECOVERY' END AS category, count(*) AS n FROM w WHERE s1 = 0 GROUP BY ALL)
SELECT instruction_type, category, n, round(n / sum(n) OVER (PARTITION BY instruction_type), 6) AS share FROM t"""


def _document_facts(spark, sf_dir):
    """Lines as facts: supported if another document has the line, contradicted if it holds a digit and none has it."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = d.select("doc_id", "lang", F.explode(F.array_distinct(F.filter(F.split("text", "\n"), lambda x: x != ""))).alias("fact"))
    seen = lines.groupBy("fact").agg(F.count(F.lit(1)).alias("n_docs"))
    label = F.when(F.col("n_docs") > 1, "SUPPORTED").when(F.col("fact").rlike("[0-9]"), "CONTRADICTED").otherwise("NOT_SUPPORTED")
    return lines.join(seen, "fact").select("doc_id", "lang", "fact", label.alias("label"))


_FACTS_SQL = """lines AS (SELECT doc_id, lang, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: x <> ''))) AS fact FROM documents WHERE text IS NOT NULL),
facts AS (SELECT doc_id, lang, fact, CASE WHEN count(*) OVER (PARTITION BY fact) > 1 THEN 'SUPPORTED' WHEN regexp_matches(fact, '[0-9]') THEN 'CONTRADICTED' ELSE 'NOT_SUPPORTED' END AS label FROM lines)"""


def fact_scores(spark, sf_dir):
    """Supported share with the length penalty per document (MT4, MT7)."""
    return facts.fact_score(_document_facts(spark, sf_dir), ["doc_id"])


FACT_SCORES = f"""WITH {_FACTS_SQL}, c AS (SELECT doc_id, count(*) AS n_facts, count(*) FILTER (WHERE label = 'SUPPORTED') AS n_supported, count(*) FILTER (WHERE label = 'CONTRADICTED') AS n_contradicted FROM facts GROUP BY doc_id)
SELECT doc_id, n_facts, n_supported, n_facts - n_supported - n_contradicted AS n_not_supported, n_contradicted, round(n_supported / n_facts, 6) AS init_score, round(n_supported / n_facts * least(1.0, n_facts / 10.0), 6) AS factscore FROM c"""


def fact_labels(spark, sf_dir):
    """Labels by language, counts and shares (AG13, AG14, AG16)."""
    return aggregates.crosstab(_document_facts(spark, sf_dir), "lang", "label", ["SUPPORTED", "NOT_SUPPORTED", "CONTRADICTED"])


FACT_LABELS = f"""WITH {_FACTS_SQL} SELECT lang, {', '.join(f"count(*) FILTER (WHERE label = '{v}') AS n_{v}" for v in ('SUPPORTED', 'NOT_SUPPORTED', 'CONTRADICTED'))},
{', '.join(f"round(count(*) FILTER (WHERE label = '{v}') / count(*), 6) AS share_{v}" for v in ('SUPPORTED', 'NOT_SUPPORTED', 'CONTRADICTED'))} FROM facts GROUP BY lang"""


def hallucination_bounds(spark, sf_dir):
    """Lower and upper share of hallucinated facts by language (SC16, AG17)."""
    f = _document_facts(spark, sf_dir)
    second = F.when(F.col("label") == "CONTRADICTED", "world_false").when(F.length("fact") % 2 == 0, "world_true").otherwise("world_uncertain")
    first = F.when(F.col("label") == "SUPPORTED", "grounded").otherwise("extrinsic")
    return facts.bounds(f.withColumn("taxonomy", labels.hallucination(first, second)), ["lang"])


HALLUCINATION_BOUNDS = f"""WITH {_FACTS_SQL}, t AS (SELECT lang, CASE WHEN label = 'SUPPORTED' THEN 'grounded' WHEN label = 'CONTRADICTED' THEN 'extrinsic_false' WHEN length(fact) % 2 = 0 THEN 'extrinsic_true' ELSE 'extrinsic_uncertain' END AS x FROM facts)
SELECT lang, count(*) AS n, round(count(*) FILTER (WHERE x = 'extrinsic_false') / count(*), 6) AS lower, round(count(*) FILTER (WHERE x IN ('extrinsic_false', 'extrinsic_uncertain')) / count(*), 6) AS upper FROM t GROUP BY lang"""


def fact_recall(spark, sf_dir):
    """Lines of a conversation's first turn that later turns still hold (JN12, MT5, MT8)."""
    c = load_chains(spark, sf_dir)
    e0 = c.where("step = 0").select("qid", F.explode(F.array_distinct(F.filter(F.split("text", r"\s+"), lambda x: x != ""))).alias("fact"))
    found = facts.recalled(e0, c.where("step > 0").select("qid", "step", "text"), "qid", ["qid", "step"])
    return found.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "SURVIVED").alias("n_survived"), F.round(F.avg((F.col("label") == "SURVIVED").cast("int")), 6).alias("recall"))


FACT_RECALL = f"""WITH {CHAINS_SQL}, e AS (SELECT qid, unnest(list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) AS fact FROM chains WHERE step = 0)
SELECT step, count(*) AS n, count(*) FILTER (WHERE contains(text, fact)) AS n_survived, round(avg(CASE WHEN contains(text, fact) THEN 1 ELSE 0 END), 6) AS recall FROM chains JOIN e USING (qid) WHERE step > 0 GROUP BY step"""


def answer_kinds(spark, sf_dir):
    """EMPTY, REFUSAL, WRONG by role of the turn (SC17, FIL9)."""
    c = table(spark, sf_dir, "conversations")
    return aggregates.share(c.withColumn("kind", labels.answer_kind(F.col("text"), [*labels.REFUSALS, "re the "])), ["role", "kind"], ["role"])


ANSWER_KINDS = f"""WITH k AS (SELECT role, CASE WHEN trim(lower(coalesce(text, ''))) IN ('', 'nan') THEN 'EMPTY' WHEN {' OR '.join("contains(lower(text), '" + p.replace("'", "''") + "')" for p in [*labels.REFUSALS, 're the '])} THEN 'REFUSAL' ELSE 'WRONG' END AS kind FROM conversations),
c AS (SELECT role, kind, count(*) AS n FROM k GROUP BY ALL) SELECT role, kind, n, round(n / sum(n) OVER (PARTITION BY role), 6) AS share FROM c"""


def demo_retrieval(spark, sf_dir):
    """The benchmark item BM25 ranks first for each whole document (MT13)."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("qid"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("did"), "text")
    return retrieval.bm25_top(d, b).select("qid", "did", "score")


DEMO_RETRIEVAL = """WITH tk AS (SELECT item_id AS did, unnest(string_split(coalesce(text, ''), ' ')) AS token FROM benchmark),
size AS (SELECT count(DISTINCT did) AS n_docs, count(*) / count(DISTINCT did) AS avgdl FROM tk),
tf0 AS (SELECT did, token, count(*) AS tf FROM tk GROUP BY ALL), tf AS (SELECT *, sum(tf) OVER (PARTITION BY did) AS dl, count(*) OVER (PARTITION BY token) AS df FROM tf0),
i0 AS (SELECT DISTINCT token, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf FROM tf, size), i AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER () ELSE idf END AS idf FROM i0),
p AS (SELECT token, did, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf JOIN i USING (token), size),
q AS (SELECT doc_id AS qid, unnest(string_split(text, ' ')) AS token FROM documents WHERE text IS NOT NULL),
s AS (SELECT qid, did, round(sum(w), 6) AS score FROM q JOIN p USING (token) GROUP BY ALL)
SELECT qid, did, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rn FROM s) WHERE rn = 1"""


def event_votes(spark, sf_dir):
    """Votes of the JSON cells by event type (SC6)."""
    e = table(spark, sf_dir, "events").withColumn("v", text.votes(F.col("props")))
    return e.groupBy("event_type").agg(F.count("v").alias("n"), F.sum(-F.get("v", 0)["neg"]).alias("votes"), F.max(F.size("v")).alias("spans"))


EVENT_VOTES = """SELECT event_type, count(props) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS votes, 1 AS spans FROM events GROUP BY event_type"""


def span_texts(spark, sf_dir):
    """Texts of character spans of every document (SC5)."""
    d = table(spark, sf_dir, "documents")
    spans = F.when(F.col("doc_id") % 7 == 0, "oops").otherwise(F.concat(F.lit("0:4,"), (F.col("doc_id") % 50).cast("string"), F.lit(":"), (F.col("doc_id") % 50 + 9).cast("string")))
    return d.select("doc_id", text.decode_spans(spans, F.col("text")).alias("answer"))


SPAN_TEXTS = """SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR text IS NULL THEN NULL ELSE nullif(array_to_string(list_filter([trim(substring(text, 1, 4), ' '), trim(substring(text, CAST(doc_id % 50 + 1 AS INTEGER), 9), ' ')], lambda x: x <> ''), ' '), '') END AS answer FROM documents"""


def sampled_questions(spark, sf_dir):
    """Five questions per hop count in an order drawn from a seed (SM1, SM2, WN5)."""
    q = load_chains(spark, sf_dir).where("step = 0").withColumn("n_hop", text.hops(F.col("qid")))
    return chains.seeded_sample(q, ["n_hop"], "qid", 42, 5).select("n_hop", "qid", "n_tokens")


SAMPLED_QUESTIONS = f"""WITH {CHAINS_SQL}, q AS (SELECT CAST(regexp_extract(qid, '^(\\d+)hop', 1) AS INTEGER) AS n_hop, qid, n_tokens FROM chains WHERE step = 0)
SELECT n_hop, qid, n_tokens FROM (SELECT *, row_number() OVER (PARTITION BY n_hop ORDER BY md5('42|' || qid), qid) AS rn FROM q) WHERE rn <= 5"""


def longest_story(spark, sf_dir):
    """The longest document per source, the smaller id on ties (WN6, WN7)."""
    d = table(spark, sf_dir, "documents").withColumn("size", F.length("text"))
    return chains.best_of(d, ["source"], [F.desc_nulls_last("size"), "doc_id"]).select("source", "doc_id", "size")


LONGEST_STORY = "SELECT source, doc_id, CAST(size AS INTEGER) AS size FROM (SELECT source, doc_id, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC NULLS LAST, doc_id) AS rn FROM documents) WHERE rn = 1"


def id_sets(spark, sf_dir):
    """Labelled documents, those labelled and of language en, and those not labelled (SO3, SO4, JN13, FIL2)."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id")
    both = d.where("lang = 'en'").select("doc_id").intersect(lab).withColumn("part", F.lit("labelled_en"))
    rest = d.join(lab, "doc_id", "left_anti").select("doc_id", F.lit("unlabelled").alias("part"))
    return both.unionByName(rest)


ID_SETS = "SELECT doc_id, 'labelled_en' AS part FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unlabelled' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def embedding_neighbours(spark, sf_dir):
    """Cosine of each vector to its label's mean vector, the three closest per label (ST2)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    first = e.where("x is not null").select(F.size("x").alias("n")).first()
    size = first.n if first else 0
    mean = e.groupBy("label").agg(F.array(*[F.avg(F.get("x", k)) for k in range(size)]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    cosine = F.try_divide(dot("x", "m"), F.sqrt(dot("x", "x") * dot("m", "m")))
    scored = e.where("x is not null").join(mean, "label").select("label", "vec_id", F.round(cosine, 5).alias("cosine"))
    return chains.head_per_group(scored, ["label"], [F.desc("cosine"), "vec_id"], 3)


EMBEDDING_NEIGHBOURS = """WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL),
s AS (SELECT label, vec_id, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 5) AS cosine FROM e JOIN m USING (label, i) GROUP BY ALL)
SELECT label, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rn FROM s) WHERE rn <= 3"""


def token_numbers(spark, sf_dir, rows):
    """(qid, step, numbers) and (number, vector): a vector of ``embeddings`` for every token, chosen by the token's hash, as
    the stand-in for a model's token vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("number"), F.col("embedding").alias("vector"))
    size = e.agg(F.max("number") + 1).first()[0] or 1
    chosen = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % size
    return rows.select("qid", "step", F.transform(F.filter(F.split("text", r"\s+"), lambda t: t != ""), chosen).alias("numbers")), e


def token_matching(spark, sf_dir):
    """Greedy token matching of each turn with the first and with the one before: precision, recall, F (MT10)."""
    found = matching.numbered_matching(*token_numbers(spark, sf_dir, load_chains(spark, sf_dir)), ["qid"])
    return found.select("qid", "step", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


TOKEN_MATCHING = f"""WITH {CHAINS_SQL}, size AS (SELECT max(vec_id) + 1 AS k FROM embeddings),
e AS (SELECT vec_id, list_transform(x, lambda v: v / n) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)),
w AS (SELECT qid, step, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS ws FROM chains),
tk AS (SELECT qid, step, unnest(range(len(ws))) AS pos, unnest(ws) AS token FROM w),
tv AS (SELECT qid, step, pos, CAST('0x' || substring(md5(token), 1, 8) AS BIGINT) % k AS v FROM tk, size),
near AS (SELECT a.vec_id AS v, b.vec_id AS o, list_inner_product(a.u, b.u) AS c FROM e a, e b),
p AS (SELECT DISTINCT qid, step, kind, CASE kind WHEN 'baseline' THEN 0 ELSE step - 1 END AS ref FROM tv, (VALUES ('baseline'), ('consecutive')) k(kind) WHERE step > 0),
m AS (SELECT p.qid, p.step, kind, a.pos AS i, b.pos AS j, c FROM p JOIN tv a ON a.qid = p.qid AND a.step = p.step JOIN tv b ON b.qid = p.qid AND b.step = p.ref JOIN near ON near.v = a.v AND near.o = b.v),
pr AS (SELECT qid, step, kind, avg(c) AS p FROM (SELECT qid, step, kind, i, max(c) AS c FROM m GROUP BY ALL) GROUP BY ALL),
rc AS (SELECT qid, step, kind, avg(c) AS r FROM (SELECT qid, step, kind, j, max(c) AS c FROM m GROUP BY ALL) GROUP BY ALL),
s AS (SELECT qid, step, kind, p, r, 2 * p * r / (p + r) AS f FROM pr JOIN rc USING (qid, step, kind))
SELECT qid, step, {', '.join(f"round(max({c}) FILTER (WHERE kind = '{k}'), 6) AS {n}_{k}" for k in ('baseline', 'consecutive') for c, n in (('p', 'precision'), ('r', 'recall'), ('f', 'f1')))}
FROM (SELECT DISTINCT qid, step FROM p) LEFT JOIN s USING (qid, step) GROUP BY qid, step"""


def perplexity_windows(spark, sf_dir):
    """Sliding windows (length 2048, stride 1024) over the words of every document, and the words each one scores (MT12)."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.whitespace_tokens(F.col("text")).cast("long").alias("n"))
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col("n") - 2048) / 1024.0), F.lit(0).cast("long")))
    w = d.select("doc_id", "n", F.explode(begins).alias("k")).withColumns({"start": F.col("k") * 1024, "stop": F.least(F.col("k") * 1024 + 2048, F.col("n"))})
    before = F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.col("start") + 1024)
    return w.select("doc_id", "start", "stop", (F.col("stop") - before).alias("scored"))


PERPLEXITY_WINDOWS = """WITH d AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda t: t <> '')) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(range(CAST(greatest(ceil((n - 2048) / 1024.0), 0) AS BIGINT) + 1)) AS k FROM d)
SELECT doc_id, k * 1024 AS start, least(k * 1024 + 2048, n) AS stop, least(k * 1024 + 2048, n) - CASE WHEN k = 0 THEN 0 ELSE k * 1024 + 1024 END AS scored FROM w"""


def language_agreement(spark, sf_dir):
    """Agreement of the two label columns beyond chance (SA20's missing step)."""
    return facts.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


LANGUAGE_AGREEMENT = """WITH l AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), s AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS o FROM l),
e AS (SELECT sum(ra * cb) AS e FROM (SELECT a AS v, count(*) AS ra FROM l GROUP BY a) JOIN (SELECT b AS v, count(*) AS cb FROM l GROUP BY b) USING (v))
SELECT n, round(o / n, 6) AS observed, round(e / (n * n), 6) AS expected, round((o / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM s, e"""

JOBS = {
    "rewrite_similarity": (rewrite_similarity, REWRITE_SIMILARITY), "similarity_by_chain": (similarity_by_chain, SIMILARITY_BY_CHAIN), "normalized_answers": (normalized_answers, NORMALIZED_ANSWERS),
    "best_reference": (best_reference, BEST_REFERENCE), "compression": (compression, COMPRESSION), "resume_unfinished": (resume, RESUME), "upsert_keep_last": (upsert, UPSERT),
    "original_scores": (original_scores, ORIGINAL_SCORES), "rewriting_plan": (plan, PLAN), "trajectories": (trajectories, TRAJECTORIES), "fact_scores": (fact_scores, FACT_SCORES),
    "fact_labels": (fact_labels, FACT_LABELS), "hallucination_bounds": (hallucination_bounds, HALLUCINATION_BOUNDS), "fact_recall": (fact_recall, FACT_RECALL), "answer_kinds": (answer_kinds, ANSWER_KINDS),
    "demo_retrieval": (demo_retrieval, DEMO_RETRIEVAL), "event_votes": (event_votes, EVENT_VOTES), "span_texts": (span_texts, SPAN_TEXTS), "sampled_questions": (sampled_questions, SAMPLED_QUESTIONS),
    "longest_story": (longest_story, LONGEST_STORY), "id_sets": (id_sets, ID_SETS), "embedding_neighbours": (embedding_neighbours, EMBEDDING_NEIGHBOURS), "token_matching": (token_matching, TOKEN_MATCHING),
    "perplexity_windows": (perplexity_windows, PERPLEXITY_WINDOWS), "label_agreement": (language_agreement, LANGUAGE_AGREEMENT),
}
