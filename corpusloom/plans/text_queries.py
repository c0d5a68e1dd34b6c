"""Queries over text: sentences, ids, flags, secrets, leakage, near-duplicates, the rule cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import aggregates as A
from corpusloom.operators import planner as P
from corpusloom.operators import relational as R
from corpusloom.operators import sentences as S
from corpusloom.operators.neardup import near_duplicate_classes
from corpusloom.plans.registry import query

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
#: Sentences as a SQL common table: no look-behind in RE2, so the boundary becomes a separator first.
SENTENCES = r"""
 cut AS (
  SELECT doc_id, lang, source, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(
   coalesce(text, ''), '[\t\x{00a0}]', ' ', 'g'), ' {2,}', ' ', 'g'), '([.?!])\s+([A-Z(])', '\1' || chr(31) || '\2', 'g'), chr(31)),
   lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents),
 sentences AS (
  SELECT doc_id, lang, source, CAST(i AS INTEGER) AS sentence_index, parts[i] AS sentence
  FROM (SELECT doc_id, lang, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut))
"""
_KEY = r"""(regexp_matches(lower(sentence), '(^|[^a-z0-9])(ai|nlp)([^a-z0-9]|$)') OR regexp_matches(lower(sentence),
 'artificial\s+intelligence|machine\s+learning|deep\s+learning|neural\s+network|natural\s+language\s+processing|computer\s+vision|language\s+models'))"""
_KEPT = rf"length(sentence) >= 4 AND NOT regexp_matches(sentence, '^\s*\d+\s*$') AND {_KEY}"
_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_TOKENS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda t: t <> ''))"


def _sentences(t):
    return S.explode_sentences(t.texts.select("doc_id", "lang", "source", "text")).drop("text")


@query(f"WITH {SENTENCES} SELECT doc_id, sentence_index, sentence FROM sentences")
def a1_sentence_explode(t):
    return _sentences(t).select("doc_id", "sentence_index", "sentence")


@query(f"WITH {SENTENCES} SELECT doc_id, sentence_index, {_TOKENS.format('sentence')} AS tokens FROM sentences WHERE {_KEPT}")
def a2_keyword_filter(t):
    return S.keyword_filter(_sentences(t), list(S.AI_KEYWORDS)).select("doc_id", "sentence_index", T.token_count(F.col("sentence")).cast("long").alias("tokens"))


@query(f"""WITH {SENTENCES}, kept AS (SELECT doc_id, source, sentence, {_NORM.format('sentence')} AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index) AS k FROM sentences WHERE {_KEPT})
 SELECT doc_id, CAST(k AS INTEGER) AS sentence_index, norm AS sentence_norm, substr(sha1(norm), 1, 16) AS sentence_text_id,
 substr(sha1(source || '/' || doc_id || '.txt|' || k || '|' || norm), 1, 16) AS sentence_id FROM kept""")
def a3_norm_ids(t):
    docs = t.texts.select("doc_id", "source", "lang", "text")
    filings = docs.select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("filename"), F.lit("m").alias("manifest_id"), F.lit("1").alias("cik"), F.lit(2024).alias("year"), F.lit(1).alias("quarter"), F.lit("10-K").alias("form"), F.lit("w").alias("source_window_id"), "text")
    table = S.sentence_table(filings, list(S.AI_KEYWORDS))
    return table.select(F.regexp_extract("source_file", r"/(\d+)\.txt", 1).cast("long").alias("doc_id"), "sentence_index", "sentence_norm", "sentence_text_id", "sentence_id")


@query(f"""WITH {SENTENCES}, n AS (SELECT lang, sentence, {_TOKENS.format('sentence')} AS k FROM sentences)
 SELECT lang, CASE WHEN k <= 12 THEN 'short' WHEN k <= 24 THEN 'medium' ELSE 'long' END AS length_bin,
 count(*) AS n, sum(CASE WHEN regexp_matches(lower(sentence), '\\b(may|might|could|intend|plan|expect|future|transform|revolution|generative ai|risk|uncertain|aim|seek|hope)\\b') THEN 1 ELSE 0 END) AS edge_cases
 FROM n GROUP BY 1, 2""")
def a4_length_bins(t):
    s = _sentences(t).select("lang", T.length_bin(T.token_count(F.col("sentence"))).alias("length_bin"), T.edge_case(F.col("sentence")).alias("e"))
    return s.groupBy("lang", "length_bin").agg(F.count("*").alias("n"), F.count_if("e").alias("edge_cases"))


_FLAGS = rf"""list_filter([CASE WHEN NOT regexp_matches(sentence, '[.?!]$') THEN 'missing_terminal_punct' END, CASE WHEN regexp_matches(sentence, '^\p{{Ll}}') THEN 'lowercase_start' END,
 CASE WHEN {_TOKENS.format('sentence')} < 6 THEN 'short_sentence' END, CASE WHEN regexp_matches(sentence, '[-–—]\s*\d+\s*[-–—]') THEN 'page_fragment_like' END], lambda x: x IS NOT NULL)"""


@query(f"WITH {SENTENCES} SELECT flag, count(*) AS n FROM (SELECT unnest({_FLAGS}) AS flag FROM sentences) GROUP BY flag")
def a5_integrity_flags(t):
    return A.flag_counts(_sentences(t).select(T.integrity_flags(F.col("sentence")).alias("flags")), "flags")


@query(f"WITH {SENTENCES} SELECT lang, count(*) AS n, round(avg(CASE WHEN len({_FLAGS}) > 0 THEN 1.0 ELSE 0.0 END), 6) AS fragment_rate, round(avg(len({_FLAGS}) / 4.0), 6) AS mean_score FROM sentences GROUP BY lang")
def a6_fragment_rate(t):
    s = _sentences(t).select("lang", T.fragment_score(T.integrity_flags(F.col("sentence"))).alias("x"))
    return s.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("x") > 0).cast("double")), 6).alias("fragment_rate"), F.round(F.avg("x"), 6).alias("mean_score"))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
 WHERE regexp_matches(lines[i], 'token = "[0-9a-f]{16,}"')""")
def a7_line_findings(t):
    return P.line_findings(t.texts.select("doc_id", "text"), F.col("line").rlike('token = "[0-9a-f]{16,}"'))


@query("""WITH l AS (SELECT doc_id, i, trim(lines[i]) AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))
 SELECT doc_id, count(DISTINCT line) AS unique_lines, count(*) AS all_lines FROM l WHERE line <> '' GROUP BY doc_id""")
def a8_unique_lines(t):
    docs = t.texts.select("doc_id", "text")
    unique = P.document_lines(docs).groupBy("doc_id").agg(F.count("*").alias("unique_lines"))
    every = docs.select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("all_lines")).where("all_lines > 0")
    return unique.join(every, "doc_id")


@query(rf"""WITH {SENTENCES}, r AS (SELECT CASE WHEN {_TOKENS.format('sentence')} < 6 THEN 'tokens<6' WHEN length(sentence) < 30 THEN 'chars<30'
 WHEN NOT regexp_matches(sentence, '^[^A-Za-z]*[A-Z]') THEN 'no_initial_cap' WHEN NOT regexp_matches(sentence, '[.!?][)\]"''”’]*\s*$') THEN 'no_terminal_punct'
 WHEN 1 - length(regexp_replace(sentence, '[^\p{{L}}]', '', 'g')) / greatest(length(sentence), 1) >= 0.6 THEN 'mostly_non_letters' ELSE '' END AS reason FROM sentences)
 SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def a9_drop_reasons(t):
    return _sentences(t).select(T.validity_reason(F.col("sentence")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(rf"""WITH l AS (SELECT doc_id, i, {_TRIM.format('lines[i]')} AS s FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
 k AS (SELECT doc_id, i, s, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l WHERE NOT regexp_matches(lower(s), '^(\d*|table of contents)$')),
 f AS (SELECT doc_id, i, s, CASE WHEN before IS NOT NULL AND NOT regexp_matches(before, '[.?!]$') AND regexp_matches(s, '^\p{{Ll}}') THEN 0 ELSE 1 END AS opens FROM k)
 SELECT doc_id, CAST(sum(opens) AS BIGINT) AS n FROM f GROUP BY doc_id""")
def a10_merge_fragments(t):
    """Lines as fragments; merged sentences per document."""
    lines = t.texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sentence_index", "sentence"))
    return S.merge_fragments(lines).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(rf"""WITH {SENTENCES}, hit AS (SELECT lang, source, CASE WHEN {_TOKENS.format('sentence')} <= 12 THEN 'Irrelevant' WHEN {_TOKENS.format('sentence')} <= 24 THEN 'Speculative' ELSE 'Actionable' END AS label FROM sentences WHERE {_KEPT}),
 k AS (SELECT DISTINCT lang, source FROM documents),
 c AS (SELECT k.lang, k.source, count(*) FILTER (label = 'Actionable') AS "A_count", count(*) FILTER (label = 'Speculative') AS "S_count", count(*) FILTER (label = 'Irrelevant') AS "I_count", count(label) AS total_count
  FROM k LEFT JOIN hit ON hit.lang = k.lang AND hit.source = k.source GROUP BY 1, 2)
 SELECT lang, source, "A_count", "S_count", "I_count", total_count, round(ln(1 + "A_count"), 6) AS "AI_frequencyA", round(ln(1 + "S_count"), 6) AS "AI_frequencyS", round(ln(1 + "I_count"), 6) AS "AI_frequencyI", round(ln(1 + total_count), 6) AS "AI_frequency_total" FROM c""")
def a11_entity_counts(t):
    """Flagship: sentences, keyword filter, labels, counts and log1p per entity, zero rows kept."""
    s = S.keyword_filter(_sentences(t), list(S.AI_KEYWORDS))
    label = F.when(T.token_count(F.col("sentence")) <= 12, "Irrelevant").when(T.token_count(F.col("sentence")) <= 24, "Speculative").otherwise("Actionable")
    out = A.label_counts(s.withColumn("label", label), ["lang", "source"], "label", keep_empty=t.documents.select("lang", "source"))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("AI_")})


@query(rf"""WITH {SENTENCES}, k AS (SELECT doc_id, count(*) AS segmented, count(*) FILTER ({_KEPT}) AS kept FROM sentences GROUP BY doc_id)
 SELECT d.doc_id, CAST(coalesce(segmented, 0) AS INTEGER) AS segmented, CAST(coalesce(kept, 0) AS INTEGER) AS kept, CASE WHEN coalesce(kept, 0) > 0 THEN 'ok' ELSE 'empty' END AS status FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""")
def a12_extraction_status(t):
    return S.extraction_status(t.texts.select("doc_id", "text"), list(S.AI_KEYWORDS))


@query(rf"""WITH {SENTENCES}, w AS (SELECT doc_id, sentence_index, regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]') AS k FROM sentences),
 c AS (SELECT doc_id, sentence_index, len(list_filter(k, lambda x: x = 'of')) AS concrete, len(list_filter(k, lambda x: x = 'is')) AS vague FROM w)
 SELECT doc_id, sentence_index, concrete, vague, round(CASE WHEN concrete + vague = 0 THEN 0 ELSE concrete / (concrete + vague) END, 6) AS score FROM c WHERE concrete + vague > 0""")
def a13_concreteness(t):
    s = _sentences(t).select("doc_id", "sentence_index", F.explode(F.array(S.concreteness(F.col("sentence"), ["of"], ["is"]))).alias("x"))  # filters aren't pushed below explode
    return s.where("x.concrete + x.vague > 0").select("doc_id", "sentence_index", F.col("x.concrete").cast("long").alias("concrete"), F.col("x.vague").cast("long").alias("vague"), F.round("x.score", 6).alias("score"))


def _norms(t):
    return _sentences(t).select("doc_id", "lang", T.normalize_sentence(F.col("sentence")).alias("norm"))


def _held(t):
    return S.explode_sentences(t.benchmark.select("item_id", "text")).select(T.normalize_sentence(F.col("sentence")).alias("norm"))


_HELD = SENTENCES.replace("cut AS", "bcut AS").replace("FROM cut", "FROM bcut").replace(" sentences AS", " held AS").replace("doc_id, lang, source", "item_id").replace("FROM documents", "FROM benchmark")


@query(f"WITH {SENTENCES}, {_HELD} SELECT lang, count(*) AS n FROM sentences WHERE {_NORM.format('sentence')} NOT IN (SELECT {_NORM.format('sentence')} FROM held) GROUP BY lang")
def b1_leakage_anti(t):
    return R.leakage_free(_norms(t), _held(t), "norm").groupBy("lang").agg(F.count("*").alias("n"))


@query(f"WITH {SENTENCES}, {_HELD} SELECT doc_id, {_NORM.format('sentence')} AS norm FROM sentences WHERE {_NORM.format('sentence')} IN (SELECT {_NORM.format('sentence')} FROM held)")
def b2_leakage_semi(t):
    return R.leaking(_norms(t), _held(t), "norm").select("doc_id", "norm")


@query(f"""WITH {SENTENCES}, n AS (SELECT doc_id, sentence_index, {_NORM.format('sentence')} AS norm FROM sentences)
 SELECT norm, min(doc_id * 100000 + sentence_index) AS first_at FROM n GROUP BY norm""")
def b3_distinct_sentences(t):
    s = _sentences(t).select(T.normalize_sentence(F.col("sentence")).alias("norm"), (F.col("doc_id") * 100000 + F.col("sentence_index")).alias("first_at"))
    return R.dedupe(s, ["norm"], F.col("first_at"), ["first_at"])


@query("""WITH a AS (SELECT text AS norm, lang AS label, count(*) AS na FROM documents WHERE source IN ('src0', 'src1', 'src2') GROUP BY 1, 2), b AS (SELECT text AS norm, lang AS label, count(*) AS nb FROM documents WHERE source NOT IN ('src0', 'src1', 'src2') GROUP BY 1, 2),
 x AS (SELECT count(*) AS o FROM (SELECT DISTINCT norm FROM a) x JOIN (SELECT DISTINCT norm FROM b) y USING (norm)), l AS (SELECT count(DISTINCT norm) AS l FROM a), r AS (SELECT count(DISTINCT norm) AS r FROM b)
 SELECT l AS left_distinct, r AS right_distinct, o AS overlap, round(o / least(l, r), 6) AS overlap_ratio, CASE WHEN o > 0 THEN 'overlapping' ELSE 'disjoint' END AS relationship FROM x, l, r""")
def b4_dataset_relationship(t):
    d = t.texts.select(F.col("text").alias("norm"), F.col("lang").alias("label"), "source")
    first = F.col("source").isin("src0", "src1", "src2")
    return R.dataset_relationship(d.where(first), d.where(~first)).withColumn("overlap_ratio", F.round("overlap_ratio", 6))


@query(rf"""WITH {SENTENCES}, f AS (SELECT lang, regexp_matches(lower(sentence), '\b(may|might|could|will)\b') AS m FROM sentences) SELECT lang, count(*) AS n, count(*) FILTER (m) AS modal FROM f GROUP BY lang""")
def e4_modal_share(t):
    s = _sentences(t).select("lang", F.col("sentence").rlike(r"(?i)\b(may|might|could|will)\b").alias("m"))
    return s.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("m").alias("modal"))


@query()
def f1_near_duplicate_pairs(t):
    """Every sentence with its class of equal normalised texts and the number of other texts near it (ratio 0.95 or more)."""
    at = (F.col("doc_id") * 1_000_000 + F.col("sentence_index")).alias("id")
    rows = _sentences(t).select(at, T.normalize_sentence(F.col("sentence")).alias("norm"))
    member, _ = near_duplicate_classes(rows, "id", "norm")
    split = lambda c: (F.floor(F.col(c) / 1_000_000).alias(c.replace("id", "doc_id")), (F.col(c) % 1_000_000).cast("int").alias(c.replace("id", "sentence_index")))
    return member.select(*split("id"), *split("class_id"), "links")


@query()
def f3_page_breaks(t):
    """Documents after repair of page markers: sentence counts (a marker is put between the first lines)."""
    d = t.texts.select("doc_id", F.regexp_replace("text", r"^([^\n]{20,60}) ", "$1 — 4 — ").alias("text"))
    return S.merge_page_fragments(d.withColumn("sentences", S.segment(F.col("text")))).select("doc_id", F.size("sentences").alias("n"))
