"""Text and document operators on the given tables. Pattern lists are built from words of the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortgrid.bindings.registry import query
from cohortgrid.bindings.summaries import PROF, profiles
from cohortgrid.bindings.tables import pick, pick_sql, r6, table
from cohortgrid.functions import text as X
from cohortgrid.functions.cleaning import split_targets
from cohortgrid.operators import documents as D

# RE2 has ASCII word edges only, so the SQL side spells out the edges.
L, R = "(?:^|[^\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])"


def sql_words(alternatives: str, col: str = "text") -> str:
    return f"regexp_matches({col}, '(?i){L}(?:{alternatives}){R}')"


WORDS = ["tionen", "ndtion", "queque", "enlich", "thintion", "lement", "inging", "ortion", "ouelle", "erlich", "bleble", "nombre"]
PATTERNS = [r"\bthe of\b", r"\band (the|of)\b", r"\blicense[ds]?\b", r"\bque(que)?\b", r"\btoken\b", r"\bdie\b", r"for(e|th)", r"\bis the\b"]
PATTERN_SQL = [sql_words("the of"), sql_words("and (?:the|of)"), sql_words("license[ds]?"), sql_words("que(?:que)?"), sql_words("token"), sql_words("die"), "regexp_matches(text, '(?i)for(e|th)')", sql_words("is the")]


def _hits(items: list[tuple[str, str]]) -> str:
    """Names of the tests that hold, joined by ';'."""
    parts = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in items)
    return f"coalesce(array_to_string(list_filter([{parts}], lambda v: v IS NOT NULL), ';'), '')"


@query("txt_01_banned_phrases", f"""
SELECT doc_id, {_hits(list(zip(PATTERNS, PATTERN_SQL)))} AS matched FROM documents""")
def _(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.array_join(X.matched_patterns(F.col("text"), PATTERNS), ";").alias("matched"))


_SUP, _CON = [r"\bthe of\b", r"\bqueque\b", r"\bder\b"], [r"\bis the\b", r"\blement\b", r"\bdie\b"]


@query("txt_02_stance", f"""
SELECT doc_id, CASE WHEN text IS NULL OR text = '' OR (s AND c) THEN 'unclear' WHEN s THEN 'supporting' WHEN c THEN 'conflicting' ELSE 'neutral' END AS stance
FROM (SELECT doc_id, text, {sql_words('the of|queque|der')} AS s, {sql_words('is the|lement|die')} AS c FROM documents)""")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.stance(F.col("text"), _SUP, _CON).alias("stance"))


def citations(spark, folder):
    """Documents as citations; one in five has a DOI, some a PMID or PMCID, the rest only title and year."""
    d = table(spark, folder, "documents")
    i = F.col("doc_id")
    return d.select(
        "doc_id", F.col("text").alias("title"), (i % 10 + 2015).cast("int").alias("year"), F.when(i % 5 == 0, F.concat(F.lit(" 10.1000/ABC"), (i % 70).cast("string"))).alias("doi"),
        F.when(i % 5 == 1, (F.col("n_chars") % 90 + 10000).cast("string")).alias("pmid"), F.when(i % 5 == 2, F.concat(F.lit("PMC"), (F.col("n_chars") % 50).cast("string"))).otherwise("").alias("pmcid"),
        F.col("source").alias("source_query"), F.when(i % 3 == 0, "Review-article").when(i % 3 == 1, "research").alias("article_type"), (i % 4 == 0).alias("peer_reviewed"),
        F.when(i % 2 == 0, F.col("source")).alias("journal"), (i % 7 == 0).alias("full_text_available"), F.col("text").alias("excerpt"))


CIT = """c AS (SELECT doc_id, text, source, CAST(doc_id % 10 + 2015 AS INTEGER) AS year, CASE WHEN doc_id % 5 = 0 THEN ' 10.1000/ABC' || (doc_id % 70) END AS doi, CASE WHEN doc_id % 5 = 1 THEN CAST(n_chars % 90 + 10000 AS VARCHAR) END AS pmid, CASE WHEN doc_id % 5 = 2 THEN 'PMC' || (n_chars % 50) ELSE '' END AS pmcid,
  CASE doc_id % 3 WHEN 0 THEN 'Review-article' WHEN 1 THEN 'research' END AS article_type, doc_id % 4 = 0 AS peer, doc_id % 2 = 0 AS jr, doc_id % 7 = 0 AS ft FROM documents),
k AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 'doi:' || lower(trim(doi)) WHEN pmid IS NOT NULL THEN 'pmid:' || pmid WHEN pmcid <> '' THEN 'pmcid:' || pmcid ELSE 'title:' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ':' || year END AS dedup_key FROM c),
dd AS (SELECT *, (SELECT array_to_string(list_sort(list(DISTINCT source)), ';') FROM k q WHERE q.dedup_key = k.dedup_key) AS matched FROM k QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY doc_id) = 1)"""


@query("txt_03_dedup", f"""
WITH {CIT} SELECT doc_id, md5(dedup_key) AS key_hash, matched AS matched_queries FROM dd""")
def _(spark, folder):
    out = D.dedup_citations(citations(spark, folder), [F.col("doc_id")])
    return out.select("doc_id", F.md5("dedup_key").alias("key_hash"), F.array_join("matched_queries", ";").alias("matched_queries"))


@query("txt_04_rank_citations", f"""
WITH {CIT}, p AS (SELECT doc_id, dedup_key, least(100, 10 + CASE WHEN peer THEN 30 ELSE 0 END + CASE WHEN doi IS NOT NULL OR pmid IS NOT NULL OR pmcid <> '' THEN 20 ELSE 0 END + CASE WHEN jr THEN 10 ELSE 0 END + CASE WHEN ft OR pmcid <> '' THEN 10 ELSE 0 END + CASE WHEN lower(article_type) LIKE '%review%' THEN 15 ELSE 0 END + CASE WHEN 2026 - year <= 10 THEN 5 ELSE 0 END) AS cred,
 least(100, 15 + CASE WHEN contains(lower(text), 'thintion') THEN 30 ELSE 0 END + least(15, len(string_split(matched, ';')) * 5) + least(15, CASE WHEN contains(lower(text), 'lement') THEN 5 ELSE 0 END + CASE WHEN contains(lower(text), 'ouelle') THEN 5 ELSE 0 END + CASE WHEN contains(lower(text), 'for') THEN 5 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 5 ELSE 0 END)) AS rel FROM dd)
SELECT doc_id, cred AS credibility_score, rel AS relevance_score, round(0.45 * cred + 0.55 * rel, 1)::DOUBLE AS combined_score, row_number() OVER (ORDER BY round(0.45 * cred + 0.55 * rel, 1) DESC, dedup_key) AS evidence_rank FROM p""")
def _(spark, folder):
    out = D.rank_citations(D.dedup_citations(citations(spark, folder), [F.col("doc_id")]), "Thintion", ["lement", "ouelle", "for", "the"], 2026)
    return out.select("doc_id", "credibility_score", "relevance_score", "combined_score", "evidence_rank")


_CRIT = ["HER2-negative disease required", "HER2 positive tumours; ECOG performance 0-1", "ER-positive; at least 45 years old", "Estrogen receptor negative, stage III", "PR-positive only", "No known brain lesions", "HER2 IHC 1+, ER positive, 60 years, ECOG up to 1", "stage IV"]
_H2 = ["Positive", "NEUTRAL", "", None, "LOSS"]
_ERS = ["Positive", "Negative", None]
ELIG = f"""e AS (SELECT doc_id, text || ' ' || {pick_sql(_CRIT, 'doc_id')} AS t, lower(coalesce({pick_sql(_H2, 'doc_id')}, '')) AS h0, lower(coalesce({pick_sql(_ERS, 'n_chars')}, '')) AS e0, lower(coalesce({pick_sql(_ERS, 'doc_id')}, '')) AS p0, CASE WHEN doc_id % 6 > 0 THEN CAST(n_chars % 90 AS DOUBLE) END AS age, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 3 AS INTEGER) END AS ecog FROM documents),
f AS (SELECT *, CASE WHEN regexp_matches(h0, 'posit|gain') THEN 'positive' WHEN regexp_matches(h0, 'negat|neutral|loss') THEN 'negative' ELSE 'unknown' END AS h, CASE WHEN e0 LIKE 'posit%' THEN 'positive' WHEN e0 LIKE 'neg%' THEN 'negative' ELSE 'unknown' END AS er, CASE WHEN p0 LIKE 'posit%' THEN 'positive' WHEN p0 LIKE 'neg%' THEN 'negative' ELSE 'unknown' END AS pr, regexp_extract(t, '(?i)(\\d{{1,3}})\\s*years', 1) AS yrs, regexp_extract(t, '(?i)ECOG.*?([0-2])', 1) AS ec FROM e),
r AS (SELECT doc_id, unnest(list_filter([
 CASE WHEN regexp_matches(t, '(?i)her2[\\s-]*(negative|non-amplified|ihc\\s*0|ihc\\s*1\\+?)') THEN 'HER2-negative requirement:' || CASE h WHEN 'negative' THEN 'met' WHEN 'positive' THEN 'not_met' ELSE 'unknown' END END,
 CASE WHEN regexp_matches(t, '(?i)her2[\\s-]*(positive|amplified|ihc\\s*3\\+)') THEN 'HER2-positive requirement:' || CASE h WHEN 'positive' THEN 'met' WHEN 'negative' THEN 'not_met' ELSE 'unknown' END END,
 CASE WHEN regexp_matches(t, '(?i)(er|estrogen receptor)[\\s-]*positive') THEN 'ER-positive requirement:' || CASE er WHEN 'positive' THEN 'met' WHEN 'negative' THEN 'not_met' ELSE 'unknown' END END,
 CASE WHEN regexp_matches(t, '(?i)(er|estrogen receptor)[\\s-]*negative') THEN 'ER-negative requirement:' || CASE er WHEN 'negative' THEN 'met' WHEN 'positive' THEN 'not_met' ELSE 'unknown' END END,
 CASE WHEN regexp_matches(t, '(?i){L}PR[\\s-]*positive') THEN 'PR-positive requirement:' || CASE pr WHEN 'positive' THEN 'met' WHEN 'negative' THEN 'not_met' ELSE 'unknown' END END,
 CASE WHEN yrs <> '' THEN 'Minimum age:' || CASE WHEN age IS NULL THEN 'unknown' WHEN age < CAST(yrs AS DOUBLE) THEN 'not_met' ELSE 'met' END END,
 CASE WHEN ec <> '' THEN 'ECOG performance status:' || CASE WHEN ecog IS NULL THEN 'unknown' WHEN ecog <= CAST(ec AS INTEGER) THEN 'met' ELSE 'not_met' END END,
 CASE WHEN regexp_matches(t, '(?i)stage\\s+(IV|4|III|3|II|2)') THEN 'Stage requirement:unknown' END], lambda v: v IS NOT NULL)) AS c FROM f),
x AS (SELECT doc_id, split_part(c, ':', 1) AS criterion, split_part(c, ':', 2) AS status FROM r UNION ALL SELECT doc_id, 'General eligibility', 'unknown' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r))"""


def criteria(spark, folder):
    d = table(spark, folder, "documents")
    i = F.col("doc_id")
    t = F.concat(F.col("text"), F.lit(" "), pick(_CRIT, i))
    return d.select("doc_id", X.eligibility(t, pick(_H2, i), pick(_ERS, F.col("n_chars")), pick(_ERS, i), F.when(i % 6 > 0, (F.col("n_chars") % 90).cast("double")), F.when(i % 4 > 0, (i % 3).cast("int")), F.lit("II")).alias("criteria"))


@query("txt_05_eligibility", f"WITH {ELIG} SELECT doc_id, criterion, status FROM x")
def _(spark, folder):
    return criteria(spark, folder).select("doc_id", F.inline("criteria"))


@query("txt_06_eligibility_class", f"""
WITH {ELIG} SELECT doc_id, CASE WHEN bool_or(status = 'not_met') THEN 'potentially_ineligible' WHEN bool_or(status = 'met' AND criterion NOT IN ('Minimum age', 'General eligibility')) THEN 'potentially_eligible' ELSE 'insufficient_information' END AS assessment FROM x GROUP BY 1""")
def _(spark, folder):
    return criteria(spark, folder).select("doc_id", X.eligibility_class(F.col("criteria")).alias("assessment"))


_LAND = ["Ireland", "France", "Japan", "United States", " spain ", "Brazil"]


@query("txt_07_studies", f"""
SELECT doc_id, 'N' || doc_id AS study_id, CASE WHEN doc_id % 3 = 0 THEN 'RECRUITING' ELSE 'COMPLETED' END AS status, 'PHASE' || (doc_id % 4) AS phase, source AS conditions, (CASE WHEN doc_id % 6 IN (2, 5) THEN 0 ELSE 1 END) + (CASE WHEN n_chars % 6 IN (2, 5) THEN 0 ELSE 1 END) AS n_sites
FROM documents WHERE NOT (doc_id % 6 IN (2, 5) AND n_chars % 6 IN (2, 5)) AND (regexp_matches(lower(text), 'thintion|lement|ouelle') OR regexp_matches(source, 'lement'))""")
def _(spark, folder):
    d = table(spark, folder, "documents")
    i = F.col("doc_id")

    def loc(c):
        return F.struct(F.lit("F").alias("facility"), F.lit("C").alias("city"), c.alias("country"))

    study = F.to_json(F.struct(F.struct(
        F.struct(F.concat(F.lit("N"), i.cast("string")).alias("nctId"), F.col("text").alias("briefTitle")).alias("identificationModule"),
        F.struct(F.when(i % 3 == 0, "RECRUITING").otherwise("COMPLETED").alias("overallStatus")).alias("statusModule"),
        F.struct(F.array(F.concat(F.lit("PHASE"), (i % 4).cast("string"))).alias("phases")).alias("designModule"), F.struct(F.array("source").alias("conditions")).alias("conditionsModule"),
        F.struct(F.array(loc(pick(_LAND, i)), loc(pick(_LAND, F.col("n_chars")))).alias("locations")).alias("contactsLocationsModule")).alias("protocolSection")))
    out = D.parse_studies(d.select("doc_id", study.alias("js")), "js", ["doc_id"], ["thintion", "lement", "ouelle"])
    return out.select("doc_id", "study_id", "status", "phase", F.array_join("conditions", ";").alias("conditions"), F.size("sites").alias("n_sites"))


@query("txt_08_sites", f"""
WITH t AS (SELECT * FROM (VALUES ('ireland', 0, 53.4129, -8.2439), ('france', 1, 46.2276, 2.2137), ('united states', 2, 39.8283, -98.5795), ('spain', 1, 40.4637, -3.7492)) v(c, tier, la, lo)), s AS (SELECT c_custkey, lower(trim({pick_sql(_LAND, 'c_custkey')})) AS c FROM customer)
SELECT c_custkey, coalesce(tier, 3) AS tier, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(la) - radians(53.4129)) / 2), 2) + cos(radians(53.4129)) * cos(radians(la)) * pow(sin((radians(lo) - radians(-8.2439)) / 2), 2))), 4) AS km, tier IS NOT NULL AS included FROM s LEFT JOIN t USING (c)""")
def _(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", pick(_LAND, F.col("c_custkey")).alias("country"))
    return D.rank_sites(c).select("c_custkey", "tier", r6("km", 4).alias("km"), "included")


@query("txt_09_group_studies", """
SELECT l_orderkey AS study_id, first(l_extendedprice ORDER BY l_linenumber, l_extendedprice) AS score, array_to_string(list_sort(list(DISTINCT 'drug ' || (l_partkey % 30))), ';') AS matched_drugs FROM lineitem GROUP BY 1""")
def _(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("study_id"), F.concat(F.lit("drug "), (F.col("l_partkey") % 30).cast("string")).alias("drug"), F.col("l_extendedprice").alias("score"), "l_linenumber")
    return D.group_studies(li, [F.col("l_linenumber"), F.col("score")]).select("study_id", "score", F.array_join("matched_drugs", ";").alias("matched_drugs"))


@query("txt_10_flatten_json", """
WITH e AS (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 27 ELSE user_id % 4 END AS n, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events)
SELECT event_id, 'type' AS path, event_type AS value, 'value' AS kind FROM e UNION ALL SELECT event_id, 'props', NULL, 'object' FROM e UNION ALL SELECT event_id, 'props.k', CAST(k AS VARCHAR), 'value' FROM e UNION ALL SELECT event_id, 'items', NULL, 'array' FROM e
UNION ALL SELECT event_id, 'items[' || i || ']', NULL, 'object' FROM e, range(25) t(i) WHERE i <= n UNION ALL SELECT event_id, 'items[' || i || '].at', CAST(i AS VARCHAR), 'value' FROM e, range(25) t(i) WHERE i <= n""")
def _(spark, folder):
    return flattened(spark, folder).drop("size")


def flattened(spark, folder, paths=True):
    e = table(spark, folder, "events")
    items = F.transform(F.sequence(F.lit(0), F.when(F.col("user_id") % 10 == 0, 27).otherwise(F.col("user_id") % 4).cast("int")), lambda i: F.struct(i.alias("at")))
    doc = F.to_json(F.struct(F.col("event_type").alias("type"), F.from_json("props", "k long").alias("props"), items.alias("items")))
    return D.flatten_json(e.select("event_id", doc.alias("js")), "event_id", "js", list_prefix=25, paths=paths)


@query("txt_10_container_sizes", """
WITH e AS (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 27 ELSE user_id % 4 END AS n FROM events)
SELECT event_id, 'props' AS path, 1 AS size FROM e UNION ALL SELECT event_id, 'items', n + 1 FROM e UNION ALL SELECT event_id, 'items[' || i || ']', 1 FROM e, range(25) t(i) WHERE i <= n""")
def _(spark, folder):
    return flattened(spark, folder).where(F.col("size").isNotNull()).select("event_id", "path", "size")


@query("txt_11_container_counts", """
WITH e AS (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 27 ELSE user_id % 4 END AS n, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
t AS (SELECT event_id, n, k, n + 1 AS told, CAST(event_id % 900 + 130 AS BIGINT) AS made FROM e)
SELECT event_id AS text_id, CASE WHEN made = coalesce(k, -1) THEN '' ELSE CAST(made AS VARCHAR) END AS numbers FROM t""")
def _(spark, folder):
    """Each event's text quotes the length of its own list, which its document vouches for, and a number that it seldom does."""
    e = table(spark, folder, "events")
    told = F.when(F.col("user_id") % 10 == 0, 28).otherwise(F.col("user_id") % 4 + 1)
    text = F.concat(told.cast("string"), F.lit(" items and "), (F.col("event_id") % 900 + 130).cast("string"), F.lit(" more"))
    texts = e.select(F.col("event_id").alias("text_id"), F.col("event_id").alias("context_id"), text.alias("text"))
    context = D.json_context(flattened(spark, folder, paths=False), "event_id").withColumnRenamed("event_id", "context_id")
    return D.unsupported_numbers(texts, context).select("text_id", F.array_join("unsupported_numbers", ";").alias("numbers"))


CTX = """cx AS (SELECT source AS g, CAST(n_chars AS DOUBLE) AS v FROM documents UNION ALL SELECT source, n_chars / 100000.0::DOUBLE FROM documents), lb AS (SELECT DISTINCT source AS g, CAST(doc_id AS VARCHAR) AS token FROM documents)"""
TOK = """tk AS (SELECT DISTINCT doc_id, g, token FROM (SELECT doc_id, source AS g, unnest(regexp_extract_all(tx, '(^|[^A-Za-z0-9._-])(\\d+(\\.\\d+)?)', 2)) AS token FROM (SELECT doc_id, source, text || ' About ' || (n_chars % 977) || ' of ' || (doc_id + 12) || ' rows, ' || round(n_chars / 1000.0::DOUBLE, 1) || '%.' AS tx FROM documents)) WHERE token NOT IN ('0','1','2','3','4','5','6','7','8','9','10','100','0.05','0.5','95')),
bad AS (SELECT * FROM tk WHERE NOT EXISTS (SELECT 1 FROM lb WHERE lb.g = tk.g AND lb.token = tk.token) AND NOT EXISTS (SELECT 1 FROM (SELECT g, v FROM cx UNION ALL SELECT g, v * 100 FROM cx WHERE v BETWEEN 0 AND 1) c WHERE c.g = tk.g AND round(c.v, CASE WHEN contains(token, '.') THEN CAST(length(token) - instr(token, '.') AS INTEGER) ELSE 0 END) = CAST(token AS DOUBLE)))"""


def grounding(spark, folder):
    d = table(spark, folder, "documents")
    text = F.concat(F.col("text"), F.lit(" About "), (F.col("n_chars") % 977).cast("string"), F.lit(" of "), (F.col("doc_id") + 12).cast("string"), F.lit(" rows, "), F.round(F.col("n_chars") / 1000.0, 1).cast("string"), F.lit("%."))
    texts = d.select(F.col("doc_id").alias("text_id"), F.col("source").alias("context_id"), text.alias("text"))
    nc = F.col("n_chars").cast("double")
    context = d.select(F.col("source").alias("context_id"), F.explode(F.array(nc, nc / 100000.0)).alias("value"), F.col("doc_id").cast("string").alias("label"))
    return texts, context


@query("txt_11_unsupported_numbers", f"""
WITH {CTX}, {TOK} SELECT d.doc_id AS text_id, coalesce(array_to_string(list_sort(list(token) FILTER (WHERE token IS NOT NULL)), ';'), '') AS numbers FROM documents d LEFT JOIN bad USING (doc_id) GROUP BY 1""")
def _(spark, folder):
    texts, context = grounding(spark, folder)
    return D.unsupported_numbers(texts, context).select("text_id", F.array_join("unsupported_numbers", ";").alias("numbers"))


_NM = sorted(WORDS)
KNOWN = "kn AS (SELECT source AS g, " + ", ".join(f"bool_or(contains(lower(text), '{w}')) AS k{i}" for i, w in enumerate(_NM)) + " FROM documents JOIN labels USING (doc_id) GROUP BY 1)"
MISSING = "coalesce(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql_words(w)} AND NOT coalesce(k{i}, false) THEN '{w}' END" for i, w in enumerate(_NM)) + "], lambda v: v IS NOT NULL), ';'), '')"


def named_context(spark, folder):
    d = table(spark, folder, "documents")
    return d.join(table(spark, folder, "labels").select("doc_id"), "doc_id").select(F.col("source").alias("context_id"), F.lit(None).cast("double").alias("value"), F.col("text").alias("label"))


@query("txt_12_unsupported_names", f"""
WITH {KNOWN} SELECT doc_id AS text_id, {MISSING} AS names FROM documents LEFT JOIN kn ON g = source""")
def _(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), F.col("source").alias("context_id"), "text")
    return D.unsupported_names(d, named_context(spark, folder), WORDS).select("text_id", F.array_join("unsupported_names", ";").alias("names"))


_CLAIM = ["All gates passed.", "Every one of the gates has passed", "the gates were mixed", "no gate has failed", "gates: all of them passed"]
FAILED = "fl AS (SELECT source AS g, list_sort(list(DISTINCT 'gate' || (doc_id % 30))) AS failed FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 1 GROUP BY 1)"


def gates(spark, folder):
    j = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return j.select(F.col("source").alias("context_id"), F.concat(F.lit("gate"), (F.col("doc_id") % 30).cast("string")).alias("gate"), ((F.col("quality") != 0) | (F.col("toxic") != 1)).alias("passed"))


def claimed(spark, folder):
    d = table(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("text_id"), F.col("source").alias("context_id"), F.concat(F.col("text"), F.lit("\n"), pick(_CLAIM, F.col("doc_id"))).alias("text"))


@query("txt_13_contradicted_gates", f"""
WITH {FAILED} SELECT doc_id AS text_id, CASE WHEN doc_id % 5 <> 2 THEN coalesce(array_to_string(failed, ';'), '') ELSE '' END AS gates FROM documents LEFT JOIN fl ON g = source""")
def _(spark, folder):
    return D.contradicted_gates(claimed(spark, folder), gates(spark, folder)).select("text_id", F.array_join("contradicted_gates", ";").alias("gates"))


@query("txt_14_review", f"""
WITH {CTX}, {TOK}, {KNOWN}, {FAILED}, nb AS (SELECT DISTINCT doc_id FROM bad), r AS (SELECT doc_id, {_hits([('reserved_language', ' OR '.join(PATTERN_SQL[2:5])), ('unsupported_numbers', 'doc_id IN (SELECT doc_id FROM nb)'), ('unsupported_names', f"{MISSING} <> ''"), ('contradicted_gates', "doc_id % 5 <> 2 AND failed IS NOT NULL")])} AS reasons FROM documents LEFT JOIN kn ON kn.g = source LEFT JOIN fl ON fl.g = source)
SELECT doc_id AS text_id, reasons, reasons = '' AS accepted FROM r""")
def _(spark, folder):
    texts, context = grounding(spark, folder)
    texts = texts.withColumn("text", F.concat("text", F.lit("\n"), pick(_CLAIM, F.col("text_id"))))
    ctx = context.unionByName(named_context(spark, folder))
    out = D.review_texts(texts, ctx, gates(spark, folder), WORDS, PATTERNS[2:5])
    return out.select("text_id", F.array_join("reasons", ";").alias("reasons"), "accepted")


@query("txt_15_claims", """
WITH c AS (SELECT conv_id * 1000 + turn AS claim_id, conv_id % 20 AS g, turn, conv_id, role FROM conversations), k AS (SELECT DISTINCT conv_id % 20 AS g, 'row.' || turn AS key FROM conversations WHERE role = 'user'), ci AS (SELECT DISTINCT conv_id % 20 AS g, 'PMC' || (conv_id % 11) AS id FROM conversations WHERE conv_id % 20 < 15), v AS (SELECT DISTINCT conv_id % 20 AS g, CAST(conv_id % 13 AS VARCHAR) AS t FROM conversations)
SELECT claim_id, coalesce(array_to_string(list_filter([CASE WHEN conv_id % 9 = 4 THEN 'unsafe_language' END, CASE WHEN conv_id % 7 = 0 THEN 'missing_evidence_keys' END, CASE WHEN conv_id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM k WHERE k.g = c.g AND k.key = 'row.' || c.turn) THEN 'unknown_evidence_key' END,
 CASE WHEN g IN (SELECT g FROM ci) AND NOT EXISTS (SELECT 1 FROM ci WHERE ci.g = c.g AND ci.id = 'PMC' || (c.turn + c.conv_id % 11)) THEN 'unknown_citation' END, CASE WHEN NOT EXISTS (SELECT 1 FROM v WHERE v.g = c.g AND v.t = CAST(c.conv_id % 17 AS VARCHAR)) THEN 'ungrounded_number' END], lambda x: x IS NOT NULL), ';'), '') AS errors FROM c""")
def _(spark, folder):
    c = table(spark, folder, "conversations")
    g = F.col("conv_id") % 20
    n = F.col("conv_id")
    keys = F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("row."), F.col("turn").cast("string"))))
    text = F.concat(F.lit("share is "), (n % 17).cast("string"), F.lit("% of rows"), F.when(n % 9 == 4, " and we recommend it").otherwise(""))
    claims = c.select((n * 1000 + F.col("turn")).alias("claim_id"), g.alias("context_id"), text.alias("text"), keys.alias("evidence_keys"), F.array(F.concat(F.lit("PMC"), (F.col("turn") + n % 11).cast("string"))).alias("citation_ids"))
    k = c.where(F.col("role") == "user").select(g.alias("context_id"), F.concat(F.lit("row."), F.col("turn").cast("string")).alias("key"))
    ci = c.where(g < 15).select(g.alias("context_id"), F.concat(F.lit("PMC"), (n % 11).cast("string")).alias("citation_id"))
    v = c.select(g.alias("context_id"), (n % 13).cast("string").alias("value_text"))
    return D.validate_claims(claims, k, ci, v).select("claim_id", F.array_join("errors", ";").alias("errors"))


@query("txt_16_targets", """
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(p_name || ', ' || p_brand || '|none;nan/' || p_type || ' ;' || p_type, '[,;|/]+'), lambda x: upper(trim(x))), lambda x: x NOT IN ('', 'NONE', 'NAN')))), ';') AS targets FROM part""")
def _(spark, folder):
    raw = F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit("|none;nan/"), F.col("p_type"), F.lit(" ;"), F.col("p_type"))
    return table(spark, folder, "part").select("p_partkey", F.array_join(split_targets(raw), ";").alias("targets"))


@query("txt_17_citation_records", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '(untitled)' ELSE 't' || doc_id END AS title, CAST(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 2000 + doc_id % 25 END AS INTEGER) AS year, CASE doc_id % 3 WHEN 0 THEN 'PMC' || doc_id WHEN 1 THEN 'X' || doc_id END AS pmcid, substr(text, 1, 600) AS excerpt FROM documents""")
def _(spark, folder):
    d = table(spark, folder, "documents")
    i = F.col("doc_id")
    when = F.when(i % 9 == 0, "n.d.").otherwise(F.concat((i % 25 + 2000).cast("string"), F.lit("-05-01")))
    js = F.to_json(F.struct(
        F.when(i % 4 != 0, F.concat(F.lit("t"), i.cast("string"))).alias("title"), F.when(i % 2 == 0, when).alias("year"), F.when(i % 2 == 1, when).alias("date"), F.when(i % 3 == 0, F.concat(F.lit("PMC"), i.cast("string"))).alias("pmc_id"),
        F.when(i % 3 == 1, F.concat(F.lit("X"), i.cast("string"))).alias("pmc"), F.when(i % 5 < 2, F.col("text")).alias("abstract"), F.when(i % 5 == 2, F.col("text")).alias("excerpt"), F.when(i % 5 > 2, F.col("text")).alias("snippet")))
    return D.parse_citation_records(d.select("doc_id", js.alias("js")), "js", ["doc_id"], excerpt=600).select("doc_id", "title", "year", "pmcid", "excerpt")


@query("txt_18_cluster_takeaways", f"""
WITH {PROF}, h AS (SELECT cluster, feature, effect, row_number() OVER (PARTITION BY cluster ORDER BY abs(effect) DESC, feature) AS r FROM p WHERE family = 'pathway' AND q < 0.7), n AS (SELECT cluster, string_agg(CASE WHEN effect > 0 THEN 'elevated ' ELSE 'reduced ' END || feature, ', ' ORDER BY r) AS nm FROM h WHERE r <= 2 GROUP BY 1)
SELECT c.cluster, CASE WHEN nm IS NOT NULL THEN 'Subgroup ' || (c.cluster + 1) || ' is defined by ' || nm || ' signalling.' ELSE 'Subgroup ' || (c.cluster + 1) || ' has no pathway passing q < 0.7 versus the rest of the cohort.' END AS takeaway FROM (SELECT DISTINCT cluster FROM p) c LEFT JOIN n USING (cluster)""")
def _(spark, folder):
    return D.cluster_takeaways(profiles(spark, folder), "pathway", 0.7)


@query("txt_18_cohort_takeaways", """
WITH c AS (SELECT c_mktsegment AS cohort, count(*) AS n, CASE WHEN count(*) % 3 > 0 THEN count(*) % 5 + 2 END AS k, count(*) % 2 = 0 AS av, avg(c_acctbal) > 4500 AS passed, round((count(*) % 90) / 40000, 9) AS p FROM customer GROUP BY 1)
SELECT cohort, CASE WHEN av AND k IS NOT NULL THEN 'The data supports ' || k || ' subgroups (n = ' || n || ', ' || cohort || ').' ELSE 'No stable discrete structure in this ' || cohort || ' cohort (n = ' || n || ').' END AS structure,
 CASE WHEN k IS NULL THEN 'Survival is shown as a descriptive overlay, not a selection criterion.' WHEN passed THEN 'The ' || k || ' subgroups differ in overall survival (p = ' || CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END || ').' ELSE 'These subgroups differ molecularly but did not separate survival (p = ' || CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END || ').' END AS survival, true AS safe FROM c""")
def _(spark, folder):
    n = F.count(F.lit(1))
    c = table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("cohort")).agg(n.alias("n"), F.when(n % 3 > 0, n % 5 + 2).alias("k"), (n % 2 == 0).alias("clustering_available"), (F.avg("c_acctbal") > 4500).alias("passed"), F.round((n % 90) / 40000, 9).alias("p"))
    return D.cohort_takeaways(c)


@query("txt_19_citation_blocks", """
SELECT doc_id, 1 AS block_no, 'Study ' || doc_id AS title, '10.1234/ab' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN CAST(10000 + doc_id AS VARCHAR) END AS pmid, CASE WHEN doc_id % 3 = 0 THEN 'PMC' || (100000 + doc_id) END AS pmcid, 'quoted ' || source AS excerpt FROM documents""")
def _(spark, folder):
    d = table(spark, folder, "documents")
    i = F.col("doc_id")
    block = F.concat(F.lit("Found 1 paper\n\n  1. Study "), i.cast("string"), F.lit(" \nhttps://doi.org/10.1234/ab"), i.cast("string"), F.lit(".\n"), F.when(i % 2 == 0, F.concat(F.lit("PMID: "), (i + 10000).cast("string"))).otherwise("no id"),
                     F.when(i % 3 == 0, F.concat(F.lit(" pmc"), (i + 100000).cast("string"))).otherwise(""), F.lit('\n "quoted '), F.col("source"), F.lit('"\n\nDone: '), F.regexp_replace("text", r"\n\s*\n", "\n"))
    return D.parse_citation_blocks(d.select("doc_id", block.alias("out")), "out", ["doc_id"], 300, 600)
