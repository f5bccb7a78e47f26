"""Queries of text, learning, quality, source, streaming and the remaining report operators."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placestat.operators import aggregates as A
from placestat.operators import learning as L
from placestat.operators import quality as D
from placestat.operators import ranking as R
from placestat.operators import spatial as G
from placestat.operators import summarize as S
from placestat.operators import terms as TM
from placestat.operators import text as T
from placestat.plans.queries_spatial import INSIDE, shapes
from placestat.plans.registry import query
from placestat.sources import readers as RD
from placestat.streaming import streams as ST



def cleaned(x):
    """SQL of the cleaned text."""
    out = f"regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), '[\\r\\n\\t]+', ' ', 'g')"
    for mark in "!?,.:;":
        out = f"regexp_replace({out}, '[{mark}]+', '{mark}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("txt1_clean_text", f"SELECT page_id, {cleaned('html')} AS text FROM pages")
def _(t):
    return t.pages.select("page_id", T.clean_text(F.col("html")).alias("text"))


WORDS = ["ist", "und", "der"]


@query(
    "txt2_detect_language",
    "SELECT doc_id, CASE WHEN letters = 0 THEN 'en' WHEN words = 0 THEN 'en' WHEN hits >= 2 OR hits / words >= 0.15 THEN 'hi-en' ELSE 'en' END AS code FROM (SELECT doc_id, len(regexp_extract_all(text, '\\p{L}')) AS letters, len(regexp_extract_all(text, '[a-zA-Z]+')) AS words, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: w IN ('" + "', '".join(WORDS) + "'))) AS hits FROM documents)",
)
def _(t):
    return t.documents.select("doc_id", T.detect_language(F.col("text"), WORDS, ["आहे"], ["है"])["code"].alias("code"))


GLOSSES = [("that", "which one"), ("the", "article"), ("with", "together")]
HAS = "regexp_matches(x, '(?:^|[^\\p{{L}}]){0}(?:[^\\p{{L}}]|$)')"


@query(
    "txt3_expand_glosses",
    "SELECT conv_id, turn, trim(x || " + " || ".join(f"CASE WHEN {HAS.format(w)} THEN ' {g}' ELSE '' END" for w, g in sorted(GLOSSES, key=lambda kv: -len(kv[0]))) + f") AS text FROM (SELECT *, lower({cleaned('text')}) AS x FROM conversations)",
)
def _(t):
    return t.conversations.select("conv_id", "turn", T.expand_glosses(F.col("text"), GLOSSES).alias("text"))


SENTENCES = r"""WITH x AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS x FROM documents),
p AS (SELECT doc_id, x, list_filter(list_transform(string_split(regexp_replace(x, '([.!?।]) ([A-Z0-9"''(ऀ-ॿ])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 2) AS p FROM x),
q AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN p WHEN x <> '' THEN [x] ELSE [] END AS p FROM p)
SELECT doc_id, unnest(range(len(p))) AS position, unnest(p) AS sentence FROM q"""


@query("txt4_split_sentences", SENTENCES)
def _(t):
    return T.split_sentences(t.documents.select("doc_id", "text")).select("doc_id", "position", "sentence")


SECTIONS = r"""WITH RECURSIVE ls AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda s: trim(s)), lambda s: s <> '') AS l FROM documents),
ln AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM ls),
hd AS (SELECT *, len(regexp_extract_all(line, '\S+')) <= 10 AND regexp_matches(line, '^(?:\d+(?:\.\d+)*\.?\s+)?[A-Z][A-Za-z0-9 ,&/()\-]{3,80}$') AND NOT ends_with(line, '.') AS head FROM ln),
sc AS (SELECT *, (sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos))::INT AS section FROM hd),
bd AS (SELECT doc_id, section, coalesce(max(line) FILTER (head), 'Introduction') AS title, coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (NOT head), '') AS body FROM sc GROUP BY 1, 2),
wd AS (SELECT *, len(regexp_extract_all(body, '\S+')) AS n FROM bd),
sn AS (SELECT doc_id, section, title, unnest(range(len(p))) AS i, unnest(p) AS s FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '([.!?।]) ([A-Z0-9"''(ऀ-ॿ])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 2) AS p FROM wd WHERE n > 440)),
sw AS (SELECT *, len(regexp_extract_all(s, '\S+')) AS w FROM sn),
wk AS (SELECT doc_id, section, i, 1 AS part, w AS held FROM sw WHERE i = 0 UNION ALL
  SELECT x.doc_id, x.section, x.i, CASE WHEN held >= 220 THEN part + 1 ELSE part END, CASE WHEN held >= 220 THEN x.w ELSE held + x.w END FROM wk JOIN sw x ON x.doc_id = wk.doc_id AND x.section = wk.section AND x.i = wk.i + 1)
SELECT doc_id, section, 0 AS part, title, body FROM wd WHERE n BETWEEN 5 AND 440 UNION ALL
SELECT * FROM (SELECT doc_id, section, part, any_value(title) || ' (part ' || part || ')' AS title, string_agg(s, ' ' ORDER BY i) AS body FROM wk JOIN sw USING (doc_id, section, i) GROUP BY doc_id, section, part) WHERE len(regexp_extract_all(body, '\S+')) >= 5"""


@query("txt5_segment_sections", SECTIONS)
def _(t):
    return T.segment_sections(t.documents.select("doc_id", "text"), "doc_id")


GAZ = "gz AS (SELECT key, n FROM (SELECT lower(w) AS key, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) GROUP BY 1) WHERE length(key) >= 6)"


def gazetteer(t):
    w = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("name"))
    return w.select(F.lower("name").alias("key")).where(F.length("key") >= 6).groupBy("key").agg(F.count("*").alias("n"))


def places(t):
    """The gazetteer with a kind, a place and a region for each name."""
    long = F.length("key")
    return gazetteer(t).select(
        "key", F.when(long % 2 == 0, "PLACE").otherwise("LANDMARK").alias("kind"), (long * 1e-3 + 18.9).alias("lat"), F.lit(72.85).alias("lng"), F.concat(F.lit("W"), (long % 5).cast("string")).alias("ward_code")
    )


@query(
    "txt6_match_places",
    "SELECT d.doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s/]', ' ', 'g'), '\\s+', ' ', 'g')), '[^ ]+')) AS w FROM documents) d JOIN gz ON gz.key = d.w GROUP BY 1",
    more=GAZ,
)
def _(t):
    return T.match_places(t.documents, gazetteer(t), "doc_id", max_words=2).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("txt7_build_gazetteer", "SELECT key, min(kind) AS kind FROM (SELECT replace(lower(n_name), '_', ' ') AS key, 'STATION' AS kind FROM nation WHERE length(n_name) >= 4 UNION ALL SELECT replace(lower(n_name), '_', ' ') || s, 'STATION' FROM nation, (VALUES (' station'), (' railway station')) v(s) WHERE length(n_name) >= 4) GROUP BY 1")
def _(t):
    places = t.nation.select(F.replace("n_name", F.lit("_"), F.lit("_")).alias("name"), F.lit("STATION").alias("kind"), F.lit(19.0).alias("lat"), F.lit(72.9).alias("lng"))
    return T.build_gazetteer(places.unionByName(places.withColumn("kind", F.lit("ROAD")))).select("key", "kind")


TERMS = [(r"\bthe\b", "ROAD_INFRA", "lexicon", 0.85), (r"\b[A-Z][a-z]+ing\b", "LANDMARK", "pattern", 0.68), (r"\bof the\b", "TEMPORAL", "lexicon", 0.8)]


def found(*patterns):
    """SQL of the matches of patterns, one pattern after the other."""
    return "array_to_string(list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}')" for p in patterns) + "), '|')"


@query("txt8_match_patterns", f"SELECT doc_id, {found(*[p for p, *_ in TERMS[:2]])} AS texts, len(regexp_extract_all(text, '{TERMS[2][0]}'))::INT AS times FROM documents")
def _(t):
    spans = t.documents.select("doc_id", T.match_patterns(F.col("text"), TERMS).alias("e"))
    is_time = lambda x: x["label"] == "TEMPORAL"
    # a null text has no spans; the SQL's lists are null then
    return spans.join(t.documents.select("doc_id", "text"), "doc_id").select(
        "doc_id", F.when(F.col("text").isNotNull(), F.array_join(F.transform(F.filter("e", lambda x: ~is_time(x)), lambda x: x["text"]), "|")).alias("texts"), F.when(F.col("text").isNotNull(), F.size(F.filter("e", is_time))).alias("times")
    )


@query(
    "txt8_match_terms",
    "SELECT d.doc_id, d.w AS text, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents) d JOIN gz ON gz.key = d.w GROUP BY 1, 2",
    more=GAZ,
)
def _(t):
    terms = gazetteer(t).select(F.col("key").alias("term"), F.lit("LANDMARK").alias("label"), F.lit("lexicon").alias("source"), F.lit(0.85).alias("confidence"))
    found = TM.match_terms(t.documents.select("doc_id", "text"), terms).select("doc_id", F.explode("terms").alias("e"))
    return found.groupBy("doc_id", F.lower("e.text").alias("text")).agg(F.count("*").alias("n"))


@query("txt9_resolve_overlaps")
def _(t):
    spans = t.conversations.select("conv_id", "turn", T.resolve_overlaps(T.match_patterns(F.col("text"), TERMS)).alias("e"))
    return spans.select("conv_id", "turn", F.size("e").alias("n"), F.array_join(F.transform("e", lambda x: x["text"]), "|").alias("texts"))


@query("txt10_location_entities", f"SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '{TERMS[1][0]}'), '|') AS places FROM conversations")
def _(t):
    spans = T.location_entities(T.match_patterns(F.col("text"), TERMS))
    return t.conversations.select("conv_id", "turn", F.array_join(F.transform(spans, lambda x: x["text"]), "|").alias("places"))


LANDMARKS = [(r"[A-Z][a-z]{5,}", "LANDMARK", "pattern", 0.68)]
MESSAGES = "ms AS (SELECT conv_id || '-' || turn AS message_id, conv_id, regexp_extract_all(text, '[A-Z][a-z]{5,}') AS es FROM conversations), ea AS (SELECT message_id, unnest(es[1:3]) AS e, unnest(range(1, len(es[1:3]) + 1)) AS i FROM ms), ht AS (SELECT message_id, arg_min(length(key) * 1e-3 + 18.9e0, i) AS lat, arg_min(e, i) AS place FROM ea JOIN gz ON key = lower(e) GROUP BY 1)"


def messages(t):
    """Messages as requests; every third has coordinates in the area."""
    c = F.col("conv_id")
    return t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), "text", F.upper("role").alias("category"), F.when(c % 3 == 0, 19.0).otherwise(1.0).alias("lat"), F.lit(72.9).alias("lng"))


@query(
    "txt11_geocode_requests",
    "SELECT message_id, CASE WHEN conv_id % 3 = 0 THEN 19e0 ELSE lat END AS lat, CASE WHEN conv_id % 3 = 0 THEN 'USER_GPS' WHEN lat IS NOT NULL THEN 'GAZETTEER' ELSE 'NONE' END AS geo_method, CASE WHEN conv_id % 3 = 0 THEN es[1] ELSE coalesce(place, es[1]) END AS raw_location FROM ms LEFT JOIN ht USING (message_id)",
    more=f"{GAZ}, {MESSAGES}",
)
def _(t):
    df = messages(t).withColumn("entities", T.match_patterns(F.col("text"), LANDMARKS))
    return T.geocode_requests(df, places(t), "message_id").select("message_id", "lat", "geo_method", "raw_location")


@query(
    "txt12_headline",
    "SELECT conv_id, turn, upper(role[1]) || lower(role[2:]) || CASE WHEN len(i) > 0 THEN ' — the' ELSE '' END || CASE WHEN len(w) = 0 THEN '' WHEN len(w) = 1 OR w[1] = w[2] THEN ' at ' || w[1] ELSE ' at ' || w[1] || ', ' || w[2] END || CASE WHEN len(o) > 0 THEN ' (of the)' ELSE '' END AS headline "
    "FROM (SELECT *, regexp_extract_all(text, '\\bthe\\b') AS i, regexp_extract_all(text, '\\b[A-Z][a-z]+ing\\b') AS w, regexp_extract_all(text, '\\bof the\\b') AS o FROM conversations)",
)
def _(t):
    return t.conversations.select("conv_id", "turn", T.headline(F.col("role"), T.match_patterns(F.col("text"), TERMS)).alias("headline"))


@query("txt13_textrank")
def _(t):
    s = T.split_sentences(t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text")))
    return S.textrank(s.where(T.word_count(F.col("sentence")) >= 3), "conv_id", "position", "sentence")


ENT = "en AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ing')) AS text FROM documents)"


def entities(t):
    return t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+ing)"), F.lit(1))).alias("text"), F.lit("LOCATION").alias("label"))


def top_sql(table, k):
    return f"SELECT source, lang, string_agg(place, ',' ORDER BY n DESC, place) AS places FROM (SELECT d.source, d.lang, x.text AS place, count(*) AS n FROM {table} x JOIN documents d USING (doc_id) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY d.source, d.lang ORDER BY count(*) DESC, x.text) <= {k}) GROUP BY 1, 2"


ISSUE_SQL = "iu AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]+(?:tion|keit|ment)'))) AS text FROM documents)"


def source_requests(t):
    return t.documents.select("doc_id", "source", "lang", "text", F.when(F.col("doc_id") % 3 == 0, "OPEN").otherwise("RESOLVED").alias("status"))


@query("txt14_group_summary", f"SELECT c.source, c.lang, count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS open, any_value(p.places) AS places, any_value(i.places) AS issues FROM documents c LEFT JOIN ({top_sql('en', 3)}) p ON p.source = c.source AND p.lang = c.lang LEFT JOIN ({top_sql('iu', 5)}) i ON i.source = c.source AND i.lang = c.lang GROUP BY 1, 2", more=f"{ENT}, {ISSUE_SQL}")
def _(t):
    issues = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+(?:tion|keit|ment))"), F.lit(1))).alias("issue"))
    return T.group_summary(source_requests(t), entities(t).select("doc_id", F.col("text").alias("place")), ["source", "lang"], "doc_id", issues)


@query("txt14_representative_texts")
def _(t):
    return T.representative_texts(source_requests(t), ["source", "lang"], "doc_id")


@query("txt15_analyze_documents")
def _(t):
    sector = lambda body: F.when(body.rlike(r"(?i)\bthe\b"), "Water Supply").when(body.rlike(r"(?i)\bder\b"), "Roads").otherwise("Other")
    found = T.analyze_documents(t.documents.select("doc_id", "text"), "doc_id", sector, places(t), patterns=TERMS)
    rows = lambda kind, name, value: found[kind].select("doc_id", F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
    each = [rows("sections", "summary", "words"), rows("shares", "sector", "share"), rows("summary", "sentence", "score"), rows("entities", "text", "n"), rows("mentions", "ward_code", "mentions")]
    return reduce(DataFrame.unionByName, each)


@query("txt16_enrich_requests")
def _(t):
    classifier, (projection, idf, _) = fitted(t, "classifier"), fitted(t, "embedding")
    out = T.enrich_requests(messages(t), places(t), "message_id", WORDS, ["आहे"], ["है"], GLOSSES, TERMS, classifier, (projection, idf))
    return out.select("message_id", "text", "language.code", "category", "category_confidence", F.size("entities").alias("entities"), "headline", "lat", "lng", "geo_method", "geo_confidence", "raw_location", "embedding")


@query("agg17_entity_frequency", "SELECT lower(text) AS text, 'LOCATION' AS label, count(*) AS n FROM en GROUP BY 1 ORDER BY n DESC, 1 LIMIT 60", more=ENT)
def _(t):
    return T.entity_frequency(entities(t))


@query("agg18_region_mentions", "SELECT n_name AS ward_code, count(*) AS mentions FROM (SELECT n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey) GROUP BY 1")
def _(t):
    ents = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("ward_code"))
    return T.region_mentions(ents, t.nation.select(F.col("n_name").alias("ward_code")))


@query("agg19_sector_shares", "SELECT lang AS sector, source, round(100.0 * sum(n_chars) / any_value(t), 1) AS share FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source) AS t FROM documents) GROUP BY 1, 2")
def _(t):
    return T.sector_shares(t.documents.select("source", F.col("lang").alias("sector"), F.col("n_chars").alias("words")), "source")


# learning

BINARY = ["quality", "toxic"]


def labelled(t):
    return L.training_table(t.documents.select("doc_id", "text"), t.labels, "doc_id", BINARY)


FITTED: dict[tuple[str, str, str], tuple] = {}


def fitted(t, kind: str):
    """The classifier or the embedding of a folder's tables, fitted once in a session."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, kind)
    if key not in FITTED:
        FITTED[key] = L.fit_text_classifier(labelled(t), "text", BINARY) if kind == "classifier" else L.fit_embeddings(t.documents, "doc_id", "text")
    return FITTED[key]


@query("ml1_fit_text_classifier")
def _(t):
    models, _ = fitted(t, "classifier")
    each = [(n, m.intercept, int(i), float(m.coefficients[i])) for n, m in models.items() for i in np.flatnonzero(m.coefficients)]
    return t.spark.createDataFrame(pd.DataFrame(each, columns=["label", "intercept", "feature", "weight"]))


@query("ml2_predict_labels")
def _(t):
    models, idf = fitted(t, "classifier")
    return L.predict_labels(t.documents.select("doc_id", "text"), "text", models, idf).select("doc_id", F.array_join("labels", ",").alias("labels"))


@query(
    "ml3_multilabel_metrics",
    "SELECT round(1.0 * sum(tp) / sum(tp + fp), 4) AS precision, round(1.0 * sum(tp) / sum(tp + fn), 4) AS recall, round(2.0 * sum(tp) / sum(2 * tp + fp + fn), 4) AS micro_f1, round(avg(2.0 * tp / (2 * tp + fp + fn)), 4) AS macro_f1 FROM (SELECT label, count(*) FILTER (t AND p) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM (SELECT 'q' AS label, quality = 1 AS t, doc_id % 3 > 0 AS p FROM labels UNION ALL SELECT 't', toxic = 1, doc_id % 5 = 0 FROM labels) GROUP BY 1)",
)
def _(t):
    k, arr = F.col("doc_id"), lambda a, b: F.filter(F.array(F.when(a, "q"), F.when(b, "t")), lambda x: x.isNotNull())
    pairs = t.labels.select("doc_id", arr(F.col("quality") == 1, F.col("toxic") == 1).alias("truth"), arr(k % 3 > 0, k % 5 == 0).alias("pred"))
    return L.multilabel_metrics(pairs, "doc_id", "truth", "pred")


@query("ml4_stratified_split", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= round(count(*) OVER (PARTITION BY lang) * 0.2e0) AS is_test FROM documents")
def _(t):
    return L.stratified_split(t.documents.select("doc_id", "lang"), "lang", "doc_id")


@query("ml5_fit_embeddings")
def _(t):
    projection, _, share = fitted(t, "embedding")
    rows = pd.DataFrame({"feature": range(len(projection)), "vector": projection.tolist(), "explained": share})
    return t.spark.createDataFrame(rows, "feature int, vector array<double>, explained double")


@query("ml6_encode")
def _(t):
    projection, idf, _ = fitted(t, "embedding")
    return L.encode(t.documents.select("doc_id", "text"), "text", projection, idf).select("doc_id", "embedding")


E_SIM = "SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS DOUBLE) AS s FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q CROSS JOIN embeddings v"


@query("ml7_semantic_search", f"SELECT query_id, vec_id, round(s, 4) + 0.0 AS similarity FROM ({E_SIM}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10")
def _(t):
    e = t.embeddings
    return L.semantic_search(e.where("vec_id % 20 = 0"), e, 10).withColumn("similarity", F.round("similarity", 4) + 0.0)


TWINS = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT -1 - vec_id, list_transform(embedding, lambda x, i: x::DOUBLE + 1e-3 * ((vec_id + i) % 50)) FROM embeddings)"


@query("ml8_near_duplicates", f"{TWINS} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 5) AS similarity FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.96")
def _(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    moved = F.transform("embedding", lambda x, i: x + 0.001 * ((F.col("vec_id") + i + 1) % 50))
    twins = e.unionByName(e.withColumn("embedding", moved).withColumn("vec_id", -1 - F.col("vec_id")))
    return L.near_duplicates(twins, 0.96).withColumn("similarity", F.round("similarity", 5))


@query("ml9_training_table", "SELECT d.doc_id, array_to_string(list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS labels FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    return labelled(t).select("doc_id", F.array_join("labels", ",").alias("labels"))


@query("ml10_model_log", "SELECT event_id AS run_id, event_type AS name, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1 THEN 'ACTIVE' ELSE 'ARCHIVED' END AS status FROM events")
def _(t):
    return L.model_log(t.events.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("name"), F.col("ts").alias("trained_at"))).select("run_id", "name", "status")


# quality

ROWS = "rw AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN ' ' ELSE event_type END AS kind, user_id % 40 AS u, CASE WHEN event_id % 7 = 0 THEN 5e0 ELSE 19e0 END AS lat, 72.9e0 AS lng FROM events), fl AS (SELECT *, trim(kind) = '' AS is_missing, trim(kind) <> '' AND row_number() OVER (PARTITION BY kind, u, lat, lng ORDER BY kind) > 1 AS is_duplicate FROM rw)"


def flagged(t):
    i = F.col("event_id")
    rows = t.events.select(F.when(i % 10 == 0, " ").otherwise(F.col("event_type")).alias("kind"), (F.col("user_id") % 40).alias("u"), F.when(i % 7 == 0, 5.0).otherwise(19.0).alias("lat"), F.lit(72.9).alias("lng"))
    return D.split_valid(rows, ["kind"], F.col("kind"))


@query("dq1_check_columns", "SELECT count(*) AS n FROM events")
def _(t):
    return D.check_columns(t.events, ["event_id", "ts"]).agg(F.count("*").alias("n"))


@query("dq2_split_valid", "SELECT is_missing, is_duplicate, NOT is_missing AND NOT is_duplicate AND lat < 18 AS bad_location, count(*) AS n FROM fl GROUP BY 1, 2, 3", more=ROWS)
def _(t):
    return flagged(t).groupBy("is_missing", "is_duplicate", "bad_location").agg(F.count("*").alias("n"))


@query(
    "dq3_import_assets",
    f"SELECT r.asset_id, l.ward_id, l.ward_id IS NOT NULL AS is_valid FROM (SELECT p_partkey AS asset_id, 18.86 + 0.0113 * (p_partkey % 39) AS lat, 72.60 + 0.0171 * (p_partkey % 41) AS lng FROM part WHERE p_partkey % 9 > 0) r LEFT JOIN (SELECT r.asset_id, min(w.ward_id) AS ward_id FROM (SELECT p_partkey AS asset_id, 18.86 + 0.0113 * (p_partkey % 39) AS lat, 72.60 + 0.0171 * (p_partkey % 41) AS lng FROM part) r JOIN wards w ON {INSIDE} GROUP BY 1) l USING (asset_id)",
    "wards",
)
def _(t):
    k = F.col("p_partkey")
    rows = t.part.select(k.alias("asset_id"), F.when(k % 9 > 0, 18.86 + 0.0113 * (k % 39)).alias("lat"), (72.60 + 0.0171 * (k % 41)).alias("lng"))
    return D.import_assets(rows, shapes(t)).where("lng > 0").select("asset_id", "ward_id", "is_valid")


@query("dq4_import_requests")
def _(t):
    c = F.col("conv_id")
    rows = t.conversations.select(F.col("text").alias("text"), F.col("role").alias("category"), F.col("role").alias("status"), F.concat(F.lit("W"), c % 5).alias("ward_code"), F.when(c % 3 == 0, 18.86 + 0.0113 * (c % 39)).alias("lat"), F.when(c % 3 == 0, 72.76 + 0.0071 * (c % 41)).alias("lng"))
    codes = t.nation.select(F.concat(F.lit("W"), F.col("n_nationkey")).alias("ward_code"), F.col("n_nationkey").cast("int").alias("ward_id"))
    x = D.import_requests(rows, shapes(t), places(t).drop("ward_code"), codes, mixed_terms=WORDS, second=["आहे"], first=["है"], lexicon=GLOSSES, patterns=TERMS)
    return x.select("request_id", "text", "status", "ward_id", "geo_method", "headline", "language.code")


@query("dq5_import_quality", "SELECT count(*) AS total, count(*) FILTER (is_missing) AS missing, count(*) FILTER (is_duplicate) AS duplicates, count(*) FILTER (NOT is_missing AND NOT is_duplicate AND lat < 18) AS bad_locations, round(0.4 * (1 - count(*) FILTER (is_missing) / count(*)) + 0.3 * (1 - count(*) FILTER (NOT is_missing AND NOT is_duplicate AND lat < 18) / count(*)) + 0.3 * (1 - count(*) FILTER (is_duplicate) / count(*)), 4) AS score FROM fl", more=ROWS)
def _(t):
    return D.import_quality(flagged(t))


@query("dq6_catalogue_quality", "SELECT c_custkey, round(0.35e0 * 0.9e0 + 0.25e0 * 0.8e0 + 0.15e0 * ((c_custkey % 10) / 10.0) + 0.15e0 * 0.7e0 + 0.1e0 * greatest(0.0, 1 - (c_custkey % 5000) / 3650.0), 3) AS quality FROM customer")
def _(t):
    k = F.col("c_custkey")
    return D.catalogue_quality(t.customer, F.lit(0.9), F.lit(0.8), (k % 10) / 10, F.lit(0.7), k % 5000).select("c_custkey", "quality")


@query("dq7_source_listing", "SELECT s.c_custkey AS source_id, r.score FROM customer s LEFT JOIN (SELECT o_custkey, o_totalprice AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) r ON r.o_custkey = s.c_custkey")
def _(t):
    rep = t.orders.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("score"))
    return D.source_listing(t.customer.select(F.col("c_custkey").alias("source_id")), rep).select("source_id", "score")


@query("dq8_total_check", "SELECT CAST(sum(population) AS BIGINT) AS total, 20000000 AS official, CAST(sum(population) - 20000000 AS BIGINT) AS difference FROM wards", "wards")
def _(t):
    return D.total_check(t.wards, "population", 20_000_000)


# sources: files derived from the given tables, in the folder that the cluster shares


def scratch(t) -> str:
    from placestat.operators.graph import ensure_checkpoint_dir

    ensure_checkpoint_dir(t.spark)
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@query("src1_read_csv_records", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def _(t):
    p = scratch(t)
    RD.write_csv(t.supplier.select("s_suppkey", "s_name"), p)
    return RD.read_csv_records(t.spark, p)


@query("src2_read_geojson_points", "SELECT n_name AS name, n_nationkey * 0.5 AS lng, 19.0::DOUBLE AS lat FROM nation")
def _(t):
    p = scratch(t)
    f = t.nation.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("name")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.col("n_nationkey") * 0.5, F.lit(19.0)).alias("coordinates")).alias("geometry"))).alias("feature"))
    RD.feature_collection(f).coalesce(1).write.text(p)
    return RD.read_geojson_points(t.spark, p, "name: string")


@query("src3_read_keyed_json", "SELECT n_name AS key, n_regionkey AS region FROM nation")
def _(t):
    p = scratch(t)
    o = t.nation.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.col("n_regionkey").alias("region")))))).alias("value"))
    o.coalesce(1).write.text(p)
    return RD.read_keyed_json(t.spark, p, "region int")


@query(
    "src4_flatten_epochs",
    "SELECT year, ward_code, round(mean_ndvi, 6) AS mean_ndvi, cloud FROM (SELECT year, NULL AS ward_code, avg(mean_ndvi) AS mean_ndvi, 1.5::DOUBLE AS cloud FROM satellite GROUP BY 1 UNION ALL SELECT year, ward_id::VARCHAR, mean_ndvi, 1.5 FROM satellite WHERE ward_id % 5 > 0)",
    "satellite",
)
def _(t):
    v = F.struct(F.when(F.col("ward_id") % 5 > 0, F.col("mean_ndvi")).alias("mean_ndvi"))
    nested = t.satellite.groupBy("year").agg(F.struct(F.avg("mean_ndvi").alias("mean_ndvi")).alias("city"), F.map_from_entries(F.collect_list(F.struct(F.col("ward_id").cast("string"), v))).alias("wards"))
    nested = nested.withColumn("scenes", F.array(F.struct(F.lit(1.0).alias("cloud")), F.struct(F.lit(2.0).alias("cloud"))))
    return RD.flatten_epochs(nested).withColumn("mean_ndvi", F.round("mean_ndvi", 6))


@query("src5_table_store", "SELECT c_custkey, c_name FROM customer")
def _(t):
    store = RD.TableStore(t.spark, scratch(t))
    c = t.customer.select("c_custkey", "c_name")
    store.write(c, "customer")
    return store.read("customer", c.schema)


@query("src6_replace_table", "SELECT count(*) AS n FROM supplier")
def _(t):
    store = RD.TableStore(t.spark, scratch(t))
    store.replace_table(t.customer.select(F.col("c_custkey").alias("id")), "x")
    store.replace_table(t.supplier.select(F.col("s_suppkey").alias("id")), "x")
    return store.read("x").agg(F.count("*").alias("n"))


@query("src7_replace_partition", "SELECT metric, count(*) AS n FROM service WHERE metric <> 'water_demand_mld' OR ward_id < 5 GROUP BY 1", "service")
def _(t):
    store = RD.TableStore(t.spark, scratch(t))
    store.replace_partition(t.service, "s", "metric")
    store.replace_partition(t.service.where("metric = 'water_demand_mld' AND ward_id < 5"), "s", "metric")
    return store.read("s").groupBy("metric").agg(F.count("*").alias("n"))


@query("src8_write_csv", "SELECT count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer")
def _(t):
    p = scratch(t)
    RD.write_csv(t.customer, p)
    return RD.read_csv_records(t.spark, p).agg(F.count("*").alias("n"), F.sum(F.col("c_custkey").cast("long")).alias("total"))


@query("src9_to_feature_collection", "SELECT ward_id, population, west FROM wards", "wards")
def _(t):
    f = RD.to_feature_collection(t.wards.withColumn("rings", G.rectangle(F.col("south"), F.col("west"), 0.09, 0.06)), ["ward_id", "population"])
    j = F.from_json("feature", "properties struct<ward_id: int, population: bigint>, geometry struct<coordinates: array<array<array<double>>>>")
    return f.select(j.alias("j")).select("j.properties.ward_id", "j.properties.population", F.col("j.geometry.coordinates")[0][0][0].alias("west"))


@query("src10_read_text_documents", "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM benchmark")
def _(t):
    p = scratch(t)
    t.benchmark.select(F.concat_ws("", F.lit("item="), "item_id").alias("k"), F.regexp_replace("text", "\n", " ").alias("value")).write.partitionBy("k").text(p)
    d = RD.read_text_documents(t.spark, f"{p}/*")
    return d.select(F.regexp_replace("text", "\n$", "").alias("x")).agg(F.count("*").alias("n"), F.sum(F.length("x")).alias("chars"))


# streams: the events table replayed


def event_stream(t):
    p = scratch(t)
    t.events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.parquet(p)
    return ST.read_event_stream(t.spark, p)


@query("str1_stream_enrich", f"SELECT r.request_id, min(w.ward_id) AS ward_id FROM (SELECT event_id AS request_id, 18.86 + 0.0113 * (event_id % 39) AS lat, 72.76 + 0.0071 * (event_id % 41) AS lng FROM events) r JOIN wards w ON {INSIDE} GROUP BY 1", "wards")
def _(t):
    i = F.col("event_id")
    e = event_stream(t).select(i.alias("request_id"), F.col("event_type").alias("text"), (18.86 + 0.0113 * (i % 39)).alias("lat"), (72.76 + 0.0071 * (i % 41)).alias("lng"))
    out = ST.stream_enrich(e, shapes(t))
    p = scratch(t)
    q = out.writeStream.format("parquet").option("path", p).option("checkpointLocation", scratch(t)).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(p).select("request_id", "ward_id")


@query("str2_stream_volume", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    p, s = scratch(t), ST.stream_volume(event_stream(t), delay="400 days")
    box: list = []
    q = s.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{p}/{i}") or box.append(i)).option("checkpointLocation", scratch(t)).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(f"{p}/{max(box)}").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("str3_stream_latest_status", "SELECT user_id AS request_id, max_by(CASE event_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'RESOLVED' ELSE 'CLOSED' END, ts::VARCHAR || lpad(event_id::VARCHAR, 9, '0')) AS status FROM events GROUP BY 1")
def _(t):
    st = F.element_at(F.array(*map(F.lit, ("OPEN", "IN_PROGRESS", "RESOLVED", "CLOSED"))), (F.col("event_id") % 4 + 1).cast("int"))
    c = event_stream(t).select(F.col("user_id").alias("request_id"), st.alias("status"), "ts", "event_id")
    p = scratch(t)
    q = ST.stream_latest_status(c, p, scratch(t))
    q.awaitTermination()
    return ST.read_latest_status(t.spark, p).select("request_id", "status")


# remaining reports


@query("rep1_overview", "SELECT count(*) AS total, count(*) FILTER (status = 'OPEN') AS open, round(median(resolution_days), 1) AS median_days, count(DISTINCT strftime(created_at, '%Y-%m')) AS months, count(DISTINCT category) AS categories FROM cases", "cases")
def _(t):
    c = t.cases
    one = c.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "OPEN").alias("open"), F.countDistinct("category").alias("categories"))
    return one.crossJoin(A.median_resolution_days(c)).crossJoin(A.distinct_months(c))


@query("rep8_asset_listing", "SELECT asset_id, name FROM assets WHERE asset_type = 'PARKS' AND ward_id >= 3", "assets")
def _(t):
    return t.assets.where("asset_type = 'PARKS' AND ward_id >= 3").select("asset_id", "name")


@query("rep9_activity_log", "SELECT e.event_id, c.c_name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(t):
    e = t.events.where("event_type = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return e.join(t.customer, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "c_name")


@query("rep10_citation", "SELECT 'requests' AS dataset, request_id AS record_id FROM requests WHERE category = 'click' ORDER BY request_id LIMIT 50", "requests")
def _(t):
    return t.requests.where("category = 'click'").orderBy("request_id").limit(50).select(F.lit("requests").alias("dataset"), F.col("request_id").alias("record_id"))


@query("rep11_newest_first", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def _(t):
    return R.page(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 200, 0).select("o_orderkey")


@query("rep12_by_id", "SELECT * FROM customer WHERE c_custkey = 77")
def _(t):
    return t.customer.where("c_custkey = 77")


