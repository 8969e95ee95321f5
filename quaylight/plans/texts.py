"""Term statistics, retrieval and pair similarity over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stem
from ..functions import text as X
from ..operators import classify as C
from ..operators import relational as R
from ..operators import textsearch as TS
from ..operators.words import letter_counts, term_postings
from ..sources.io import kept, spread, table
from .registry import query

_stop = ", ".join(f"'{w}'" for w in X.STOP)
_clean = "trim(regexp_replace(lower({}), '[^a-z]+', ' ', 'g'))"
_tok = f"SELECT doc_id, lang, source, unnest(string_split({_clean.format('text')}, ' ')) AS term FROM documents"
#: Terms of the documents; queries of a search are the ids that 20 divides.
_post = f"SELECT doc_id, lang, source, term, count(*) AS tf FROM ({_tok}) WHERE length(term) > 1 AND term NOT IN ({_stop}) GROUP BY 1, 2, 3, 4"
_df = "SELECT term, count(*) AS df FROM post GROUP BY 1"
_base = f"post AS MATERIALIZED ({_post}), n AS (SELECT count(*) AS n FROM documents), idf AS MATERIALIZED (SELECT term, df, ln((n + 1) / (df + 1)) AS idf FROM ({_df}), n)"
_w = f"{_base}, w AS MATERIALIZED (SELECT p.doc_id, p.lang, p.term, p.tf, i.idf, ln(p.tf + 1) * i.idf AS w FROM post p JOIN idf i USING (term))"
_mlt = f"""{_w}, h AS (SELECT * FROM (SELECT doc_id AS query, lang AS ql, term, tf, w AS qw, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS k FROM w WHERE doc_id % 20 = 0) WHERE k <= 10),
    s AS (SELECT h.query, w.doc_id, round(sum(h.qw * w.w), 6) AS score FROM h JOIN w ON w.term = h.term AND w.lang = h.ql AND w.doc_id <> h.query GROUP BY 1, 2),
    m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20)"""


def docs(spark, sf):
    return table(spark, sf, "documents")


def spread_texts(spark, sf):
    return spread(docs(spark, sf).select("doc_id", "lang", "text"))


def post(spark, sf):
    return term_postings(docs(spark, sf), "doc_id", F.col("text"))


def base(spark, sf):
    """(postings with the language, idf table) of the documents; each is made once."""
    p = kept(term_postings(docs(spark, sf), "doc_id", F.col("text"), ("lang",)), "postings")
    return p, kept(TS.with_idf(TS.frequencies(p), docs(spark, sf), "a"), "idf")


def similar(spark, sf, p, i, k=20):
    """The k documents most like each query, in its language."""
    return retrieved(spark, sf, p, heaviest(spark, sf, p, i), k)


def heaviest(spark, sf, p, i):
    """The ten heaviest terms of each query."""
    return TS.heaviest(p, i, docs(spark, sf).where("doc_id % 20 = 0").select("doc_id"), "doc_id", 10, ("lang",))


def retrieved(spark, sf, p, heavy, k=20):
    return TS.retrieved(p, heavy, "doc_id", k, ("lang",), docs(spark, sf).count())


@query("term_frequency", f"WITH post AS ({_post}) SELECT doc_id, term, tf FROM post")
def term_frequency(spark, sf):
    """AGG18 STR1 STR7 STR8 TXT1 ARR1 ARR6"""
    return post(spark, sf)


@query("doc_freq_idf", f"WITH {_base}, v AS (SELECT count(*) AS v FROM idf) SELECT term, df, round(ln((n + 1) / (df + 1)), 6) AS idf_a, round(ln(n / (df + 1)), 6) AS idf_b, round(ln(n / df), 6) AS idf_c, round(ln((v + 1) / (df + 1)), 6) AS idf_d FROM idf, n, v WHERE df > 2")
def doc_freq_idf(spark, sf):
    """AGG15-17 TXT2 FLT15 MTH1"""
    p = post(spark, sf)
    all_terms = TS.frequencies(p)
    counts = docs(spark, sf).agg(F.count("*").alias("n")).join(all_terms.agg(F.count("*").alias("v")))
    c = lambda k: F.round(TS.idf(k, F.col("df"), F.col("n"), F.col("v")), 6).alias(f"idf_{k}")
    return all_terms.where("df > 2").join(F.broadcast(counts)).select("term", "df", *map(c, "abcd"))


@query("tfidf_topterms", f"WITH {_w} SELECT doc_id, term, round(w, 6) AS w, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS rank FROM w) WHERE rank <= 10")
def tfidf_topterms(spark, sf):
    """TXT3 TXT5 TXT6 SRT6"""
    p, i = base(spark, sf)
    return R.top_k(TS.tfidf(p, i, "doc_id"), ["doc_id"], [F.desc("w"), F.asc("term")], 10).select("doc_id", "term", F.round("w", 6).alias("w"), "rank")


@query("group_keywords", f"WITH {_base}, g AS (SELECT p.source, p.term, round(sum(p.tf * i.idf), 6) AS w FROM post p JOIN idf i USING (term) GROUP BY 1, 2) SELECT source, term, w, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, term) AS rank FROM g) WHERE rank <= 10")
def group_keywords(spark, sf):
    """AGG26 TXT4: each source's ten heaviest terms."""
    p, i = base(spark, sf)
    w = TS.tfidf(p, i, "doc_id", damped=False).join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    g = w.groupBy("source", "term").agg(F.round(F.sum("w"), 6).alias("w"))
    return R.top_k(g, ["source"], [F.desc("w"), F.asc("term")], 10)


@query(
    "document_keywords",
    f"""
    WITH post AS ({_post}), n AS (SELECT count(*) AS n FROM documents), t AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM post, n GROUP BY term, n HAVING count(*) >= n * 0.01 AND count(*) <= n * 0.95),
    l AS (SELECT doc_id FROM post GROUP BY 1 HAVING sum(tf) > 50), r AS (SELECT p.doc_id, p.term, p.tf * t.idf AS raw FROM post p JOIN t USING (term) WHERE p.doc_id IN (SELECT doc_id FROM l)), w AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM r)
    SELECT doc_id, term, round(w, 3) AS w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS k FROM w) WHERE k <= 10
    """,
)
def document_keywords(spark, sf):
    """TXT19 TXT20 SRT6"""
    w = TS.keyword_weights(post(spark, sf), "doc_id", docs(spark, sf))
    return R.top_k(w, ["doc_id"], [F.round("w", 9).desc(), F.asc("term")], 10).select("doc_id", "term", F.round("w", 3).alias("w"))


@query(
    "country_term_lift",
    f"""
    WITH post AS ({_post}), d AS (SELECT lang, count(*) AS nd FROM documents GROUP BY 1), a AS (SELECT count(*) AS n FROM documents), t AS (SELECT term, count(*) AS df FROM post GROUP BY 1 HAVING count(*) > 15), l AS (SELECT lang, term, count(*) AS c FROM post GROUP BY 1, 2)
    SELECT l.lang, l.term, l.c, round((l.c / d.nd) / (t.df / a.n), 6) AS lift FROM l JOIN t USING (term) JOIN d USING (lang), a
    """,
)
def country_term_lift(spark, sf):
    """AGG25: P(term | lang) / P(term)"""
    d = docs(spark, sf)
    p = post(spark, sf).join(d.select("doc_id", "lang"), "doc_id")
    by = p.groupBy("lang", "term").agg(F.count("*").alias("c"))
    t = by.groupBy("term").agg(F.sum("c").alias("df")).where("df > 15")
    n = d.groupBy("lang").agg(F.count("*").alias("nd"))
    all_ = d.agg(F.count("*").alias("n"))
    return by.join(t, "term").join(F.broadcast(n), "lang").join(F.broadcast(all_)).select("lang", "term", "c", F.round((F.col("c") / F.col("nd")) / (F.col("df") / F.col("n")), 6).alias("lift"))


@query("corpus_token_counts", f"WITH post AS ({_post}) SELECT term, sum(tf)::BIGINT AS n, count(*) AS docs FROM post GROUP BY 1 HAVING sum(tf) > 5 AND count(*) > 5")
def corpus_token_counts(spark, sf):
    """AGG39 SRT4"""
    return post(spark, sf).groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("docs")).where("n > 5 AND docs > 5")


@query("vocabulary_ids", f"WITH post AS ({_post}) SELECT term, row_number() OVER (ORDER BY term) - 1 AS word_id FROM (SELECT term FROM post GROUP BY 1 HAVING count(*) > 20)")
def vocabulary_ids(spark, sf):
    """AGG23 SNK5: 0-based ids of the vocabulary in sorted order; numbered within
    two-letter beginnings first, of which there are few."""
    v = TS.frequencies(post(spark, sf), 20).withColumn("head", F.substring("term", 1, 2))
    from pyspark.sql import window as W

    before = W.Window.orderBy("head").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = v.groupBy("head").agg(F.count("*").alias("n")).select("head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(W.Window.partitionBy("head").orderBy("term"))
    return v.withColumn("own", own).join(F.broadcast(starts), "head").select("term", (F.col("start") + F.col("own") - 1).cast("long").alias("word_id"))


@query("ngram_counts", f"WITH t AS (SELECT doc_id, string_split({_clean.format('text')}, ' ') AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t) SELECT gram, count(*) AS n FROM g GROUP BY 1")
def ngram_counts(spark, sf):
    """STR10 STR11 STR12 STR13 SRT5"""
    counts = TS.shingle_counts(spread_texts(spark, sf).select("doc_id", F.split(X.clean_text(F.col("text")), " ").alias("w")), "doc_id", "w", (2,))
    return counts.select(F.col("shingle").alias("gram"), F.col("times").alias("n"))


@query("more_like_this", f"WITH {_mlt} SELECT query, doc_id, score, rank FROM m")
def more_like_this(spark, sf):
    """TXT15 TXT28 FLT16 FLT17 FLT22 SRC13 SRT8"""
    return similar(spark, sf, *base(spark, sf))


_terms = """t AS MATERIALIZED (SELECT m.query, m.doc_id, x.term, x.idf, max(x.in_a) AS in_a, max(x.in_b) AS in_b FROM m, LATERAL (SELECT w.term, w.idf, 1 AS in_a, 0 AS in_b FROM w WHERE w.doc_id = m.query UNION ALL SELECT w.term, w.idf, 0, 1 FROM w WHERE w.doc_id = m.doc_id) x GROUP BY 1, 2, 3, 4)"""


@query(
    "pair_similarity",
    f"""
    WITH {_mlt}, {_terms}
    SELECT query, doc_id, round(coalesce(sum(idf * idf * in_a * in_b) / nullif(sqrt(sum(idf * idf * in_a)) * sqrt(sum(idf * idf * in_b)), 0), 0), 6) AS cosine, round(sum(in_a * in_b) / count(*), 6) AS jaccard,
           round(sum(idf * in_a * in_b) / nullif(sum(idf), 0), 6) AS idf_jaccard, round(coalesce(avg(CASE WHEN in_a + in_b = 1 THEN idf END), 0), 6) AS symdiff_idf FROM t GROUP BY 1, 2
    """,
)
def pair_similarity(spark, sf):
    """TXT7-11 SET4 RNK1: of each query and the documents most like it."""
    p, i = base(spark, sf)
    return TS.pair_similarity(_terms_of(similar(spark, sf, p, i), p, i), "query", "peer").withColumnRenamed("peer", "doc_id")


def _terms_of(found, p, i):
    """Terms of either side of each query and document found."""
    pairs = kept(found.select("query", F.col("doc_id").alias("peer")), "pairs")
    return TS.pair_terms(pairs, p, i, "query", "peer", "doc_id")


@query(
    "peer_only_idf",
    f"""
    WITH {_mlt}, {_terms}, p AS (SELECT query, doc_id, term, idf, row_number() OVER (PARTITION BY query, doc_id ORDER BY idf DESC, term) AS k, count(*) OVER (PARTITION BY query, doc_id) AS n FROM t WHERE in_a = 0 AND in_b = 1)
    SELECT query, doc_id, round(sum(idf) / nullif(least(max(n), max(idf)), 0), 6) AS peer_only_idf, round(avg(idf), 6) AS peer_only_mean FROM p WHERE k <= 10 GROUP BY 1, 2
    """,
)
def peer_only_idf(spark, sf):
    """TXT12"""
    p, i = base(spark, sf)
    return TS.peer_only(_terms_of(similar(spark, sf, p, i), p, i), "query", "peer").withColumnRenamed("peer", "doc_id")


_negative = f"""{_mlt}, theirs AS (SELECT DISTINCT m.query, w.term FROM m JOIN w ON w.doc_id = m.doc_id), both_ AS (SELECT t.query, t.term, w.idf FROM theirs t JOIN w ON w.doc_id = t.query AND w.term = t.term),
    neg AS (SELECT query, term, idf, row_number() OVER (PARTITION BY query ORDER BY idf DESC, term) AS front, row_number() OVER (PARTITION BY query ORDER BY idf, term DESC) AS tail FROM both_ QUALIFY front <= 15 OR tail <= 30)"""


@query("negative_words", f"WITH {_negative} SELECT query, term, round(idf, 6) AS idf, front, tail FROM neg")
def negative_words(spark, sf):
    """TXT14 SRT7"""
    p, i = base(spark, sf)
    ids = TS.numbered(i)
    return TS.negative_words(_terms_of(similar(spark, sf, p, i), p, ids), ids, "query").withColumn("idf", F.round("idf", 6))


@query(
    "jaccard_without_negative",
    f"""
    WITH {_negative}, {_terms}
    SELECT t.query, t.doc_id, round(sum(CASE WHEN n.term IS NULL THEN t.idf * in_a * in_b ELSE 0 END) / nullif(sum(t.idf), 0), 6) AS idf_jaccard, round(sum(CASE WHEN coalesce(n.tail, 99) > 10 THEN t.idf * in_a * in_b ELSE 0 END) / nullif(sum(t.idf), 0), 6) AS idf_jaccard_last
    FROM t LEFT JOIN neg n ON n.query = t.query AND n.term = t.term GROUP BY 1, 2
    """,
)
def jaccard_without_negative(spark, sf):
    """TXT13: idf Jaccard without negative words, and without the last ten of them."""
    p, i = base(spark, sf)
    return TS.jaccard_without_negative(_terms_of(similar(spark, sf, p, i), p, i), "query", "peer").withColumnRenamed("peer", "doc_id")


_words = "SELECT p_partkey, unnest(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> ''))) AS w FROM part"


@query(
    "fuzzy_name",
    f"""
    WITH n AS ({_words}), q AS (SELECT p_partkey AS query, w FROM n WHERE p_partkey % 20 = 0), e AS (SELECT a.w AS qw, b.w AS hw, levenshtein(a.w, b.w) AS e FROM (SELECT DISTINCT w FROM q) a JOIN (SELECT DISTINCT w FROM n) b ON a.w[1] = b.w[1] AND levenshtein(a.w, b.w) <= 2),
    s AS (SELECT query, hit, sum(p)::BIGINT AS score FROM (SELECT q.query, n.p_partkey AS hit, q.w, max(CASE e.e WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END) AS p FROM q JOIN e ON e.qw = q.w JOIN n ON n.w = e.hw GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT query, hit, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS rank FROM s QUALIFY rank <= 10
    """,
)
def fuzzy_name(spark, sf):
    """TXT17 STR2 STR4: parts whose names are like a query's."""
    p = table(spark, sf, "part")
    return TS.fuzzy_names(p.where("p_partkey % 20 = 0"), p, "p_partkey", "p_name")


@query(
    "similar_names",
    """
    WITH s AS (SELECT c_nationkey, c_name, lead(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_name) AS other FROM customer)
    SELECT c_name, other, levenshtein(lower(c_name), lower(other)) < 2 AS similar, round(list_sum(list_transform(range(1, least(length(c_name), length(other)) + 1), lambda i: (c_name[i] = other[i])::INT)) / least(length(c_name), length(other)), 6) AS positional FROM s WHERE other IS NOT NULL
    """,
)
def similar_names(spark, sf):
    """STR4 STR5 TXT18: neighbours in name order."""
    from pyspark.sql import window as W

    w = W.Window.partitionBy("c_nationkey").orderBy("c_name")
    s = table(spark, sf, "customer").select("c_nationkey", "c_name", F.lead("c_name").over(w).alias("other")).where("other IS NOT NULL")
    strip = lambda c: F.col(c)
    return s.select("c_name", "other", (F.levenshtein(F.lower("c_name"), F.lower("other")) < 2).alias("similar"), F.round(X.positional_match(strip("c_name"), strip("other")), 6).alias("positional"))


_sentences = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query("first_three_sentences", f"SELECT doc_id, array_to_string(({_sentences})[1:3], ' ') AS first_three, md5(replace(regexp_replace(array_to_string(list_filter({_sentences}, lambda x: NOT regexp_matches(x, '(?i)copyright|license')), ' '), '\\[source[^\\]]*\\]', '', 'g'), source, '')) AS kept_md5 FROM documents")
def first_three_sentences(spark, sf):
    """STR14 STR16 STR17: at most three sentences, and the text without the sentences of
    licenses, source notes and the source's name."""
    d = docs(spark, sf)
    kept = X.without_boilerplate(F.col("text"), "(?i)copyright|license", F.col("source"))
    return d.select("doc_id", X.first_sentences(F.col("text")).alias("first_three"), F.md5(kept).alias("kept_md5"))


_grams = "SELECT doc_id, unnest(list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] || c[i + 1] || c[i + 2])) AS term FROM (SELECT doc_id, string_split(lower(text), '') AS c FROM documents)"


@query(
    "detected_language",
    f"""
    WITH d AS (SELECT doc_id, lang, doc_id % 2 AS fold FROM documents), t AS MATERIALIZED (SELECT doc_id, lang, fold, term, count(*) AS tf FROM ({_grams}) JOIN d USING (doc_id) GROUP BY 1, 2, 3, 4),
    c AS MATERIALIZED (SELECT 1 - fold AS fold, lang, term, sum(tf) AS n FROM t WHERE lang IS NOT NULL GROUP BY 1, 2, 3), v AS (SELECT fold, count(DISTINCT term) AS v FROM c GROUP BY 1),
    k AS (SELECT fold, lang, docs, coalesce(words, 0) AS words, sum(docs) OVER (PARTITION BY fold) AS n FROM (SELECT 1 - fold AS fold, lang, count(*) AS docs FROM d WHERE lang IS NOT NULL GROUP BY 1, 2) LEFT JOIN (SELECT fold, lang, sum(n) AS words FROM c GROUP BY 1, 2) USING (fold, lang)),
    s AS (SELECT t.doc_id, k.lang, sum(t.tf * (ln(coalesce(c.n, 0) + 1) - ln(k.words + v.v))) AS s FROM t JOIN k ON k.fold = t.fold JOIN v ON v.fold = t.fold LEFT JOIN c ON c.fold = t.fold AND c.lang = k.lang AND c.term = t.term GROUP BY 1, 2),
    f AS (SELECT d.doc_id, d.lang, k.lang AS detected, ln(k.docs / k.n) + coalesce(s.s, 0) AS s FROM d JOIN k ON k.fold = d.fold LEFT JOIN s ON s.doc_id = d.doc_id AND s.lang = k.lang)
    SELECT lang, detected, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, detected) AS r FROM f) WHERE r = 1 GROUP BY 1, 2
    """,
)
def detected_language(spark, sf):
    """STR15: how often the language by profiles of three letters is that given. Each half of
    the documents is judged by profiles of the other, so none by one that it is part of."""
    d = docs(spark, sf).select("doc_id", "lang", (F.col("doc_id") % 2).alias("fold"))
    rows = spread_texts(spark, sf).withColumn("fold", F.col("doc_id") % 2)
    t = kept(letter_counts(rows, "doc_id", F.col("text"), 3, ("lang", "fold")), "letters")
    judged = None
    for fold in (0, 1):
        known, asked = (F.col("fold") != fold) & F.col("lang").isNotNull(), F.col("fold") == fold
        counts = kept(C.class_counts(t.where(known), "lang"), "profiles")
        found = C.posteriors(d.where(asked), t.where(asked).select("doc_id", "term", "tf"), counts, C.classes(d.where(known), counts, "lang"), "doc_id", "lang")
        best = R.top_k(found, ["doc_id"], [F.desc("p"), F.asc("lang")], 1).select("doc_id", F.col("lang").alias("detected"))
        judged = best if judged is None else judged.unionByName(best)
    return d.join(judged, "doc_id").groupBy("lang", "detected").agg(F.count("*").alias("n"))


@query("stem_counts")
def stem_counts(spark, sf):
    """STR9: document frequency of stems of the English documents."""
    d = docs(spark, sf).where("lang = 'en'")
    return d.select("doc_id", F.explode(F.array_distinct(stem.stems(X.terms(F.col("text"))))).alias("stem")).groupBy("stem").agg(F.count("*").alias("df"))


@query(
    "topic_smoothing_kl",
    f"""
    WITH post AS ({_post}), phi AS (SELECT source AS grp, term, sum(tf) / sum(sum(tf)) OVER (PARTITION BY source) AS phi FROM post GROUP BY 1, 2), tot AS (SELECT doc_id, source, sum(tf) AS t FROM post GROUP BY 1, 2), ps AS (SELECT grp, sum(phi) AS s FROM phi GROUP BY 1),
    p AS (SELECT post.doc_id, post.source AS grp, post.term, (post.tf + 10.0 * phi.phi) / (tot.t + 10.0 * ps.s) AS p, phi.phi AS q FROM post JOIN phi ON phi.grp = post.source AND phi.term = post.term JOIN tot USING (doc_id, source) JOIN ps ON ps.grp = post.source)
    SELECT doc_id, round(sum(p * ln(p / (q + 1e-9))), 4) AS kl FROM p GROUP BY 1
    """,
)
def topic_smoothing_kl(spark, sf):
    """TXT25-27 MAP1: distance of each document, smoothed by its source's words, from
    the source."""
    from pyspark.sql import window as W

    rows = docs(spark, sf).select("doc_id", F.col("source").alias("grp"), "text")
    p = kept(term_postings(rows, "doc_id", F.col("text"), ("grp",)), "postings")  # read three times
    phi = p.groupBy("grp", "term").agg(F.sum("tf").alias("n")).withColumn("phi", F.col("n") / F.sum("n").over(W.Window.partitionBy("grp"))).drop("n")
    own = TS.smoothed(p, "doc_id", phi, 10.0)
    both = own.join(phi.withColumnRenamed("phi", "q"), ["grp", "term"])
    return both.groupBy("doc_id").agg(F.round(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("q") + 1e-9))), 4).alias("kl"))


@query("cleaned_keywords", f"SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 1), ' ') AS kw, lower(p_name) LIKE '%steel%' AS steel FROM part")
def cleaned_keywords(spark, sf):
    """STR6 STR14 STR20"""
    return table(spark, sf, "part").select("p_partkey", X.clean_keyword(F.col("p_name")).alias("kw"), F.lower("p_name").contains("steel").alias("steel"))


@query("money_text", "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'N/A' ELSE 'EUR ' || printf('%.1f', floor(c_acctbal)) || 'm' END AS money FROM customer")
def money_text(spark, sf):
    """STR19"""
    c = F.col("c_acctbal")
    # a negative zero keeps its sign, and what no long holds is whole already
    whole = F.when((c == 0) | F.isnan(c) | (F.abs(c) >= 2.0**53), c).otherwise(F.floor(c).cast("double"))
    return table(spark, sf, "customer").select("c_custkey", X.money(whole, F.lit("EUR"), F.lit("m")).alias("money"))
