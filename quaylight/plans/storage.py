"""Sources and sinks: each query writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators import sampling as S
from ..operators import textsearch as TS
from ..operators.scan import scanned
from ..sources import fetch
from ..sources.io import batches, bulk_query, index_terms, json_lines, load, new_path, read_tsv, save, save_index, save_vocabulary, sheet_rows, table
from ..sources.workbook import Look, read_workbooks, save_workbooks
from .registry import query


def written(df, name, fmt="parquet", **options):
    """Path of a new folder with the rows of ``df``."""
    path = new_path(df.sparkSession, name)
    save(df, path, fmt=fmt, **options)
    return path


@query("csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, sf):
    """SRC2"""
    c = table(spark, sf, "customer")
    return load(spark, "csv://" + written(c, "csv", "csv", header=True), {"header": "true"}, c.schema)


@query("tsv_scan", "SELECT DISTINCT user_id::BIGINT AS member, event_type AS kind FROM events WHERE event_type <> 'error'")
def tsv_scan(spark, sf):
    """SRC3: inferred types, new names, rows without a kind and repeated rows dropped."""
    e = table(spark, sf, "events").select("user_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"))
    out = read_tsv(spark, written(e, "tsv", "csv", header=True, sep="\t"), ["member", "kind"])
    return out.select(F.col("member").cast("long").alias("member"), "kind")


@query("json_view", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def json_view(spark, sf):
    """SRC4: JSON, a temporary view, SQL."""
    path = written(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "json", "json")
    load(spark, "json://" + path, schema="o_orderkey long, o_orderpriority string, o_totalprice double", view="orders_of_json")
    return spark.sql("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders_of_json WHERE o_totalprice > 1000 GROUP BY 1")


@query("scheme_dispatch", "SELECT f.fmt, s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) f(fmt) GROUP BY 1, 2")
def scheme_dispatch(spark, sf):
    """SRC5 SRC6: the scheme picks the format."""
    s, out = table(spark, sf, "supplier"), None
    for fmt in ("csv", "json", "orc", "parquet"):
        df = load(spark, f"{fmt}://{written(s, fmt, fmt)}", schema=s.schema).withColumn("fmt", F.lit(fmt))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("fmt", "s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("sink_modes", "SELECT count(*) AS n, true AS refused, 2 * count(*) AS appended FROM region")
def sink_modes(spark, sf):
    """SNK1 SNK2: a target is replaced if asked, refused by default, added to if asked."""
    r = table(spark, sf, "region")
    path = written(r, "modes")
    save(r, path, "overwrite")
    try:
        save(r, path)
        refused = False
    except AnalysisException:
        refused = True
    n = load(spark, path).agg(F.count("*").alias("n"), F.lit(refused).alias("refused")).first()
    save(r, path, "append")
    return load(spark, path).agg(F.lit(n.n).cast("long").alias("n"), F.lit(n.refused).alias("refused"), F.count("*").alias("appended"))


@query("index_sink", "WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part), p AS (SELECT p_partkey, term, count(*) AS tf FROM t GROUP BY 1, 2) SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM p GROUP BY 1")
def index_sink(spark, sf):
    """SNK3 SNK4: an index written in five appends, and what it holds."""
    p = table(spark, sf, "part").withColumn("terms", F.split("p_name", " "))
    path = new_path(spark, "index")
    for part in range(5):
        save_index(p.where(F.col("p_partkey") % 5 == part), path, "p_partkey", "terms")
    tf = load(spark, f"{path}/postings").groupBy("term").agg(F.sum("tf").alias("tf"))
    return index_terms(spark, path).join(tf, "term").select("term", "df", "tf")


@query("vocabulary_file", "WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part), d AS (SELECT word, count(*) AS df FROM t GROUP BY 1) SELECT word, row_number() OVER (ORDER BY word) - 1 AS id, round(ln((SELECT count(*) FROM part) / df), 6) AS idf FROM d")
def vocabulary_file(spark, sf):
    """SNK5: words in sorted order with ids and idf as CSV."""
    p = table(spark, sf, "part")
    terms = TS.frequencies(TS.postings(p, "p_partkey", F.split("p_name", " ")))
    v = scanned(TS.with_idf(terms, p, "c").select(F.col("term").alias("word"), "idf"), [], [F.col("word")], "rank").withColumn("id", F.col("rank") - 1)
    path = new_path(spark, "vocabulary")
    save_vocabulary(v.select("word", F.col("id").cast("long").alias("id"), F.round("idf", 6).alias("idf")), path)
    return load(spark, "csv://" + path, {"header": "true"}, "word string, id long, idf double")


@query("model_files", "SELECT s_suppkey, r_name AS region, CASE WHEN s_acctbal < 2000 THEN 0 WHEN s_acctbal < 6000 THEN 1 ELSE 2 END AS bucket FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def model_files(spark, sf):
    """SNK6: a region map and quantiser points as JSON, read back and applied."""
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    points = spark.createDataFrame([([2000.0, 6000.0],)], "points array<double>")
    regions = load(spark, "json://" + written(places, "regions", "json"), schema="n_nationkey int, region string")
    cuts = load(spark, "json://" + written(points, "points", "json"), schema="points array<double>").first().points
    s = table(spark, sf, "supplier").join(F.broadcast(regions), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", "region", sum((F.col("s_acctbal") >= x).cast("int") for x in cuts).alias("bucket"))


@query("split_files", "SELECT split, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT CASE WHEN o_custkey % 10 < 8 THEN 'train' WHEN o_custkey % 10 = 8 THEN 'val' ELSE 'test' END AS split, o_totalprice FROM orders) WHERE split <> 'test' GROUP BY 1")
def split_files(spark, sf):
    """SNK7: a folder for each split; reading two of them prunes the third."""
    place = F.col("o_custkey") % 10
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.when(place < 8, "train").when(place == 8, "val").otherwise("test").alias("split"))
    return load(spark, written(o, "splits", by=["split"])).where("split <> 'test'").groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("json_lines_file", "SELECT p_partkey, p_brand FROM part WHERE p_size > 10")
def json_lines_file(spark, sf):
    """SNK9"""
    path = written(json_lines(table(spark, sf, "part").where("p_size > 10")), "lines", "text")
    line = F.get_json_object("value", "$.p_partkey").cast("long").alias("p_partkey")
    return spark.read.text(path).select(line, F.get_json_object("value", "$.p_brand").alias("p_brand"))


#: The sheets of an annotation workbook, in its order.
MARKS, ASIDE, FIGURES, IDS = "Output Peers Annotation", "Auxiliary Information", "Peer Financials", "peer_entity_ids"
LOOKS = {
    MARKS: Look(2, (30, 40, 20, 20), {2: ["Positive", "Negative"], 3: ["0", "1", "2", "3"]}),
    ASIDE: Look(1, (30, 20)),
    FIGURES: Look(2, (30, 20, 20, 20)),
}


def _row(sheet, row, *cells):
    return F.struct(F.lit(sheet).alias("sheet"), row.cast("long").alias("row"), F.array(*(c.cast("string") for c in cells)).alias("cells"))


def annotation_rows(spark, sf):
    """SNK8: cells of a workbook for each nation: its first customer is the base, the others
    are the peers that analysts judge; all four sheets come of one pass."""
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    end = o.agg(F.max("year")).first()[0] or 0
    years = [end - 2, end - 1, end]
    sums = o.where(F.col("year") >= end - 2).groupBy("o_custkey").agg(*(F.sum(F.when(F.col("year") == y, F.col("cents"))).alias(f"y{i}") for i, y in enumerate(years)))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(sums, F.col("o_custkey") == F.col("c_custkey"), "left")
    ranked = scanned(c.select(F.col("n_name").alias("book"), "c_custkey", "c_name", "c_mktsegment", "y0", "y1", "y2"), ["book"], [F.col("c_custkey")], "rank")
    r, peer = F.col("rank") - 1, F.col("rank") > 1
    company = F.when(F.col("c_custkey") % 11 != 5, F.col("c_name"))
    unit = lambda y: F.floor(F.col(y) / 10000)
    money = [F.coalesce(F.concat(F.lit("USD "), F.floor(unit(y) / 10000).cast("string"), F.lit("."), F.lpad((unit(y) % 10000).cast("string"), 4, "0"), F.lit("mn")), F.lit("N/A")) for y in ("y0", "y1", "y2")]
    mark = F.when(peer, F.when(F.col("c_custkey") % 2 == 0, "Positive").otherwise("Negative"))
    rows = [
        _row(MARKS, r + 2, company, F.concat(F.lit("Buys as "), F.col("c_mktsegment")), mark, F.when(peer, F.col("c_custkey") % 4)),
        _row(ASIDE, r + 1, company, F.col("c_mktsegment")),
        _row(FIGURES, r + 2, company, *money),
        F.when(peer & (F.col("c_custkey") % 3 > 0), _row(IDS, r, company, F.col("c_custkey"))),
    ]
    text, at, nothing = F.lit, F.lit, F.lit(None)
    heads = [
        _row(MARKS, at(0), nothing, nothing, nothing, nothing, text("Last reported financials in the last 3 years")),
        _row(MARKS, at(1), *map(text, ("Company", "Description", "Positive/Negative?", "Relative Position"))),
        _row(ASIDE, at(0), text("Company"), text("Sector")),
        _row(FIGURES, at(0), nothing, text("Revenue")),
        _row(FIGURES, at(1), text("Company"), *map(text, years)),
        _row(IDS, at(0), text("Company"), text("Id")),
    ]
    cells = F.filter(F.concat(F.array(*rows), F.when(peer, F.array().cast("array<struct<sheet:string,row:bigint,cells:array<string>>>")).otherwise(F.array(*heads))), lambda x: x.isNotNull())
    return ranked.select("book", F.explode(cells).alias("x")).select("book", "x.*")


@query(
    "annotation_sheets",
    """
    WITH c AS (SELECT n_name AS book, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 2 AS place, c_custkey, CASE WHEN c_custkey % 11 <> 5 THEN c_name END AS company, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey),
    e AS (SELECT book, min(place) AS stop FROM c WHERE company IS NULL GROUP BY 1), y AS (SELECT max(year(o_orderdate)) AS y FROM orders),
    f AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT // 10000 AS u FROM orders, y WHERE year(o_orderdate) = y GROUP BY 1)
    SELECT book, place, company, CASE WHEN c_custkey % 2 = 0 THEN 'Positive' ELSE 'Negative' END AS mark, (c_custkey % 4)::INTEGER AS position, c_mktsegment AS sector,
        coalesce('USD ' || (u // 10000) || '.' || lpad((u % 10000)::VARCHAR, 4, '0') || 'mn', 'N/A') AS revenue, y::INTEGER AS end_year, CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS id
    FROM c LEFT JOIN e USING (book) LEFT JOIN f ON o_custkey = c_custkey, y WHERE place >= 0 AND (stop IS NULL OR place < stop)
    """,
)
def annotation_sheets(spark, sf):
    """SRC8 SNK8: workbooks of four sheets with bold heads, widths and lists of allowed values,
    written and read back: heads skipped, cut at the blank company, the base's row left out,
    the id sheet joined, the last year from the head of the figures."""
    path = new_path(spark, "workbooks")
    save_workbooks(annotation_rows(spark, sf), path, order=[MARKS, ASIDE, FIGURES, IDS], looks=LOOKS)
    cell = lambda i: F.get("cells", F.lit(i))
    sheet = lambda name, first, *columns: read_workbooks(spark, path, [name]).where(F.col("row") >= first).select("book", "row", *columns)
    marks = sheet(MARKS, 2, cell(0).alias("company"), cell(2).alias("mark"), cell(3).cast("int").alias("position"))
    ids = sheet(IDS, 1, cell(0).alias("company"), cell(1).cast("long").alias("id")).drop("row")
    aside = sheet(ASIDE, 1, cell(1).alias("sector")).withColumn("row", F.col("row") + 1)
    figures = sheet(FIGURES, 1, F.element_at("cells", -1).alias("revenue"))
    ends = figures.where("row = 1").select("book", F.col("revenue").cast("int").alias("end_year"))
    out = sheet_rows(marks, ids, header=2, book="book").join(aside, ["book", "row"]).join(figures, ["book", "row"]).join(ends, "book")
    return out.select("book", (F.col("row") - 3).alias("place"), "company", "mark", "position", "sector", "revenue", "end_year", "id")


@query(
    "sample_workbook",
    """
    WITH q AS (SELECT *, 20 AS quota, (c_custkey * 2654435761) % 4294967296 AS h, count(*) OVER (PARTITION BY c_mktsegment) AS have FROM customer),
    s AS (SELECT c_mktsegment, count(DISTINCT c_nationkey) AS strata FROM customer GROUP BY 1),
    f AS (SELECT q.*, (row_number() OVER (PARTITION BY q.c_mktsegment, c_nationkey ORDER BY h, c_custkey) <= ceil(quota * 1.0 / strata)) AS fst FROM q JOIN s ON q.c_mktsegment = s.c_mktsegment WHERE have >= quota),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY fst DESC, h, c_custkey) AS k FROM f) WHERE k <= quota)
    SELECT row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS "case", c_name AS name, r_name AS region, c_mktsegment AS sector, 0 AS internal FROM k JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    """,
)
def sample_workbook(spark, sf):
    """SMP2 SNK10: a sample of equal strata as a workbook of a numbered sheet and an empty one
    for the figures, read back."""
    c = table(spark, sf, "customer")
    quotas = c.select("c_mktsegment").distinct().withColumn("quota", F.lit(20))
    some = S.quota(c, "c_mktsegment", ["c_nationkey"], "c_custkey", quotas)
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "r_name")
    some = scanned(some.join(places, F.col("n_nationkey") == F.col("c_nationkey")).select("c_mktsegment", "c_custkey", "c_name", "r_name"), [], [F.col("c_mktsegment"), F.col("c_custkey")], "rank")
    head = ("Case", "Base Borrower Name", "Base Borrower Region", "Base Borrower Sector", "INTERNAL")
    rows = some.select(_row("Info", F.col("rank"), F.col("rank") - 1, F.col("c_name"), F.col("r_name"), F.col("c_mktsegment"), F.lit(0)).alias("x")).select("x.*")
    heads = spark.range(1).select(F.explode(F.array(_row("Info", F.lit(0), *map(F.lit, head)), _row("Financials", F.lit(0), F.lit(None)))).alias("x")).select("x.*")
    path = new_path(spark, "sample")
    save_workbooks(rows.unionByName(heads).withColumn("book", F.lit("sample")), path, order=["Info", "Financials"], looks={"Info": Look(1)})
    cell = lambda i, name, kind="string": F.get("cells", F.lit(i)).cast(kind).alias(name)
    back = read_workbooks(spark, path, ["Info"]).where("row > 0")
    return back.select(cell(0, "case", "long"), cell(1, "name"), cell(2, "region"), cell(3, "sector"), cell(4, "internal", "int"))


@query("factor_files", "SELECT i, count(*) AS n, round(sum(x), 4) AS total FROM (SELECT (generate_subscripts(embedding, 1) - 1)::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE x > 0 GROUP BY 1")
def factor_files(spark, sf):
    """SNK11: a sparse matrix as (row, column, value)."""
    long = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).where("x > 0")
    return load(spark, written(long.withColumn("x", F.col("x").cast("double")), "factors")).groupBy("i").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


@query("batched_lookup", "WITH k AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS batch FROM customer WHERE c_custkey % 3 = 0) SELECT batch, c_custkey, o_orderkey FROM k JOIN orders ON o_custkey = c_custkey")
def batched_lookup(spark, sf):
    """SRC9 SRC10 SRC13: the series of listed entities, asked for in batches of 100."""
    ids = batches(table(spark, sf, "customer").where("c_custkey % 3 = 0"), "c_custkey")
    return table(spark, sf, "orders").join(ids, F.col("o_custkey") == F.col("c_custkey")).select("batch", "c_custkey", "o_orderkey")


@query("bulk_series", "SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def bulk_series(spark, sf):
    """SRC11: one query from a list of mnemonics."""
    table(spark, sf, "events").createOrReplaceTempView("events_in_bulk")
    out = spark.sql(bulk_query("events_in_bulk", "user_id", "event_type", "value", ["click", "purchase"]))
    return out.select("user_id", F.round("click", 4).alias("click"), F.round("purchase", 4).alias("purchase"))


def _answer(url: str, n: int) -> tuple[int, str]:
    """A stand-in for the network: some addresses fail for a while, some for good."""
    kind = len(url) % 7
    if kind == 1 and n < 3 or kind == 2:
        return 503, ""
    if kind == 3:
        raise TimeoutError
    return (404, "none") if kind == 4 else (200, url[::-1])


@query("fetched_pages", "SELECT page_id, CASE length(url) % 7 WHEN 2 THEN 503 WHEN 3 THEN 0 WHEN 4 THEN 404 ELSE 200 END AS code, CASE WHEN length(url) % 7 IN (2, 3) THEN 4 WHEN length(url) % 7 = 1 THEN 3 ELSE 1 END AS tries, CASE WHEN length(url) % 7 IN (2, 3, 4) THEN NULL ELSE reverse(url) END AS text FROM pages WHERE url IS NOT NULL")
def fetched_pages(spark, sf):
    """SRC12 SRC14-16: status, retries and text of each address."""
    return fetch.crawl(table(spark, sf, "pages"), "page_id", "url", _answer, tries=4, threads=8)


@query("nearest_names", "SELECT s.s_suppkey, n.n_name, levenshtein(lower(n.n_name), lower(substr(s.s_name, 1, 8)))::INTEGER AS edits FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey")
def nearest_names(spark, sf):
    """STR4 JN7: joined under two key names, one of which is dropped."""
    n = R.semi(table(spark, sf, "nation"), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey").withColumnRenamed("n_nationkey", "s_nationkey")
    both = table(spark, sf, "supplier").join(n, "s_nationkey")
    return both.select("s_suppkey", "n_name", F.levenshtein(F.lower("n_name"), F.lower(F.substring("s_name", 1, 8))).alias("edits"))


_lines = r"""
    SELECT page_id, name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<title.*?</title>', '', 'g'), '\s+', ' ', 'g'), '(?i)<h[1-6][^>]*>', chr(10) || chr(10) || '# ', 'g'),
        '(?i)</(?:h[1-6]|p|div|li|tr)>|<br[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), ' *\n *', chr(10), 'g'), ' ') AS text
    FROM (SELECT page_id, html, regexp_extract(html, '(?is)<p>(?:<[^>]*>)*(\w+)', 1) AS name FROM pages)
"""


@query(
    "company_texts",
    rf"""
    WITH r AS (SELECT page_id, name, text, instr(text, name) AS pos FROM ({_lines})), s AS (SELECT *, regexp_extract(substr(text, pos), '(?s)^[^*#|>]*', 0) AS rest FROM r),
    o AS (SELECT *, CASE WHEN regexp_extract(rest, '(?s)^(.*?[.!?])(?:\s|$)', 1) = '' THEN rest ELSE regexp_extract(rest, '(?s)^(.*?[.!?])(?:\s|$)', 1) END AS one FROM s)
    SELECT page_id, CASE WHEN pos > 0 AND name <> '' AND contains(substr(text, pos, length(name) + 30), ' is ') AND len(regexp_extract_all(one, '\S+')) > 5 THEN replace(one, chr(10), ' ') END AS is_text,
        nullif(trim(regexp_extract(text, '(?i)subsidiary of (.+?)[.,]', 1)), '') AS parent, regexp_matches(text, '(?i){X.ABOUT}') AS headed FROM o
    """,
)
def company_texts(spark, sf):
    """TXT21-23: of each page the sentence that says what its first name is, the parent that
    its last sentences name, and whether a heading says who the company is."""
    h = F.col("html")
    p = table(spark, sf, "pages").select("page_id", X.headed_text(h).alias("text"), F.regexp_extract(h, r"(?is)<p>(?:<[^>]*>)*(\w+)", 1).alias("name"))
    t = F.col("text")
    return p.select("page_id", X.pattern_is(t, F.col("name")).alias("is_text"), X.subsidiary_of(t).alias("parent"), (X.who_we_are(t).isNotNull() | t.rlike(f"(?i){X.ABOUT}")).alias("headed"))
