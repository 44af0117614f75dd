"""Queries of the pipelines' operators over the driver's tables, and the SQL that gives the same results."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketweave.functions import rates as RF
from marketweave.functions import text as T
from marketweave.functions import values as V
from marketweave.functions.subword import subword_count
from marketweave.operators import alignment as A
from marketweave.operators import dedup as D
from marketweave.operators import extract as X
from marketweave.operators import modelling as M
from marketweave.operators import rates as R
from marketweave.operators import reports as P
from marketweave.operators import selection as S
from marketweave.plans import pipelines
from marketweave.session import cut_lineage, shared_folder, spread
from marketweave.sources import files as IO

ARTICLES = "batch_1789375807_210"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in (ARTICLES, "documents") else table


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, ARTICLES)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merged_records(_articles(spark, sf_dir))


# ---- SQL parts -------------------------------------------------------------------------------------------------------------

def _iso(*columns: str):
    """Dates as ISO text, which both sides write alike."""
    return [F.col(c).cast("string").alias(c) for c in columns]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(term: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in term)


_SCORE = lambda x: " + ".join(f"CASE WHEN regexp_matches({x}, {_q('(?i)' + chr(92) + 'b' + _re2(t) + chr(92) + 'b')}) THEN {w} ELSE 0 END" for t, w in V.LEXICON.items())
_TERMS = lambda x: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, {_q('(?i)' + chr(92) + 'b' + _re2(t) + chr(92) + 'b')}) THEN {_q(t)} END" for t in V.LEXICON) + "], lambda x: x IS NOT NULL), '|')"
_NEG = lambda x, words: f"regexp_matches({x}, {_q(('(?i)' + chr(92) + 'b(?:' if words else '(?i)(?:') + '|'.join(V.NEGATIVE) + (')' + chr(92) + 'b' if words else ')'))})"
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TOKENS = lambda x: f"CAST(len(list_filter(regexp_split_to_array({x}, '{_SPACE}+'), lambda w: w <> '')) AS BIGINT)"
_KEY = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g'))"
_NORM = lambda x: (
    f"array_to_string(list_filter(list_transform(regexp_extract_all(lower({x}), '[a-z0-9%$][a-z0-9%$.]*'), lambda w: trim(w, '.')), "
    f"lambda w: length(w) > 1 AND NOT list_contains([{', '.join(map(_q, V.STOPWORDS))}], w)), ' ')"
)
_PAID = "regexp_matches(lower(coalesce(section, '')), 'pro:|investing club')"
_NUMBER = r"""
(SELECT CASE WHEN contains(s, '.') AND contains(s, ',') AND strpos(reverse(s), ',') < strpos(reverse(s), '.') THEN TRY_CAST(replace(replace(s, '.', ''), ',', '.') AS DOUBLE)
  WHEN contains(s, '.') AND contains(s, ',') THEN TRY_CAST(replace(s, ',', '') AS DOUBLE)
  WHEN regexp_matches(s, ',\d{3}$') THEN TRY_CAST(replace(s, ',', '') AS DOUBLE)
  WHEN contains(s, ',') THEN TRY_CAST(replace(s, ',', '.') AS DOUBLE)
  WHEN regexp_matches(s, '\.\d{3}$') THEN TRY_CAST(replace(s, '.', '') AS DOUBLE) ELSE TRY_CAST(s AS DOUBLE) END
 FROM (SELECT regexp_replace(kurs, '[^\d.,\-]', '', 'g') AS s))"""
_MONTH = "CASE lower(regexp_extract(trim(tanggal), '[A-Za-z]+')) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.RATE_MONTHS.items()) + " END"
_DATE = rf"""
CAST(coalesce(try_strptime(trim(tanggal), ['%Y-%m-%d', '%Y/%m/%d', '%Y.%m.%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S']),
  try_strptime(regexp_replace(trim(tanggal), '[\s\-/]+', ' ', 'g'), ['%d %B %Y', '%d %b %Y', '%B %d, %Y', '%b %d, %Y', '%B %d %Y', '%b %d %Y']),
  CASE WHEN regexp_matches(trim(tanggal), '^\d{{1,2}}[\s\-/]+[A-Za-z]+[\s\-/]+\d{{4}}$')
    THEN try_strptime(regexp_extract(trim(tanggal), '\d{{4}}$') || '-' || ({_MONTH}) || '-' || regexp_extract(trim(tanggal), '^\d{{1,2}}'), '%Y-%m-%d') END,
  CASE WHEN regexp_matches(trim(tanggal), '\d{{4}}$') THEN try_strptime(regexp_replace(trim(tanggal), '[.\-]', '/', 'g'), ['%d/%m/%Y', '%m/%d/%Y'])
    ELSE try_strptime(regexp_replace(trim(tanggal), '[.\-]', '/', 'g'), ['%d/%m/%y', '%m/%d/%y']) END) AS DATE)"""
_RATES = f"""
parsed AS (SELECT {_DATE} AS date, {_NUMBER} AS kurs, seq FROM rates_raw),
valid AS (SELECT date, kurs FROM parsed WHERE date IS NOT NULL AND kurs > {V.MIN_RATE} QUALIFY row_number() OVER (PARTITION BY date ORDER BY seq DESC) = 1),
ranged AS (SELECT * FROM valid WHERE date BETWEEN DATE '{V.FIRST_DAY}' AND DATE '{V.LAST_DAY}'),
lagged AS (SELECT date, kurs, lag(kurs) OVER (ORDER BY date) AS prev_kurs, CAST(date - lag(date) OVER (ORDER BY date) AS BIGINT) AS gap_days FROM ranged),
rates AS (SELECT *, kurs - prev_kurs AS delta, ln(kurs / prev_kurs) AS log_return,
  CASE WHEN ln(kurs / prev_kurs) > {V.FLAT} THEN 'up' WHEN ln(kurs / prev_kurs) < -{V.FLAT} THEN 'down' ELSE 'flat' END AS direction FROM lagged)"""
_ISO_UTC = r"""
CASE WHEN regexp_matches(published, '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$') THEN
  TRY_CAST(regexp_replace(CASE WHEN length(published) = 10 THEN published || ' 00:00:00' ELSE
     regexp_replace(regexp_replace(published, '(:\d{2}(?:\.\d+)?)(Z|[+-]\d{2}:?\d{2})$', '\1'), '^(.{10}.\d{2}:\d{2})$', '\1:00') END, 'T', ' ') AS TIMESTAMP)
  - to_minutes(CAST(CASE WHEN regexp_matches(published, ':\d{2}(\.\d+)?[+-]\d{2}:?\d{2}$') THEN
      (CAST(regexp_extract(published, '[+-](\d{2}):?\d{2}$', 1) AS INT) * 60 + CAST(regexp_extract(published, '[+-]\d{2}:?(\d{2})$', 1) AS INT))
      * CASE WHEN regexp_extract(published, '([+-])\d{2}:?\d{2}$', 1) = '-' THEN -1 ELSE 1 END ELSE 0 END AS INT)) END"""
_BLANKS = "'" + T.WHITE + "'"


def _compatible(x: str) -> str:
    """NFKC in SQL, from Unicode's own table for the blocks that hold compatibility forms of letters, digits, signs and spaces."""
    blocks = ((0xA0, 0x17F), (0x1C4, 0x1F3), (0x2000, 0x214F), (0x3000, 0x3000), (0xFB00, 0xFB06), (0xFF01, 0xFF5E), (0xFFE0, 0xFFE6))
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for lo, hi in blocks for c in range(lo, hi + 1)}
    one = {k: v for k, v in forms.items() if k != v and len(v) == 1}
    for k, v in forms.items():
        if k != v and len(v) != 1:
            x = f"replace({x}, {_q(k)}, {_q(v)})"
    return f"nfc_normalize(translate({x}, {_q(''.join(one))}, {_q(''.join(one.values()))}))"


def _clean_sql(x: str, patterns: tuple[str, ...], label: str | None = None, footer: str | None = None) -> str:
    """The cleaning chain in SQL, for texts without entities."""
    x = f"coalesce({x}, '')"
    for p, flags in ((label, "i"), (footer, "is")):
        x = f"regexp_replace({x}, {_q(p)}, '', '{flags}')" if p else x
    x = rf"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g')"
    x = _compatible(rf"regexp_replace({x}, '[\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{feff}}]', '', 'g')")
    x = f"replace(translate({x}, {_q(''.join(V.CURLY))}, {_q(''.join(V.CURLY.values()))}), '…', '...')"
    for p in patterns:
        p = p.replace(V.SENTENCE_END, r"(?:U\.S\.|U\.K\.|U\.N\.|E\.U\.|[^.])*\.")
        x = f"regexp_replace({x}, {_q('(?i)' + p)}, ' ', 'g')"
    return rf"trim(regexp_replace({x}, '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{1680}}\x{{2028}}\x{{2029}}]+', ' ', 'g'))"


_TERMS_CLEAN = lambda x: _clean_sql(x, V.BOILERPLATE_TERMS)
_FILLED = lambda *x: f"array_to_string(list_filter([{', '.join(x)}], lambda x: x <> ''), '. ')"
_MERGED = f"trim(coalesce(description, '') || ' ' || substr(coalesce(body, ''), 1, 2000), {_BLANKS})"
_NEWS = f"""
records AS (SELECT seq, trim(url, {_BLANKS}) AS url, title, section, published, body, description AS own_description, {_MERGED} AS description, matched_terms AS listed FROM {ARTICLES} WHERE NOT {_PAID}),
by_url AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1),
by_title AS (SELECT * FROM by_url QUALIFY row_number() OVER (PARTITION BY {_KEY("coalesce(title, 'nan')")} ORDER BY seq) = 1),
parts AS (SELECT *, {_TERMS_CLEAN("title")} AS c1, {_TERMS_CLEAN("description")} AS c2, {_TERMS_CLEAN("body")} AS c3, {_ISO_UTC} AS published_utc
  FROM by_title WHERE NOT regexp_matches(lower(coalesce(section, '')), 'pro:|quote|make it|select|press release')),
texts AS (SELECT *, {_FILLED("c1", "c2")} AS text_for_filter, {_FILLED("c1", "c2", "c3")} AS text_clean FROM parts),
scored AS (SELECT *, CAST({_SCORE("text_for_filter")} AS BIGINT) AS relevance_score, {_TERMS("text_for_filter")} AS matched_terms, {_NEG("text_for_filter", True)} AS has_negative, {_TOKENS("text_clean")} >= {V.MIN_TOKENS} AS long_enough FROM texts),
news AS (SELECT url, {_NORM("text_clean")} AS text_norm, section, published_utc, published_utc + INTERVAL 7 HOUR AS wib, relevance_score, matched_terms
  FROM scored WHERE long_enough AND relevance_score >= {V.MIN_SCORE} AND NOT has_negative AND published_utc IS NOT NULL),
cand AS (SELECT *, CAST(wib AS DATE) + CASE WHEN hour(wib) >= 8 THEN 1 ELSE 0 END AS candidate FROM news),
cal AS (SELECT date AS target_date, lead(date) OVER (ORDER BY date) AS target_date_lag1 FROM rates),
aligned AS (SELECT c.*, k.target_date, k.target_date_lag1, isodow(wib) >= 6 OR hour(wib) >= 8 AS is_offhours,
  (epoch_us(CAST(k.target_date AS TIMESTAMP) + INTERVAL 8 HOUR) - epoch_us(wib)) / 3600000000.0 AS hours_to_fixing, {_TOKENS("text_norm")} AS n_tokens
  FROM cand c ASOF LEFT JOIN cal k ON c.candidate <= k.target_date)"""
_DAILY = """
daily AS (SELECT target_date AS date, count(url) AS n_news, avg(relevance_score) AS mean_relevance, max(relevance_score) AS max_relevance, avg(n_tokens) AS mean_tokens,
  avg(CASE WHEN is_offhours THEN 1.0 ELSE 0.0 END) AS pct_offhours, string_agg(CASE WHEN text_norm <> '' THEN text_norm END, ' ' ORDER BY published_utc, url) AS text_norm_concat
  FROM aligned WHERE target_date IS NOT NULL GROUP BY target_date),
merged AS (SELECT r.*, coalesce(n_news, 0) AS n_news, mean_relevance, max_relevance, mean_tokens, pct_offhours, coalesce(text_norm_concat, '') AS text_norm_concat,
  coalesce(gap_days, 1) * 24.0 AS window_hours FROM rates r LEFT JOIN daily d ON r.date = d.date)"""
_WITH = f"WITH {_RATES}, {_NEWS}, {_DAILY}"


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clean_rates(_t(spark, sf_dir, "rates_raw"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.news_features(_records(spark, sf_dir))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant news with their target day, those after the last fixing without."""
    return A.align(_features(spark, sf_dir).withColumn("n_tokens", T.token_count(F.col("text_norm"))), _rates(spark, sf_dir))


def _daily(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    return pipelines.daily_table(_features(spark, sf_dir), _rates(spark, sf_dir), with_text)


# ---- sources and sinks -----------------------------------------------------------------------------------------------------

@query(f"SELECT site, CAST(strftime(CAST(index_date AS DATE), '%Y-%m') AS VARCHAR) AS month, count(*) AS n FROM {ARTICLES} GROUP BY 1, 2")
def src1_scan(spark, sf_dir):
    return _articles(spark, sf_dir).groupBy("site", F.substring("index_date", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (event_id % 50 = 0) AS BIGINT) AS bad_lines,
CAST(sum(CASE WHEN event_id % 50 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END) AS BIGINT) AS sum_k FROM events""")
def src5_shards_tolerant(spark, sf_dir):
    """Shards in which every fiftieth event's line is cut short and blank lines stand between, read tolerantly: bad lines are counted."""
    path = shared_folder(spark, "events")
    line = F.when(F.col("event_id") % 50 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    _t(spark, sf_dir, "events").select(F.concat(line, F.when(F.col("event_id") % 7 == 0, "\n").otherwise("")).alias("value")).write.text(path)
    read = IO.read_shards(spark, path, "k bigint")
    return read.agg(F.count(F.lit(1)).alias("lines"), F.count("_bad").alias("bad_lines"), F.sum(F.when(F.col("_bad").isNull(), F.col("k"))).alias("sum_k"))


@query("SELECT trim(tanggal) AS tanggal, nullif(kurs, '') AS kurs FROM rates_raw")
def src2_src3_snk1_rate_file(spark, sf_dir):
    """The rates written as a file with semicolons and unlike names, then read by sniffing both."""
    path = shared_folder(spark, "rates")
    raw = _t(spark, sf_dir, "rates_raw").select(F.col("nomor").alias("NO"), F.col("tanggal").alias(" Tanggal Terbit"), F.col("kurs").alias("Nilai"))
    IO.write_csv(raw.coalesce(1), path, sep=";")
    return IO.read_rates(spark, path).select(F.trim("tanggal").alias("tanggal"), "kurs")


@query(f"SELECT url, title, published, md5(body) AS digest, title_score FROM {ARTICLES}")
def src4_snk3_shards(spark, sf_dir):
    """The articles written as JSON shards and read again, strictly."""
    path = shared_folder(spark, "shards")
    IO.append_shard(_articles(spark, sf_dir).select("url", "title", "published", "body", "title_score"), path)
    return IO.read_shards(spark, path, strict=True).select("url", "title", "published", F.md5("body").alias("digest"), "title_score")


@query(f"SELECT site AS folder, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (title IS NULL) AS BIGINT) AS bad_lines FROM {ARTICLES} GROUP BY 1")
def src6_shard_audit(spark, sf_dir):
    """Shards in which the line of an article without title is cut short, audited by site."""
    path = shared_folder(spark, "audit")
    line = F.to_json(F.struct("seq", "url", "title"))
    _articles(spark, sf_dir).select("site", F.when(F.col("title").isNull(), F.substring(line, 1, 12)).otherwise(line).alias("value")).write.partitionBy("site").text(path)
    return IO.shard_audit(spark, path, by=F.regexp_extract(F.col("_metadata.file_path"), "site=([^/]+)/", 1)).withColumnRenamed("file", "folder")


@query(f"""SELECT site AS folder, substr('{{"seq":' || seq || ',"url":"' || url, 1, 12) AS value FROM {ARTICLES} WHERE title IS NULL""")
def src6_bad_lines(spark, sf_dir):
    """The text of the bad lines of the same shards."""
    path = shared_folder(spark, "audit")
    line = F.to_json(F.struct("seq", "url", "title"))
    _articles(spark, sf_dir).select("site", F.when(F.col("title").isNull(), F.substring(line, 1, 12)).otherwise(line).alias("value")).write.partitionBy("site").text(path)
    return IO.bad_lines(spark, path, by=F.regexp_extract(F.col("_metadata.file_path"), "site=([^/]+)/", 1)).withColumnRenamed("file", "folder")


@query(f"""SELECT DISTINCT strftime(d, '%Y-%m') AS month FROM generate_series(DATE '{V.FIRST_DAY}', DATE '{V.LAST_DAY}', INTERVAL 1 DAY) t(d)
WHERE strftime(d, '%Y-%m') NOT IN (SELECT substr(index_date, 1, 7) FROM {ARTICLES} WHERE site = (SELECT min(site) FROM {ARTICLES}))""")
def src7_months_to_fetch(spark, sf_dir):
    """Months of the period of which nothing has landed yet from the first site."""
    a = _articles(spark, sf_dir).select("site", F.substring("index_date", 1, 7).alias("month"))
    landed = a.join(F.broadcast(a.agg(F.min("site").alias("site"))), "site", "left_semi")
    return IO.months_to_fetch(IO.days_between(spark, V.FIRST_DAY, V.LAST_DAY), landed)


@query(f"""SELECT CASE WHEN title_score >= 2 THEN 'kept' ELSE 'rest' END AS part, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM {ARTICLES} GROUP BY 1""")
def snk5_split(spark, sf_dir):
    """Articles split into two tables in one pass, counted from both."""
    kept, rest = shared_folder(spark, "kept"), shared_folder(spark, "rest")
    IO.split_write(_articles(spark, sf_dir).select("seq", "title_score"), F.col("title_score") >= 2, kept, rest)
    sums = lambda path, name: spark.read.parquet(path).groupBy(F.lit(name).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))
    return sums(kept, "kept").unionAll(sums(rest, "rest"))


@query(f"SELECT listing_id, url FROM (SELECT DISTINCT listing_id, url FROM archive_index) i WHERE NOT EXISTS (SELECT 1 FROM {ARTICLES} a WHERE a.url = i.url)")
def src7_to_fetch(spark, sf_dir):
    """Listings whose article has not been fetched yet."""
    listed = _t(spark, sf_dir, "archive_index").select("listing_id", "url").distinct()
    return D.not_done(listed, _articles(spark, sf_dir), "url").select("listing_id", "url")


@query(f"SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, year(d) AS year, month(d) AS month FROM generate_series(DATE '{V.FIRST_DAY}', DATE '{V.LAST_DAY}', INTERVAL 1 DAY) t(d)")
def src8_days(spark, sf_dir):
    return IO.days_between(spark, V.FIRST_DAY, V.LAST_DAY).select(*_iso("day"), "year", "month")


@query(f"SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, 'https://archive.example/' || strftime(d, '%Y/%B/%-d/') AS url FROM generate_series(DATE '{V.FIRST_DAY}', DATE '{V.LAST_DAY}', INTERVAL 1 DAY) t(d)")
def src11_archive_urls(spark, sf_dir):
    return IO.days_between(spark, V.FIRST_DAY, V.LAST_DAY).select(*_iso("day"), IO.archive_url(F.col("day"), "https://archive.example/").alias("url"))


@query(r"""SELECT site, index_date, count(DISTINCT url) AS links FROM archive_index
WHERE regexp_extract(url, '/(\d{4})/\d{2}/(\d{2})/', 1) = substr(index_date, 1, 4) AND regexp_extract(url, '/(\d{4})/\d{2}/(\d{2})/', 2) = substr(index_date, 9, 2) GROUP BY 1, 2""")
def src12_probe(spark, sf_dir):
    """Listed links by site and day whose year and day agree with the page's; the month is not compared."""
    part = lambda i: F.regexp_extract("url", X.DATE_PATH, i)
    same = (part(1) == F.substring("index_date", 1, 4)) & (part(3) == F.substring("index_date", 9, 2))
    return _t(spark, sf_dir, "archive_index").filter(same).groupBy("site", "index_date").agg(F.count_distinct("url").alias("links"))


# ---- filters and projections -----------------------------------------------------------------------------------------------

@query("SELECT event_type, count(*) AS n FROM events WHERE lower(coalesce(event_type, '')) NOT IN ('view', 'error') GROUP BY 1")
def flt1_types(spark, sf_dir):
    kept = _t(spark, sf_dir, "events").filter(~S.dropped_type(F.col("event_type"), ("view", "error")))
    return P.value_counts(kept, "event_type")


@query(f"SELECT seq FROM {ARTICLES} WHERE NOT regexp_matches(lower(coalesce(section, '')), 'pro:|quote|make it|select|press release')")
def flt2_sections(spark, sf_dir):
    return _articles(spark, sf_dir).filter(~S.dropped_section(F.col("section"))).select("seq")


@query(f"SELECT seq FROM {ARTICLES} WHERE NOT {_PAID}")
def flt3_open(spark, sf_dir):
    return _articles(spark, sf_dir).filter(~S.paid(F.col("section"))).select("seq")


@query(f"SELECT doc_id FROM documents WHERE {_TOKENS('text')} >= {V.MIN_TOKENS}")
def flt4_long_enough(spark, sf_dir):
    return _t(spark, sf_dir, "documents").filter(T.token_count(F.col("text")) >= V.MIN_TOKENS).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE ({_SCORE('text')}) >= {V.MIN_SCORE} AND NOT {_NEG('text', True)}")
def flt5_relevant(spark, sf_dir):
    docs = T.computed_once(_t(spark, sf_dir, "documents").select("doc_id", "text"), {"m": T.matched_terms(F.col("text"))})
    return docs.filter((T.lexicon_score(F.col("m")) >= V.MIN_SCORE) & ~T.has_negative(F.col("text"))).select("doc_id")


@query(f"""SELECT listing_id, title, url, CAST(sc AS BIGINT) AS title_score, {_TERMS('title')} AS matched_terms
FROM (SELECT DISTINCT listing_id, title, url, {_SCORE('title')} AS sc, {_NEG('title', False)} AS ng FROM archive_index) WHERE sc >= 1 AND NOT ng""")
def flt6_shortlist(spark, sf_dir):
    index = _t(spark, sf_dir, "archive_index").select("listing_id", "title", "url").distinct()
    return S.shortlist(index).select("listing_id", "title", "url", "title_score", "matched_terms")


@query(f"SELECT seq, epoch_us(u) AS utc_us FROM (SELECT seq, {_ISO_UTC} AS u FROM {ARTICLES}) WHERE u IS NOT NULL")
def flt7_timed(spark, sf_dir):
    timed = _articles(spark, sf_dir).select("seq", A.iso_utc(F.col("published")).alias("u")).filter("u is not null")
    return timed.select("seq", F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("u")).alias("utc_us"))


@query("SELECT doc_id FROM documents WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 0")
def flt8_not_empty(spark, sf_dir):
    return _t(spark, sf_dir, "documents").filter(F.length(T.squeeze(F.col("text"))) > 0).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderdate IS NOT NULL AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-09-01' AND DATE '1999-09-01'")
def flt9_flt10_sane_in_range(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.filter((F.col("o_totalprice") > V.MIN_RATE) & F.col("o_orderdate").cast("date").between(F.lit("1996-09-01").cast("date"), F.lit("1999-09-01").cast("date"))).select("o_orderkey")


@query(f"SELECT seq FROM {ARTICLES} WHERE regexp_matches(lower(coalesce(title, '')), 'watch|{V.LIVE_BLOG}') OR regexp_matches(lower(url), 'watch|{V.LIVE_BLOG}')")
def flt13_live_blogs(spark, sf_dir):
    """Live blogs; this outlet's tables call them watches."""
    return _articles(spark, sf_dir).filter(S.live_blog(F.col("title"), F.col("url"), "watch|" + V.LIVE_BLOG)).select("seq")


@query(f"SELECT seq FROM {ARTICLES} WHERE regexp_matches(lower(coalesce(title, '')), 'embargo|{V.TOPIC}')")
def flt14_topic(spark, sf_dir):
    return _articles(spark, sf_dir).filter(S.on_topic(F.col("title"), "embargo|" + V.TOPIC)).select("seq")


@query(f"SELECT site, count(*) AS n FROM {ARTICLES} WHERE section IS NULL GROUP BY 1")
def flt15_no_section(spark, sf_dir):
    return _articles(spark, sf_dir).filter("section is null").groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT seq, url AS article_id, 'article' AS type, matched_terms AS search_keyword, 'html_sitemap' AS keyword_group FROM {ARTICLES} WHERE NOT {_PAID}")
def prj1_constants(spark, sf_dir):
    return _records(spark, sf_dir).select("seq", "article_id", "type", "search_keyword", "keyword_group")


@query("SELECT doc_id, md5(trim(coalesce(section, '') || ' ' || substr(text, 1, 2000), chr(9) || chr(10) || chr(13) || ' ')) AS digest FROM documents")
def prj2_merged_description(spark, sf_dir):
    merged = S.merged_description(F.col("section"), F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(merged).alias("digest"))


@query("SELECT doc_id, array_to_string(list_filter([section, source, lang], lambda x: x IS NOT NULL AND x <> ''), '. ') AS joined FROM documents")
def prj3_joined(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.join_parts(F.col("section"), F.col("source"), F.col("lang")).alias("joined"))


@query("SELECT doc_id, md5(trim(rtrim(split_part(text, chr(10), 1), '. ') || '. ' || substr(text, strpos(text, chr(10)) + 1), '. ')) AS digest FROM documents")
def prj4_transformer_text(spark, sf_dir):
    cut = F.locate("\n", "text")
    whole = T.transformer_text(F.substring_index("text", "\n", 1), F.substring(F.col("text"), cut + 1, F.length("text")))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(whole).alias("digest"))


@query(f"SELECT seq, length(coalesce(body, '')) = 0 AS used_description_fallback, md5(CASE WHEN length(coalesce(body, '')) = 0 THEN description ELSE body END) AS digest FROM {ARTICLES}")
def prj5_fallback(spark, sf_dir):
    empty = F.length(F.coalesce(F.col("body"), F.lit(""))) == 0
    text = F.when(empty, F.col("description")).otherwise(F.col("body"))
    return _articles(spark, sf_dir).select("seq", empty.alias("used_description_fallback"), F.md5(text).alias("digest"))


@query("SELECT doc_id, source, section FROM documents")
def prj6_present(spark, sf_dir):
    return S.present(_t(spark, sf_dir, "documents"), ["doc_id", "no_such_column", "source", "section"])


@query(f"SELECT seq, section IS NULL AS no_section, length(coalesce(body, '')) = 0 AS no_text, replace(url, 'https://www.', '') AS shown, substr(title, 1, 40) AS head FROM {ARTICLES}")
def fn_str3_to_fn_str5_shown(spark, sf_dir):
    return _articles(spark, sf_dir).select(
        "seq", F.col("section").isNull().alias("no_section"), (F.length(F.coalesce("body", F.lit(""))) == 0).alias("no_text"),
        F.replace("url", F.lit("https://www."), F.lit("")).alias("shown"), F.substring("title", 1, 40).alias("head"),
    )


@query(f"SELECT seq, epoch_us(u) AS utc_us FROM (SELECT seq, {_ISO_UTC} AS u FROM {ARTICLES}) ORDER BY u NULLS LAST, seq")
def srt1_by_time(spark, sf_dir):
    """All articles in order of time, those without time last; a range sort."""
    timed = _articles(spark, sf_dir).select("seq", A.iso_utc(F.col("published")).alias("u")).orderBy(F.col("u").asc_nulls_last(), "seq")
    return timed.select("seq", F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("u")).alias("utc_us"))


@query()
def fn_tok2_ml8_subwords(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", subword_count(F.col("text")).alias("n_tokens"))
    return docs.withColumn("needs_chunking", F.col("n_tokens") > V.CHUNK_TOKENS).withColumn("n_chunks_est", T.chunks_needed(F.col("n_tokens")))


_DECODED = _compatible(r"regexp_replace(regexp_replace(regexp_replace(coalesce(body, ''), '<[^>]+>', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'), '[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{feff}]', '', 'g')")


@query(f"SELECT seq, md5({_DECODED}) AS digest FROM {ARTICLES}")
def fn_une_fn_nfkc_decoded(spark, sf_dir):
    """Bodies after entity decoding and NFKC, by digest."""
    return _articles(spark, sf_dir).select("seq", F.md5(T.decode(F.col("body"))).alias("digest"))


# ---- joins and deduplication -----------------------------------------------------------------------------------------------

@query(f"""SELECT url, array_to_string(list_sort(list_distinct(list(matched_terms))), '|') AS keywords, coalesce(array_to_string(list_sort(list_distinct(list(section) FILTER (section IS NOT NULL))), '|'), '') AS sections,
count(DISTINCT matched_terms) AS n_keyword_hits FROM {ARTICLES} GROUP BY url""")
def agg1_agg2_jn1_trail(spark, sf_dir):
    out = D.keyword_trail(_articles(spark, sf_dir), "url", {"keywords": "matched_terms", "sections": "section"}, "matched_terms")
    return out.select("url", "keywords", "sections", "n_keyword_hits")


@query(f"SELECT seq, url FROM {ARTICLES} QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1")
def dd1_first_by_url(spark, sf_dir):
    return D.keep_one(_articles(spark, sf_dir).select("seq", "url"), ["url"], "seq")


@query(f"SELECT seq FROM (SELECT seq, {_KEY('title')} AS k FROM {ARTICLES} WHERE title IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1")
def dd2_first_by_title(spark, sf_dir):
    titled = _articles(spark, sf_dir).select("seq", "title").filter("title is not null")
    return D.keep_one(titled, [T.title_key(F.col("title"))], "seq").select("seq")


@query(f"WITH {_RATES} SELECT CAST(date AS VARCHAR) AS date, kurs FROM valid")
def dd3_last_by_date(spark, sf_dir):
    parsed = R.parsed_rates(_t(spark, sf_dir, "rates_raw")).filter(f"date is not null and kurs > {V.MIN_RATE}")
    return D.keep_one(parsed, ["date"], "seq", last=True).select(*_iso("date"), "kurs")


@query(f"SELECT listing_id FROM archive_index i WHERE NOT EXISTS (SELECT 1 FROM {ARTICLES} a WHERE a.title = i.title) GROUP BY listing_id")
def jn5_not_done(spark, sf_dir):
    return D.not_done(_t(spark, sf_dir, "archive_index").select("listing_id", "title"), _articles(spark, sf_dir), "title").select("listing_id").distinct()


# ---- rates -----------------------------------------------------------------------------------------------------------------

@query(f"SELECT seq, {_NUMBER} AS number FROM rates_raw")
def fn_num_numbers(spark, sf_dir):
    return _t(spark, sf_dir, "rates_raw").select("seq", RF.number(F.col("kurs")).alias("number"))


@query(f"SELECT seq, CAST({_DATE} AS VARCHAR) AS date FROM rates_raw")
def fn_dat_dates(spark, sf_dir):
    return _t(spark, sf_dir, "rates_raw").select("seq", RF.rate_date(F.col("tanggal")).cast("string").alias("date"))


@query(f"WITH {_RATES} SELECT CAST(date AS VARCHAR) AS date, kurs, prev_kurs, gap_days, round(delta, 6) AS delta, round(log_return, 9) AS log_return, direction FROM rates")
def win1_to_win3_prj7_returns(spark, sf_dir):
    out = _rates(spark, sf_dir)
    return out.withColumn("date", F.col("date").cast("string")).withColumn("delta", F.round("delta", 6)).withColumn("log_return", F.round("log_return", 9))


@query(f"WITH {_RATES} SELECT count(*) AS n, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day, min(kurs) AS lowest, max(kurs) AS highest, max(gap_days) AS longest_gap FROM rates")
def agg10_rate_summary(spark, sf_dir):
    return P.rate_summary(_rates(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query(f"WITH {_RATES} SELECT direction, count(*) AS n FROM rates GROUP BY 1")
def agg11_directions(spark, sf_dir):
    return P.value_counts(_rates(spark, sf_dir), "direction")


# ---- alignment -------------------------------------------------------------------------------------------------------------

@query(f"{_WITH} SELECT url, CAST(target_date AS VARCHAR) AS target_date, CAST(target_date_lag1 AS VARCHAR) AS target_date_lag1, is_offhours, round(hours_to_fixing, 6) AS hours_to_fixing FROM aligned")
def tmp1_to_tmp6_jn3_jn4_aligned(spark, sf_dir):
    return _aligned(spark, sf_dir).select("url", *_iso("target_date", "target_date_lag1"), "is_offhours", F.round("hours_to_fixing", 6).alias("hours_to_fixing"))


@query(f"{_WITH} SELECT url, strftime(wib, '%Y-%m-%d %I:%M:%S %p WIB') AS date, dayname(wib) AS dow, year(wib) AS year FROM news")
def tmp7_tmp9_local_text(spark, sf_dir):
    wib = F.col("published_wib")
    return _features(spark, sf_dir).select("url", F.date_format(wib, "yyyy-MM-dd hh:mm:ss a 'WIB'").alias("date"), F.date_format(wib, "EEEE").alias("dow"), F.year(wib).alias("year"))


@query(f"WITH {_RATES} SELECT CAST(date AS VARCHAR) AS target_date, CAST(lead(date) OVER (ORDER BY date) AS VARCHAR) AS target_date_lag1 FROM rates")
def tmp8_win4_calendar(spark, sf_dir):
    return A.trading_calendar(_rates(spark, sf_dir)).select(*_iso("target_date", "target_date_lag1"))


@query(f"""{_WITH} SELECT CAST(date AS VARCHAR) AS date, n_news, round(mean_relevance, 6) AS mean_relevance, max_relevance, round(mean_tokens, 6) AS mean_tokens, round(pct_offhours, 6) AS pct_offhours,
md5(text_norm_concat) AS digest, window_hours, round(n_news / window_hours, 6) AS news_density, direction FROM merged""")
def agg3_to_agg7_jn2_tmp10_daily(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return _daily(spark, sf_dir, with_text=True).select(
        *_iso("date"), "n_news", r("mean_relevance"), "max_relevance", r("mean_tokens"), r("pct_offhours"), F.md5("text_norm_concat").alias("digest"), "window_hours", r("news_density"), "direction"
    )


@query(f"""{_WITH}, d AS (SELECT * FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday')) t(pos, dow)),
g AS (SELECT dayname(date) AS dow, avg(window_hours) AS w, avg(n_news) AS n FROM merged GROUP BY 1)
SELECT pos, d.dow, round(w, 3) AS window_hours, round(n, 3) AS n_news, round(n / w, 3) AS news_per_hour FROM d LEFT JOIN g ON d.dow = g.dow""")
def agg8_weekdays(spark, sf_dir):
    return P.weekday_density(_daily(spark, sf_dir))


@query(f"""{_WITH} SELECT count(*) AS days, round(avg(CASE WHEN n_news > 0 THEN 100.0 ELSE 0 END), 6) AS coverage, round(avg(n_news), 6) AS mean_news, median(n_news) AS median_news,
count(*) FILTER (n_news = 0) AS zero_days, avg(CASE WHEN n_news > 0 THEN 100.0 ELSE 0 END) < 90 AS too_low FROM merged""")
def agg9_agg18_coverage(spark, sf_dir):
    return P.coverage(_daily(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6)).withColumn("mean_news", F.round("mean_news", 6))


@query(f"""{_WITH}, m AS (SELECT date, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM merged WHERE n_news > 0)
SELECT CAST(date AS VARCHAR) AS date, CASE WHEN rn <= floor(n * (1 - 0.2)) THEN 'train' ELSE 'test' END AS part FROM m""")
def flt12_win6_spl1_split(spark, sf_dir):
    return S.chronological_split(_daily(spark, sf_dir).filter("n_news > 0").select(*_iso("date")), "date")


# ---- lexicon and text ------------------------------------------------------------------------------------------------------

@query(f"SELECT doc_id, CAST({_SCORE('text')} AS BIGINT) AS score, {_TERMS('text')} AS terms, {_NEG('text', True)} AS negative, {_NEG('text', False)} AS negative_inside FROM documents")
def lex1_to_lex5_scores(spark, sf_dir):
    t = F.col("text")
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    scored = T.computed_once(docs, {"m": T.matched_terms(t), "negative": T.has_negative(t), "negative_inside": T.has_negative(t, whole_words=False)})
    return scored.select("doc_id", T.lexicon_score(F.col("m")).alias("score"), F.array_join("m", "|").alias("terms"), "negative", "negative_inside")


@query(f"SELECT title_score, count(*) AS n FROM {ARTICLES} GROUP BY 1 ORDER BY 1")
def agg12_score_counts(spark, sf_dir):
    return P.value_counts(_articles(spark, sf_dir), "title_score").orderBy("title_score")


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest(string_split(matched_terms, '|')) AS term FROM {ARTICLES}) WHERE term <> '' GROUP BY 1 ORDER BY n DESC, term LIMIT 15")
def agg13_top_terms(spark, sf_dir):
    return P.term_counts(_articles(spark, sf_dir), "matched_terms")


@query(f"SELECT seq, url, title_score FROM {ARTICLES} ORDER BY title_score DESC, seq LIMIT 20")
def top1_top_rows(spark, sf_dir):
    return S.top_rows(_articles(spark, sf_dir).select("seq", "url", "title_score"), "title_score", "seq", 20)


@query(f"SELECT doc_id, md5({_clean_sql("text", V.BOILERPLATE_TERMS)}) AS digest FROM documents")
def fn_cln1_clean_terms(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_terms(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5({_clean_sql("text", V.BOILERPLATE_TRANSFORMER)}) AS digest FROM documents")
def fn_cln2_cln3_clean_transformer(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_transformer(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5({_NORM('text')}) AS digest FROM documents")
def fn_nrm_normal(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.normal_terms(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, {_TOKENS('text')} AS tokens, CAST(CASE WHEN {_TOKENS('text')} <= 512 THEN 1 ELSE 1 + ceil(({_TOKENS('text')} - 512) / 462.0) END AS BIGINT) AS chunks FROM documents")
def fn_tok1_fn_chk_counts(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("tokens", T.token_count(F.col("text")))
    return docs.select("doc_id", "tokens", T.chunks_needed(F.col("tokens")).alias("chunks"))


@query(f"SELECT seq, {_KEY('title')} AS key FROM {ARTICLES}")
def fn_str6_title_keys(spark, sf_dir):
    return _articles(spark, sf_dir).select("seq", T.title_key(F.col("title")).alias("key"))


@query(rf"SELECT seq, CAST(CAST(try_strptime(regexp_extract(url, '/(\d{{4}}/\d{{2}}/\d{{2}})/', 1), '%Y/%m/%d') AS DATE) AS VARCHAR) AS link_date FROM {ARTICLES}")
def fn_slc_link_dates(spark, sf_dir):
    return _articles(spark, sf_dir).select("seq", X.link_date(F.col("url")).cast("string").alias("link_date"))


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(text, {_q('(?i)' + chr(92) + 'b(?:' + '|'.join(words) + ')' + chr(92) + 'b')}) THEN {_q(name)} END" for name, words in V.KEYWORD_GROUPS.items()
) + "], lambda x: x IS NOT NULL), '|') AS groups FROM documents")
def lex6_keyword_groups(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(T.keyword_groups(F.col("text")), "|").alias("groups"))


@query(f"SELECT seq, url FROM {ARTICLES} WHERE section IS NULL ORDER BY seq LIMIT 10")
def top2_head(spark, sf_dir):
    """The first ten articles without section, for a report."""
    return S.first_rows(_articles(spark, sf_dir).filter("section is null").select("seq", "url"), "seq", 10)


# ---- reports ---------------------------------------------------------------------------------------------------------------

_LIVE = f"regexp_matches(lower(coalesce(title, '')), 'watch|{V.LIVE_BLOG}')"


@query(f"SELECT {_LIVE} AS grp, count({_TOKENS('body')}) AS n, min({_TOKENS('body')}) AS least, round(avg({_TOKENS('body')}), 6) AS mean, max({_TOKENS('body')}) AS greatest, count(*) FILTER ({_TOKENS('body')} > 512) AS n_over FROM {ARTICLES} GROUP BY 1")
def agg14_described(spark, sf_dir):
    a = _articles(spark, sf_dir)
    grp = F.lower(F.coalesce(F.col("title"), F.lit(""))).rlike("watch|" + V.LIVE_BLOG)
    return P.described(a, grp, T.token_count(F.col("body")), 512).withColumn("mean", F.round("mean", 6))


@query(f"SELECT CAST(substr(index_date, 1, 4) AS INT) AS year, count(*) AS total, count(*) FILTER (regexp_matches(lower(coalesce(title, '')), 'embargo')) AS topic, count(*) FILTER ({_LIVE}) AS live FROM {ARTICLES} GROUP BY 1")
def agg15_jn6_yearly(spark, sf_dir):
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    return P.yearly_counts(_articles(spark, sf_dir), F.substring("index_date", 1, 4).cast("int"), {"topic": title.rlike("embargo"), "live": title.rlike("watch|" + V.LIVE_BLOG)})


@query(f"""WITH f AS (SELECT NOT {_PAID} AS a, title IS NOT NULL AS b, body IS NOT NULL AS c FROM {ARTICLES}),
s AS (SELECT 0 AS step, 'input' AS stage, count(*) AS rows FROM f UNION ALL SELECT 1, 'open', count(*) FILTER (a) FROM f UNION ALL SELECT 2, 'titled', count(*) FILTER (a AND b) FROM f
UNION ALL SELECT 3, 'with body', count(*) FILTER (a AND b AND c) FROM f) SELECT step, stage, rows, round(rows / nullif(lag(rows) OVER (ORDER BY step), 0) * 100 - 100, 1) AS pct FROM s""")
def agg16_funnel(spark, sf_dir):
    stages = [("open", ~S.paid(F.col("section"))), ("titled", F.col("title").isNotNull()), ("with body", F.col("body").isNotNull())]
    return P.funnel(_articles(spark, sf_dir), stages)


@query(f"""SELECT count(*) AS n, count(body) AS n_body, count(published) AS n_published, count(DISTINCT index_date) AS days, round(count(*) / count(DISTINCT index_date), 6) AS per_day, count(*) < 10000 AS too_few,
count(DISTINCT index_date) < 0.7 * (DATE '{V.LAST_DAY}' - DATE '{V.FIRST_DAY}' + 1) AS too_few_days FROM {ARTICLES}""")
def agg17_collection(spark, sf_dir):
    return P.collection_summary(_articles(spark, sf_dir), "index_date", ["body", "published"], period=(V.FIRST_DAY, V.LAST_DAY)).withColumn("per_day", F.round("per_day", 6))


@query(f"""WITH y AS (SELECT site, count(*) AS n FROM {ARTICLES} GROUP BY 1), t AS (SELECT count(*) AS a FROM {ARTICLES})
SELECT site, CAST(round_even(500.0 / a * n, 0) AS BIGINT) AS n FROM y, t WHERE round_even(500.0 / a * n, 0) > 0""")
def smp1_stratified_sizes(spark, sf_dir):
    return S.stratified_sample(_articles(spark, sf_dir).select("seq", "site"), F.col("site"), "seq", 500).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT seq, index_date FROM (SELECT seq, index_date, row_number() OVER (PARTITION BY substr(index_date, 1, 4) ORDER BY seq) AS r FROM {ARTICLES}) WHERE r <= 35")
def smp2_first_per_year(spark, sf_dir):
    return S.first_per_stratum(_articles(spark, sf_dir).select("seq", "index_date"), F.substring("index_date", 1, 4), "seq", 35)


# ---- extraction ------------------------------------------------------------------------------------------------------------

def _escaped(text):
    """Text as it stands in HTML."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query("""SELECT site AS page_id, url, min_by(trim(title), listing_id) AS title FROM archive_index
WHERE regexp_matches(url, '/\\d{4}/\\d{2}/\\d{2}/') AND length(trim(title)) >= 15 GROUP BY site, url""")
def ext1_dd4_archive_links(spark, sf_dir):
    """Archive pages built from the listings, one per site and hundred listings, and their links taken out again."""
    index = _t(spark, sf_dir, "archive_index")
    anchor = F.concat(F.lit('<li><a href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('">'), _escaped(F.col("title")), F.lit("</a></li>"))
    page = F.floor(F.col("listing_id") / 100)
    rows = index.groupBy("site", page.alias("_p")).agg(F.array_sort(F.collect_list(F.struct("listing_id", anchor.alias("a")))).alias("x"))
    html = F.concat(F.lit("<html><body><a href='/'>Home</a><ul>"), F.array_join(F.transform("x", lambda r: r["a"]), "\n"), F.lit("</ul></body></html>"))
    pages = rows.select(F.concat_ws(" ", "site", "_p").alias("page_id"), F.lit(None).cast("date").alias("date"), html.alias("html"))
    got = X.archive_links(pages, "https://archive.example", ".example").withColumn("_n", F.substring_index("page_id", " ", -1).cast("bigint"))
    return got.groupBy(F.substring_index("page_id", " ", 1).alias("page_id"), "url").agg(F.min_by("title", "_n").alias("title"))


@query(r"""SELECT DISTINCT site || ' ' || index_date AS page_id, url, index_date AS date FROM archive_index
WHERE regexp_matches(url, '/\d{4}/\d{2}/\d{2}/[a-z0-9\-]+\.html') AND regexp_extract(url, '/(\d{4}/\d{2}/\d{2})/', 1) = replace(index_date, '-', '/') AND length(trim(title)) >= 15""")
def ext2_strict_links(spark, sf_dir):
    """Archive pages of one site and day, and the links on them that name the page's own date."""
    index = _t(spark, sf_dir, "archive_index")
    anchor = F.concat(F.lit('<a href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('">'), _escaped(F.col("title")), F.lit("</a>"))
    pages = index.groupBy(F.concat_ws(" ", "site", "index_date").alias("page_id"), F.col("index_date").cast("date").alias("date")).agg(F.array_join(F.collect_list(anchor), "").alias("html"))
    got = X.archive_links(pages, "https://archive.example", ".example", strict=True)
    return got.select("page_id", "url", F.col("date").cast("string").alias("date"))


_STRIP = r"regexp_replace({}, '^[\s\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+|[\s\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+$', '', 'g')"


@query(f"""SELECT seq, nullif(title, '') AS title, nullif(published, '') AS published, section, author,
CASE WHEN len(p) >= 3 THEN md5(array_to_string(p, ' ')) END AS digest FROM (SELECT *, coalesce(list_filter(list_transform(string_split(body, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), []) AS p FROM {ARTICLES})""")
def ext3_to_ext6_articles(spark, sf_dir):
    """Pages built from the articles, linked data for some fields, a meta tag and paragraphs for others, and their fields taken out again."""
    a = _articles(spark, sf_dir)
    data = F.to_json(F.struct(
        F.lit("NewsArticle").alias("@type"), F.col("title").alias("headline"), F.col("published").alias("datePublished"), F.struct(F.col("author").alias("name")).alias("author")
    ))
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    meta = F.coalesce(F.concat(F.lit('<meta property="article:section" content="'), escape(F.col("section")), F.lit('">')), F.lit(""))
    lines = F.filter(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: x.rlike(r"(?U)\S"))
    paras = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), escape(x), F.lit("</p>"))), "")
    html = F.concat(F.lit("<html><head>"), meta, F.lit('<script type="application/ld+json">'), data, F.lit("</script></head><body><article>"), paras, F.lit("</article></body></html>"))
    got = X.articles_from_pages(a.select(F.col("seq").alias("url"), html.alias("html")))
    return got.select(F.col("url").alias("seq"), "title", "published", "section", "author", F.md5("body").alias("digest"))


# ---- measures and model ----------------------------------------------------------------------------------------------------

_PRED = "SELECT CASE WHEN value > 20 THEN 'up' WHEN value < 5 THEN 'down' ELSE 'flat' END AS a, CASE WHEN user_id % 3 = 0 THEN 'up' WHEN user_id % 3 = 1 THEN 'down' ELSE 'flat' END AS p FROM events"


def _predicted(spark, sf_dir):
    v, u = F.col("value"), F.pmod(F.col("user_id"), F.lit(3))
    return _t(spark, sf_dir, "events").select(
        F.when(v > 20, "up").when(v < 5, "down").otherwise("flat").alias("a"), F.when(u == 0, "up").when(u == 1, "down").otherwise("flat").alias("p")
    )


@query(f"SELECT a, count(*) AS n FROM ({_PRED}) GROUP BY 1 ORDER BY n DESC, a LIMIT 1")
def ml3_majority(spark, sf_dir):
    return M.majority(_predicted(spark, sf_dir), "a")


@query(f"""WITH x AS ({_PRED}), l AS (SELECT DISTINCT a AS label FROM x), c AS (SELECT label, count(*) FILTER (a = label) AS support, count(*) FILTER (p = label) AS guessed, count(*) FILTER (a = label AND p = label) AS hit FROM x, l GROUP BY label),
m AS (SELECT label, hit, support, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m), u AS (
SELECT label, precision, recall, f1, support FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f
UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM u""")
def ml5_measures(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return M.class_measures(_predicted(spark, sf_dir), "a", "p").select("label", r("precision"), r("recall"), r("f1"), "support")


@query(f"SELECT a AS actual, count(*) FILTER (p = 'down') AS down, count(*) FILTER (p = 'flat') AS flat, count(*) FILTER (p = 'up') AS up FROM ({_PRED}) GROUP BY 1")
def ml6_confusion(spark, sf_dir):
    return M.confusion(_predicted(spark, sf_dir), "a", "p", ["down", "flat", "up"])


_TRAIN = f"""{_WITH}, days AS (SELECT date, text_norm_concat AS text, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM merged WHERE n_news > 0),
train AS (SELECT date, regexp_extract_all(text, '[a-z0-9_][a-z0-9_]+') AS w FROM days WHERE rn <= floor(n * (1 - 0.2))),
terms AS (SELECT date, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM train)"""


def _split_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train and test days with news: ``date``, ``text_norm_concat``, ``direction``."""
    daily = cut_lineage(_daily(spark, sf_dir, with_text=True).filter("n_news > 0").select("date", "text_norm_concat", "direction"))
    # the split's window takes all days in one task, so the texts stay out of it
    days = cut_lineage(S.chronological_split(daily.select("date"), "date"))
    return tuple(daily.join(F.broadcast(days.filter(F.col("part") == p).select("date")), "date", "left_semi") for p in ("train", "test"))


def _fitted(train: DataFrame):
    labels = sorted(r[0] for r in train.select("direction").distinct().collect())  # at most three
    index = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("direction")) - 1
    weights = M.TermWeights().fit(train, "text_norm_concat")
    x = M.balanced(weights.transform(train).withColumn("y", index.cast("double")), "direction")
    return labels, weights, M.fit_classifier(x, "y")


@query(f"""{_TRAIN}, c AS (SELECT term, count(*) AS tf, count(DISTINCT date) AS df FROM terms GROUP BY term), n AS (SELECT count(*) AS n FROM train)
SELECT term, tf, df, round(ln((n + 1.0) / (df + 1)) + 1, 9) AS idf FROM c, n WHERE df >= 5 AND df <= 0.8 * n ORDER BY tf DESC, term LIMIT 5000""")
def ml2_vocabulary(spark, sf_dir):
    """Terms of the training days with their counts and weights."""
    return M.TermWeights().table(_split_days(spark, sf_dir)[0], "text_norm_concat").withColumn("idf", F.round("idf", 9))


@query()
def ml2_ml4_ml7_top_terms(spark, sf_dir):
    """Terms that speak most for each direction of the rate, from a model of the days' relevant news over whole texts."""
    labels, weights, model = _fitted(_split_days(spark, sf_dir)[0])
    return spark.createDataFrame(M.top_terms(model, weights.vocabulary, labels), "direction string, rank int, term string, coefficient double")


@query()
def ml4_ml5_test_report(spark, sf_dir):
    """Measures of that model on the days after those it was trained on, and the accuracy of always saying the commonest class."""
    train, test = _split_days(spark, sf_dir)
    labels, weights, model = _fitted(train)
    name = F.element_at(F.array(*(F.lit(x) for x in labels)), (F.col("prediction") + 1).cast("int"))
    told = cut_lineage(model.transform(weights.transform(test)).select(F.col("direction").alias("a"), name.alias("p")))
    commonest = M.majority(train.select("direction"), "direction").select(F.col("direction").alias("d"))
    dummy = M.class_measures(told.join(F.broadcast(commonest)).select("a", F.col("d").alias("p")), "a", "p").filter("label = 'accuracy'").withColumn("label", F.lit("always the commonest"))
    r = lambda c: F.round(c, 6).alias(c)
    return M.class_measures(told, "a", "p").unionAll(dummy).select("label", r("precision"), r("recall"), r("f1"), "support")


# ---- whole pipelines -------------------------------------------------------------------------------------------------------

_STAMPS = "CAST(published_utc AS VARCHAR) AS published_utc, CAST(wib AS VARCHAR) AS published_wib"
_TARGETS = "CAST(target_date AS VARCHAR) AS target_date, CAST(target_date_lag1 AS VARCHAR) AS target_date_lag1, is_offhours, round(hours_to_fixing, 6) AS hours_to_fixing"


@query(f"{_WITH} SELECT url, md5(text_norm) AS digest, section, {_STAMPS}, relevance_score, matched_terms FROM news")
def plan_news_features(spark, sf_dir):
    return _features(spark, sf_dir).select("url", F.md5("text_norm").alias("digest"), "section", *_iso("published_utc", "published_wib"), "relevance_score", "matched_terms")


@query()
def plan_transformer_news(spark, sf_dir):
    return pipelines.transformer_news(_records(spark, sf_dir), _rates(spark, sf_dir))


@query(f"""{_WITH}, said AS (SELECT *, {_clean_sql("title", V.BOILERPLATE_TRANSFORMER, V.LEADING_LABEL, V.TRAILING_FOOTER)} AS c1, length(coalesce(body, '')) = 0 AS used_description_fallback,
  {_clean_sql("CASE WHEN length(coalesce(body, '')) = 0 THEN description ELSE body END", V.BOILERPLATE_TRANSFORMER, V.LEADING_LABEL, V.TRAILING_FOOTER)} AS c2, {_ISO_UTC} + INTERVAL 7 HOUR AS wib FROM by_url),
whole AS (SELECT *, trim(trim(rtrim(c1, '. ') || '. ' || c2, '. ')) AS text_clean, CAST(wib AS DATE) + CASE WHEN hour(wib) >= 8 THEN 1 ELSE 0 END AS candidate FROM said)
SELECT url, strftime(wib, '%Y-%m-%d %I:%M:%S %p WIB') AS date, title, md5(text_clean) AS digest, {_TOKENS("text_clean")} AS n_tokens, {_TOKENS("text_clean")} > 512 AS needs_chunking,
  CAST(CASE WHEN {_TOKENS("text_clean")} <= 512 THEN 1 ELSE 1 + ceil(({_TOKENS("text_clean")} - 512) / 462.0) END AS BIGINT) AS n_chunks_est, used_description_fallback, section, CAST(k.target_date AS VARCHAR) AS target_date,
  CAST(k.target_date_lag1 AS VARCHAR) AS target_date_lag1, coalesce(isodow(wib) >= 6 OR hour(wib) >= 8, false) AS is_offhours,
  round((epoch_us(CAST(k.target_date AS TIMESTAMP) + INTERVAL 8 HOUR) - epoch_us(wib)) / 3600000000.0, 6) AS hours_to_fixing
FROM whole w ASOF LEFT JOIN cal k ON w.candidate <= k.target_date WHERE text_clean <> ''""")
def plan_transformer_words(spark, sf_dir):
    """The transformer's table with words for tokens, which SQL can count."""
    out = pipelines.transformer_news(_records(spark, sf_dir), _rates(spark, sf_dir), count_tokens=T.token_count)
    return out.withColumns({"digest": F.md5("text_clean"), "hours_to_fixing": F.round("hours_to_fixing", 6), **{c: F.col(c).cast("string") for c in ("target_date", "target_date_lag1")}}).drop("text_clean")


@query(f"""{_WITH} SELECT CAST(date AS VARCHAR) AS date, kurs, direction, n_news, round(mean_relevance, 6) AS mean_relevance, max_relevance, round(mean_tokens, 6) AS mean_tokens,
round(pct_offhours, 6) AS pct_offhours, window_hours FROM merged""")
def plan_daily_table(spark, sf_dir):
    """The daily table without the days' texts, which :func:`plan_daily_texts` has row by row."""
    r = lambda c: F.round(c, 6).alias(c)
    return _daily(spark, sf_dir).select(*_iso("date"), "kurs", "direction", "n_news", r("mean_relevance"), "max_relevance", r("mean_tokens"), r("pct_offhours"), "window_hours")


@query(f"{_WITH} SELECT CAST(target_date AS VARCHAR) AS date, CAST(published_utc AS VARCHAR) AS published_utc, url, md5(text_norm) AS digest FROM aligned WHERE target_date IS NOT NULL AND text_norm <> ''")
def plan_daily_texts(spark, sf_dir):
    return A.daily_texts(pipelines.aligned_news(_features(spark, sf_dir), _rates(spark, sf_dir))).select(*_iso("date", "published_utc"), "url", F.md5("text_norm").alias("digest"))


@query(f"{_WITH} SELECT url, md5(text_norm) AS digest, section, {_STAMPS}, relevance_score, matched_terms, n_tokens, {_TARGETS} FROM aligned WHERE target_date IS NOT NULL")
def plan_aligned_news(spark, sf_dir):
    out = pipelines.aligned_news(_features(spark, sf_dir), _rates(spark, sf_dir))
    return out.select(
        "url", F.md5("text_norm").alias("digest"), "section", *_iso("published_utc", "published_wib"), "relevance_score", "matched_terms", "n_tokens",
        *_iso("target_date", "target_date_lag1"), "is_offhours", F.round("hours_to_fixing", 6).alias("hours_to_fixing"),
    )


@query(f"""{_WITH}, f AS (SELECT t.seq IS NOT NULL AS u, y.seq IS NOT NULL AS y, s.seq IS NOT NULL AS a, coalesce(long_enough, false) AS l, coalesce(relevance_score >= {V.MIN_SCORE} AND NOT has_negative, false) AS k,
  published_utc IS NOT NULL AS p FROM records r LEFT JOIN (SELECT seq FROM by_url) t USING (seq) LEFT JOIN (SELECT seq FROM by_title) y USING (seq) LEFT JOIN scored s USING (seq)),
g AS (SELECT 0 AS step, 'input' AS stage, count(*) AS rows FROM f UNION ALL SELECT 1, 'first of url', count(*) FILTER (u) FROM f UNION ALL SELECT 2, 'first of title', count(*) FILTER (u AND y) FROM f
UNION ALL SELECT 3, 'text article', count(*) FILTER (u AND y AND a) FROM f UNION ALL SELECT 4, 'long enough', count(*) FILTER (u AND y AND a AND l) FROM f
UNION ALL SELECT 5, 'relevant', count(*) FILTER (u AND y AND a AND l AND k) FROM f UNION ALL SELECT 6, 'timed', count(*) FILTER (u AND y AND a AND l AND k AND p) FROM f)
SELECT step, stage, rows, round(rows / nullif(lag(rows) OVER (ORDER BY step), 0) * 100 - 100, 1) AS pct FROM g""")
def plan_funnel(spark, sf_dir):
    """Records left after each stage on the way to the features."""
    return P.funnel(pipelines.funnel_flags(_records(spark, sf_dir)), pipelines.funnel_stages())


@query(f"{_WITH} SELECT strftime(target_date, '%Y-%m-01') AS month, count(*) AS n, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM aligned WHERE target_date IS NOT NULL GROUP BY 1")
def snk6_aligned_table(spark, sf_dir):
    """The aligned news as a new table beside the features that it was made from, counted from the table."""
    path = shared_folder(spark, "aligned")
    out = pipelines.land_aligned(_features(spark, sf_dir), _rates(spark, sf_dir), path)
    return out.groupBy(F.trunc("target_date", "month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"))


@query(SQL["agg8_weekdays"])
def plan_weekdays(spark, sf_dir):
    return P.weekday_density(_daily(spark, sf_dir))


@query(SQL["agg9_agg18_coverage"].replace("round(avg(n_news), 6)", "avg(n_news)").replace("round(avg(CASE WHEN n_news > 0 THEN 100.0 ELSE 0 END), 6)", "avg(CASE WHEN n_news > 0 THEN 1.0 ELSE 0 END) * 100"))
def plan_coverage(spark, sf_dir):
    return P.coverage(_daily(spark, sf_dir))


@query(SQL["flt12_win6_spl1_split"])
def plan_split(spark, sf_dir):
    return S.chronological_split(_daily(spark, sf_dir).filter("n_news > 0").select(*_iso("date")), "date")
