"""Queries of the training-data operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.operators.timestamp_mixture import article_instants
from marketweave.session import spread

ARTICLES = "batch_1789375807_210"
TOLERANCE_US = 15 * 60 * 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in (ARTICLES, "documents") else table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.merkle import copy_pairs

    return copy_pairs(_table(spark, sf_dir, ARTICLES))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.merkle import collapse

    return collapse(_table(spark, sf_dir, ARTICLES))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.residue import residue_articles

    return residue_articles(_table(spark, sf_dir, ARTICLES), source="site").select("seq")


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.residue import residue_articles

    articles = _table(spark, sf_dir, ARTICLES)
    return articles.select("seq", "site").join(residue_articles(articles, source="site").select("seq"), "seq", "left_anti")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.unicode_forms import odd_words

    return odd_words(_table(spark, sf_dir, ARTICLES), "seq", ("body", "description")).select("seq", "field").distinct()


def p4_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.unicode_forms import unify

    return unify(_table(spark, sf_dir, ARTICLES), "seq", ("body", "description"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.repeated_lines import repeated_lines

    return repeated_lines(_table(spark, sf_dir, ARTICLES), "seq", "site", "body")[1].select("seq", "line_no")


def p5_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.repeated_lines import repeated_sequences

    return repeated_sequences(_table(spark, sf_dir, ARTICLES), "seq", "site", "body", gaps=True)[0]


def p5_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.repeated_lines import without_repeated_lines

    return without_repeated_lines(_table(spark, sf_dir, ARTICLES), "seq", "site", "body")


def _story_times(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    articles, sites = _table(spark, sf_dir, ARTICLES), _table(spark, sf_dir, "sites")
    told = articles.filter("story_id is not null")
    left = article_instants(told, sites, ("published",), keep=("story_id",)).select("seq", "story_id", "utc_us")
    quotes = _table(spark, sf_dir, "story_quotes")
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(quoted_at as timestamp_ntz))")
    return left, quotes.select("quote_id", "story_id", at.alias("quoted_us"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.nearest_time import nearest_in_time

    left, quotes = _story_times(spark, sf_dir)
    return nearest_in_time(left, quotes, "story_id", "seq", "utc_us", "quote_id", "quoted_us", TOLERANCE_US).select("seq", "quote_id")


def p6_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with its nearest quote and the distance, or none."""
    from marketweave.llm.nearest_time import nearest_in_time

    left, quotes = _story_times(spark, sf_dir)
    pairs = nearest_in_time(left, quotes, "story_id", "seq", "utc_us", "quote_id", "quoted_us", TOLERANCE_US)
    return _table(spark, sf_dir, ARTICLES).select("seq").join(pairs, "seq", "left")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.split import split_text

    pieces = split_text(_table(spark, sf_dir, ARTICLES), "seq", "body", only_over=True)
    return pieces.filter((F.col("piece_no") == 2) & (F.length("piece") > 0)).select("seq")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.split import split_text

    return split_text(_table(spark, sf_dir, ARTICLES), "seq", "body", only_over=True)


def p7_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each article put together again, and whether all kept to the limit and the overlap."""
    pieces = p7_pieces(spark, sf_dir)
    new = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.substring("piece", 201, 3000))
    rows = F.array_sort(F.collect_list(F.struct("piece_no", new.alias("new"))))
    joined = pieces.groupBy("seq").agg(rows.alias("x"), (F.max(F.length("piece")) <= 3000).alias("fits"))
    return joined.select("seq", F.md5(F.array_join(F.transform("x", lambda r: r["new"]), "")).alias("digest"), "fits")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.tokens import with_token_counts

    return with_token_counts(_table(spark, sf_dir, "documents"), ["doc_id", "source"])


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.packing import pack_items

    return pack_items(_counted(spark, sf_dir), "doc_id", "tokens")


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, containers over their capacity, and documents cut although they fit into one."""
    packed = p8_containers(spark, sf_dir)
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("part_size").alias("size"))
    docs = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("size") <= 2048)).alias("cut_small"))
    held = packed.groupBy("container").agg(F.sum("part_size").alias("size")).agg(F.count_if(F.col("size") > 2048).alias("overfull"))
    return docs.join(held)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.mixing import mix_sources

    return mix_sources(_counted(spark, sf_dir), _table(spark, sf_dir, "source_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.mixing import mix_sources

    return mix_sources(_counted(spark, sf_dir), _table(spark, sf_dir, "source_targets"))[1]


def p9_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in the mix without a target, and parts of documents used more often than allowed or twice in one round."""
    targets = _table(spark, sf_dir, "source_targets")
    used = p9_mix(spark, sf_dir).groupBy("source", "doc_id", "token_start").agg(F.count(F.lit(1)).alias("n"), F.max("round").alias("last"), F.count_distinct("round").alias("rounds"))
    used = used.join(F.broadcast(targets), "source", "left")
    return used.agg(F.count_if(F.col("target_share").isNull()).alias("untargeted"), F.count_if(F.col("n") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("n") > F.col("rounds")).alias("twice"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).filter("level = 5").select("doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketweave.llm.reading_level import reading_levels

    return reading_levels(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "level_labels"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_collapsed, p2_found, p2_kept, p4_found, p4_unified, p5_found, p5_sequences, p5_cleaned, p6_found, p6_paired, p7_found, p7_pieces, p7_rejoined,
    p8_containers, p8_checked, p9_mix, p9_shares, p9_checked, p10_found, p10_levels,
)}

_NORMAL = r"replace(regexp_replace(lower(upper({})), '[^\p{{L}}\p{{N}}]+', '', 'g'), 'ß', 'ss')"
_P1_FORMS = f"""
WITH parts AS (
  SELECT seq, {_NORMAL.format("title")} AS t,
         {_NORMAL.format("CASE WHEN instr(url, '?') > 0 THEN substr(url, 1, instr(url, '?') - 1) ELSE url END")} AS p,
         list_sort(list_distinct(list_filter(list_transform(
           regexp_split_to_array(CASE WHEN instr(url, '?') > 0 THEN substr(url, instr(url, '?') + 1) ELSE '' END, '[&;]'),
           lambda x: {_NORMAL.format("split_part(x, '=', 1)")} || chr(1) || {_NORMAL.format("CASE WHEN instr(x, '=') > 0 THEN substr(x, instr(x, '=') + 1) ELSE '' END")}
         ), lambda y: y <> chr(1)))) AS q
  FROM {ARTICLES} WHERE title IS NOT NULL
), groups AS (SELECT t, p, q, min(seq) AS seq_first, count(*) AS copies FROM parts GROUP BY t, p, q)
"""
_SUSPECT = r"[\x{FF01}-\x{FF60}\x{FFE0}-\x{FFEE}\x{FB00}-\x{FB06}]|[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]|[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_MIXED = r"\p{Latin}\p{M}*[\p{Cyrillic}\p{Greek}\p{Armenian}]|[\p{Cyrillic}\p{Greek}\p{Armenian}]\p{M}*\p{Latin}"
SQL = {
    "p1_found": _P1_FORMS + """SELECT seq_first, seq AS seq_copy FROM parts JOIN groups USING (t, p, q) WHERE seq <> seq_first""",
    "p1_collapsed": _P1_FORMS + f"""SELECT seq_first AS seq, copies FROM groups UNION ALL SELECT seq, 1 FROM {ARTICLES} WHERE title IS NULL""",
    "p4_found": f"""
SELECT seq, field FROM (
  SELECT seq, 'body' AS field, body AS x FROM {ARTICLES} UNION ALL SELECT seq, 'description', description FROM {ARTICLES}
) WHERE regexp_matches(x, '{_SUSPECT}') OR regexp_matches(x, '{_MIXED}') OR nfc_normalize(x) <> x""",
    "p5_found": f"""
WITH lines AS (
  SELECT seq, site, generate_subscripts(parts, 1) AS line_no,
         regexp_replace(unnest(parts), '^[\\s\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+|[\\s\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+$', '', 'g') AS line
  FROM (SELECT seq, site, string_split(body, chr(10)) AS parts FROM {ARTICLES} WHERE body IS NOT NULL)
), frequent AS (SELECT site, line FROM lines WHERE line <> '' GROUP BY site, line HAVING count(DISTINCT seq) >= 10)
SELECT seq, CAST(line_no AS BIGINT) AS line_no FROM lines JOIN frequent USING (site, line)""",
    "p5_cleaned": f"""
WITH lines AS (
  SELECT seq, site, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS raw,
         regexp_replace(unnest(parts), '^[\\s\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+|[\\s\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+$', '', 'g') AS line
  FROM (SELECT seq, site, string_split(body, chr(10)) AS parts FROM {ARTICLES} WHERE body IS NOT NULL)
), frequent AS (SELECT site, line, true AS often FROM lines WHERE line <> '' GROUP BY site, line HAVING count(DISTINCT seq) >= 10),
left_ AS (SELECT seq, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (often IS NULL), '') AS body, count(*) FILTER (often) AS removed FROM lines LEFT JOIN frequent USING (site, line) GROUP BY seq)
SELECT seq, l.body, coalesce(removed, 0) AS removed FROM (SELECT seq FROM {ARTICLES}) LEFT JOIN left_ l USING (seq)""",
    "p7_rejoined": f"SELECT seq, md5(body) AS digest, true AS fits FROM {ARTICLES} WHERE length(body) > 3000",
    "p8_checked": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS cut_small, CAST(0 AS BIGINT) AS overfull FROM documents",
    "p9_checked": "SELECT CAST(0 AS BIGINT) AS untargeted, CAST(0 AS BIGINT) AS too_often, CAST(0 AS BIGINT) AS twice",
    "p7_found": f"SELECT seq FROM {ARTICLES} WHERE length(body) > 3000",
}
