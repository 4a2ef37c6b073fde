"""Ingestion and profiles: chunks, quality, document types, sources, corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as T
from factloom.registry import query
from factloom.sources.files import assemble, page_blocks
from factloom.sources.tables import load

W_SQL = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+')"


@query(
    rf"""WITH d AS (SELECT doc_id, {W_SQL} AS w FROM documents),
    s AS (SELECT doc_id, w, len(w) AS n, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 400 THEN [0] ELSE range(0, len(w), 350) END AS starts FROM d)
    SELECT doc_id, (s0 // 350)::BIGINT AS ordinal, least(400, n - s0)::BIGINT AS token_count, sha256(array_to_string(w[s0 + 1 : s0 + 400], ' ')) AS text_hash
    FROM s, unnest(starts) AS t(s0)"""
)
def c1_chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 400 words every 350; the last may lie inside the one before."""
    docs = load(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    rows = docs.select("doc_id", "w", F.posexplode(T.window_starts(F.size("w"))).alias("ordinal", "start"))
    part = F.slice("w", F.col("start") + 1, 400)
    return rows.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.size(part).cast("bigint").alias("token_count"), F.sha2(F.array_join(part, " "), 256).alias("text_hash"))


@query(
    rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {W_SQL} AS w, string_split_regex(coalesce(text, ''), '{T.WORD}') AS g FROM documents),
    e AS (SELECT doc_id, unnest(w) AS w, unnest(g[: len(w)]) AS g, generate_subscripts(w, 1) AS i FROM d),
    u AS (SELECT doc_id, i, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, length(w) AS n FROM e),
    s AS (SELECT doc_id, t, len(w) AS n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 400 THEN [0] ELSE range(0, len(w), 350) END) AS s0 FROM d)
    SELECT s.doc_id, (s0 // 350)::BIGINT AS ordinal, (a.upto - a.n)::BIGINT AS char_start, b.upto::BIGINT AS char_end, sha256(t[a.upto - a.n + 1 : b.upto]) AS text_hash
    FROM s JOIN u a ON a.doc_id = s.doc_id AND a.i = s0 + 1 JOIN u b ON b.doc_id = s.doc_id AND b.i = least(s.n, s0 + 400)"""
)
def c1_chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of c1_chunk_windows as pieces of the text itself, white space within them kept, by their places in characters."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(T.window_spans(F.col("text"))).alias("ordinal", "w"))
    part = F.substring(F.col("text"), F.col("w.char_start") + 1, F.col("w.char_end") - F.col("w.char_start"))
    return rows.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("w.char_start").cast("bigint").alias("char_start"), F.col("w.char_end").cast("bigint").alias("char_end"), F.sha2(part, 256).alias("text_hash"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    g AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l)
    SELECT doc_id, p::BIGINT AS paragraph, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM g WHERE trim(line) <> '' GROUP BY doc_id, p"""
)
def a7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined to paragraphs, which blank lines end: gaps and islands within a document's own lines."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    blank = F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("i"))
    return lines.withColumn("paragraph", blank).where(F.trim("line") != "").groupBy("doc_id", "paragraph").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(
    r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1,
    len(regexp_extract_all(html, '<p>'))::BIGINT AS n_paragraphs, len(regexp_extract_all(html, '<li>'))::BIGINT AS n_items FROM pages"""
)
def a6_html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda t: F.regexp_extract("html", f"<{t}>([^<]*)</{t}>", 1).alias({"title": "title", "h1": "h1"}[t])
    count = lambda t: F.regexp_count("html", F.lit(f"<{t}>")).cast("bigint")
    return load(spark, sf_dir, "pages").select("page_id", tag("title"), tag("h1"), count("p").alias("n_paragraphs"), count("li").alias("n_items"))


# Names that lead inside, and the address ranges that are private, shared, local, for documentation or multicast.
_LOCAL_NAMES = r"(?:^|\.)(?:localhost|localdomain|local|internal|intranet|lan|home|corp)$"
_RANGES = (
    r"^(?:0|10|127)\.|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\."
    r"|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(?:22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
)
#: A host that a resolver would read as an address, in whatever base, and one that is written plainly.
_ADDRESS = r"^(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+))*$"
_PLAIN = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
#: Addresses in brackets: all but global unicast, and those that carry an address of the other kind.
_BRACKETS = r"^\[(?:[^23]|[23][^0-9a-f]|[23][0-9a-f]{0,2}:|2002:|2001:0*:|.*\.)"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)"


def url_verdict(url: Column) -> Column:
    """ok, or why a URL may not be fetched."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    private = host.rlike(_LOCAL_NAMES) | (host.rlike(_ADDRESS) & (~host.rlike(_PLAIN) | host.rlike(_RANGES))) | host.rlike(_BRACKETS)
    return (
        F.when(~F.lower(url).rlike("^https?://"), "scheme").when(host == "", "host").when(private, "private").when(~host.rlike(r"[.:]"), "dotless").otherwise("ok")
    )


@query(
    rf"""WITH h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\.+$', '') AS host FROM pages)
    SELECT page_id, CASE WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'scheme' WHEN host = '' THEN 'host'
    WHEN regexp_matches(host, '{_LOCAL_NAMES}') OR (regexp_matches(host, '{_ADDRESS}') AND (NOT regexp_matches(host, '{_PLAIN}') OR regexp_matches(host, '{_RANGES}'))) OR regexp_matches(host, '{_BRACKETS}') THEN 'private'
    WHEN NOT regexp_matches(host, '[.:]') THEN 'dotless' ELSE 'ok' END AS verdict FROM h"""
)
def a8_url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", url_verdict(F.col("url")).alias("verdict"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, octet_length(encode(coalesce(text, ''))) <= 26214400 AND lang IN ('en', 'de', 'fr', 'es') AS accepted FROM documents")
def a11_upload_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    return load(spark, sf_dir, "documents").select("doc_id", n.alias("n_bytes"), ((n <= 25 << 20) & F.col("lang").isin("en", "de", "fr", "es")).alias("accepted"))


@query(
    """WITH r AS (SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
    SELECT doc_id, source, k::BIGINT AS place, CASE WHEN n IS NULL OR n = 0 THEN 'empty' WHEN n > 20000 THEN 'too_large' ELSE 'ready' END AS status FROM r WHERE k <= 20"""
)
def a12_corpus_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 files of each group by path, with their status."""
    n = F.length("text")
    status = F.when(n.isNull() | (n == 0), "empty").when(n > 20000, "too_large").otherwise("ready")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("bigint")
    return load(spark, sf_dir, "documents").select("doc_id", "source", status.alias("status")).withColumn("place", place).where("place <= 20").select("doc_id", "source", "place", "status")


@query("SELECT doc_id, length(trim(coalesce(text, ''))) AS chars, length(trim(coalesce(text, ''))) < 50 AS ocr_required FROM documents")
def a15_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.trim(F.coalesce("text", F.lit("")))).cast("bigint")
    return load(spark, sf_dir, "documents").select("doc_id", n.alias("chars"), (n < 50).alias("ocr_required"))


# The signs of text recognition gone wrong.
DAMAGE = {
    "split_unit": r"\bM P a\b",
    "split_hardness": r"\bH V\b",
    "hyphen_break": r"[a-z]-\n[a-z]",
    "spaced_letters": r"(?:\b[A-Za-z] ){4}",
    "digit_in_word": r"[a-z][0-9][a-z]",
}


def damage_signals(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda s: F.trim(s) != "")
    short = F.size(F.filter(lines, lambda s: F.length(F.trim(s)) <= 24)) / F.greatest(F.size(lines), F.lit(1))
    flags = [F.when(t.rlike(p), name) for name, p in DAMAGE.items()]
    flags.append(F.when((short > 0.35) & (F.length(t) > 400), "many_short_ocr_lines"))
    flags.append(F.when(t.contains("�") | t.contains("?"), "replacement_characters"))
    return F.array_compact(F.array(*flags))


_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s) <> '')"
_SHORT = f"len(list_filter({_LINES}, lambda s: length(trim(s)) <= 24)) / greatest(len({_LINES}), 1)"
_QMARK = "contains(coalesce(text, ''), '?') OR contains(coalesce(text, ''), chr(65533))"


@query(
    "SELECT doc_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}' END" for n, p in DAMAGE.items())
    + f", CASE WHEN {_SHORT} > 0.35 AND length(text) > 400 THEN 'many_short_ocr_lines' END, CASE WHEN {_QMARK} THEN 'replacement_characters' END], lambda x: x IS NOT NULL), ',') AS signals FROM documents"
)
def c6_damage_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(damage_signals(F.col("text")), ",").alias("signals"))


def density(chars: Column) -> Column:
    return F.when(chars == 0, "empty").when(chars < 80, "very_low").when(chars < 400, "low").when(chars < 1500, "medium").otherwise("high")


_DENSITY_SQL = "CASE WHEN chars = 0 THEN 'empty' WHEN chars < 80 THEN 'very_low' WHEN chars < 400 THEN 'low' WHEN chars < 1500 THEN 'medium' ELSE 'high' END"


@query(
    rf"""WITH m AS (SELECT doc_id, length(trim(coalesce(text, ''))) AS chars, len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+'))::BIGINT AS words,
    len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS lines, round({_SHORT}, 6) AS short_line_ratio,
    (len(regexp_extract_all(coalesce(text, ''), '[?]')) + len(regexp_extract_all(coalesce(text, ''), chr(65533))))::BIGINT AS replaced,
    len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]'))::BIGINT AS latin, len(regexp_extract_all(coalesce(text, ''), '[а-яА-ЯёЁ]'))::BIGINT AS cyrillic, len(regexp_extract_all(coalesce(text, ''), '[0-9]'))::BIGINT AS digits FROM documents)
    SELECT *, {_DENSITY_SQL} AS density FROM m"""
)
def c7_quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda s: F.trim(s) != "")
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("bigint")
    chars = F.length(F.trim(t)).cast("bigint")
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        chars.alias("chars"),
        count(r"[\p{L}\p{N}_]+").alias("words"),
        F.size(F.split(t, "\n")).cast("bigint").alias("lines"),
        F.round(F.size(F.filter(lines, lambda s: F.length(F.trim(s)) <= 24)) / F.greatest(F.size(lines), F.lit(1)), 6).alias("short_line_ratio"),
        count("[?�]").alias("replaced"),
        count("[a-zA-Z]").alias("latin"),
        count("[а-яА-ЯёЁ]").alias("cyrillic"),
        count("[0-9]").alias("digits"),
        density(chars).alias("density"),
    )


@query(f"WITH m AS (SELECT length(trim(coalesce(text, ''))) AS chars FROM documents) SELECT {_DENSITY_SQL} AS density, count(*) AS n FROM m GROUP BY 1")
def c8_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(density(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("density")).agg(F.count(F.lit(1)).alias("n"))


# Words that speak for a document type (+2) and against it (-3), in order of precedence.
DOCUMENT_TYPES = {
    "license": (["license", "licensed", "released under"], ["experiment"]),
    "contact": (["@", "phone", "http"], ["license"]),
    "code": (["def ", "return", "{"], ["the "]),
    "prose": (["the ", "und ", "que ", "les "], ["{"]),
}


def document_type(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda w: F.when(t.contains(w), 1).otherwise(0)
    total = lambda ws, k: sum((hit(w) * k for w in ws), F.lit(0))
    scored = [F.struct((total(pos, 2) - total(neg, 3)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, (pos, neg)) in enumerate(DOCUMENT_TYPES.items())]
    best = F.greatest(*scored)
    return F.when(best["score"] > 0, best["name"]).otherwise("unknown")


def _type_sql() -> str:
    has = lambda w, k: f"CASE WHEN contains(t, '{w}') THEN {k} ELSE 0 END"
    rows = [f"struct_pack(score := {' + '.join([*(has(w, 2) for w in pos), *(has(w, -3) for w in neg)])}, place := {-i}, name := '{name}')" for i, (name, (pos, neg)) in enumerate(DOCUMENT_TYPES.items())]
    return f"list_max([{', '.join(rows)}])"


@query(f"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), b AS (SELECT doc_id, {_type_sql()} AS b FROM d) SELECT doc_id, CASE WHEN b.score > 0 THEN b.name ELSE 'unknown' END AS doc_type FROM b")
def c10_document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", document_type(F.col("text")).alias("doc_type"))


@query(
    r"""WITH m AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]')) AS a, len(regexp_extract_all(coalesce(text, ''), '[а-яА-ЯёЁ]')) AS b,
    len(regexp_extract_all(coalesce(text, ''), '[|]')) AS pipes FROM documents)
    SELECT doc_id, CASE WHEN b > 1.5 * a THEN 'ru' WHEN a > 1.5 * b THEN 'en' ELSE 'mixed' END AS language, pipes > 20 AS table_heavy FROM m"""
)
def c9_document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    a, b = F.regexp_count(t, F.lit("[a-zA-Z]")), F.regexp_count(t, F.lit("[а-яА-ЯёЁ]"))
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.when(b > 1.5 * a, "ru").when(a > 1.5 * b, "en").otherwise("mixed").alias("language"), (F.regexp_count(t, F.lit("[|]")) > 20).alias("table_heavy")
    )


@query(
    r"""WITH y AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?:19|20)[0-9][0-9]'), lambda x: x::INT), lambda x: x BETWEEN 1950 AND 2035) AS ys FROM documents)
    SELECT doc_id, list_max(ys) AS publication_year, len(ys)::BIGINT AS n_years FROM y"""
)
def c11_source_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = F.filter(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?:19|20)[0-9][0-9]"), F.lit(0)), lambda x: x.cast("int")), lambda x: x.between(1950, 2035))
    return load(spark, sf_dir, "documents").select("doc_id", years.alias("ys")).select("doc_id", F.array_max("ys").alias("publication_year"), F.size("ys").cast("bigint").alias("n_years"))


@query(
    """WITH f AS (SELECT doc_id, length(trim(coalesce(text, ''))) AS chars, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN chars = 0 THEN 'no_text' END, CASE WHEN chars BETWEEN 1 AND 49 THEN 'low_text' END,
    CASE WHEN chars > 50000 THEN 'very_long' END, CASE WHEN contains(t, chr(65533)) THEN 'encoding' END], lambda x: x IS NOT NULL), ',') AS warnings,
    CASE WHEN chars = 0 THEN 'failed' WHEN chars < 50 THEN 'ocr_required' ELSE 'parsed' END AS parse_status FROM f"""
)
def c12_file_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_profiles(load(spark, sf_dir, "documents")).select("doc_id", F.array_join("warnings", ",").alias("warnings"), "parse_status")


def file_profiles(docs: DataFrame) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    n = F.length(F.trim(t))
    flags = F.array_compact(
        F.array(F.when(n == 0, "no_text"), F.when((n > 0) & (n < 50), "low_text"), F.when(n > 50000, "very_long"), F.when(t.contains("�"), "encoding"))
    )
    return docs.select("doc_id", "source", "lang", flags.alias("warnings"), F.when(n == 0, "failed").when(n < 50, "ocr_required").otherwise("parsed").alias("parse_status"), n.alias("chars"))


@query(
    """WITH f AS (SELECT source, lang, CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'failed' WHEN length(trim(coalesce(text, ''))) < 50 THEN 'ocr_required' ELSE 'parsed' END AS status, length(trim(coalesce(text, ''))) AS chars FROM documents)
    SELECT source, lang, status, count(*) AS n, sum(chars)::BIGINT AS chars FROM f GROUP BY GROUPING SETS ((source), (lang), (status), ())"""
)
def c13_corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of the corpus report in one pass."""
    rows = file_profiles(load(spark, sf_dir, "documents")).withColumnRenamed("parse_status", "status")
    sets = [[F.col("source")], [F.col("lang")], [F.col("status")], []]
    return rows.groupingSets(sets, "source", "lang", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


@query("SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'failed' ELSE 'ocr_required' END AS parse_status FROM documents WHERE length(trim(coalesce(text, ''))) < 50")
def c14_high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_profiles(load(spark, sf_dir, "documents")).where(F.col("parse_status").isin("failed", "ocr_required")).select("doc_id", "parse_status")


@query(
    r"""SELECT p_partkey, replace(regexp_replace(lower(trim(p_name)), '\s+', ' ', 'g'), 'ё', 'е') AS canonical, regexp_replace(lower(trim(p_type)), '[\s_-]', '', 'g') AS compact,
    replace(lower(trim(p_brand)), '_', ' ') AS loose FROM part"""
)
def c15_canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", T.canonical(F.col("p_name")).alias("canonical"), T.compact(F.col("p_type")).alias("compact"), T.loose(F.col("p_brand")).alias("loose"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_\-]+'))::BIGINT AS n_tokens, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_\-]+')))::BIGINT AS n_terms FROM documents")
def c16_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_terms"))


@query(
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?;\n]+'), lambda x: trim(x)), lambda x: length(x) BETWEEN 20 AND 900)[1:20] AS s FROM documents)
    SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS n_chars FROM s"""
)
def c18_candidate_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of 20 to 900 characters; the first 20 of a document are candidates."""
    s = F.slice(F.filter(T.sentences(F.col("text")), lambda x: F.length(x).between(20, 900)), 1, 20)
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return load(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), total.alias("n_chars"))


_QUOTE_MARKS = ["the", "und", "de", "licen"]


@query(
    r"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?;\n]+'), lambda x: trim(x)), lambda x: length(x) >= 28)) AS s FROM documents),
    c AS (SELECT DISTINCT doc_id, s, """
    + " + ".join(f"CASE WHEN contains(lower(s), '{m}') THEN 1 ELSE 0 END" for m in _QUOTE_MARKS)
    + r""" + CASE WHEN regexp_matches(s, '^[-*]') THEN 3 ELSE 0 END - CASE WHEN regexp_matches(s, '[0-9]{4}-[0-9]{2}') THEN 4 ELSE 0 END AS score FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(s), s) AS place FROM c)
    SELECT doc_id, place::BIGINT AS place, score::BIGINT AS score, s AS quote FROM r WHERE place <= 3"""
)
def c19_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best quotes of each document."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(T.sentences(F.col("text")), lambda x: F.length(x) >= 28)).alias("s")).distinct()
    score = sum((F.when(F.lower("s").contains(m), 1).otherwise(0) for m in _QUOTE_MARKS), F.lit(0))
    score = score + F.when(F.col("s").rlike("^[-*]"), 3).otherwise(0) - F.when(F.col("s").rlike("[0-9]{4}-[0-9]{2}"), 4).otherwise(0)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.length("s"), "s"))
    return rows.withColumn("score", score.cast("bigint")).withColumn("place", place.cast("bigint")).where("place <= 3").select("doc_id", "place", "score", F.col("s").alias("quote"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^doc_', ''), '\.[a-z0-9]{2,5}$', '') AS public_name FROM pages")
def c20_public_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("url")
    for pattern in ("^https?://", "^doc_", r"\.[a-z0-9]{2,5}$"):
        c = F.regexp_replace(c, pattern, "")
    return load(spark, sf_dir, "pages").select("page_id", c.alias("public_name"))


def _blocks_sql(html: str) -> str:
    """Blocks of pages by gaps and islands: a text tag opens a block, which lasts to its own end tag or to the next text tag."""
    return rf"""s AS (SELECT page_id, regexp_replace({html}, '(?s)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<!--.*?-->', '<x>', 'g') AS h FROM pages),
    k AS (SELECT page_id, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(h, '<[^>]*>|[^<]+') AS l FROM s)),
    g AS (SELECT *, lower(regexp_extract(tok, '^<(p|li|figcaption|title|h[1-4])\b', 1)) AS opens, lower(regexp_extract(tok, '^</(p|li|figcaption|title|h[1-4])\b', 1)) AS ends FROM k),
    b AS (SELECT *, count(*) FILTER (opens <> '') OVER w AS block, last_value(nullif(opens, '') IGNORE NULLS) OVER w AS tag FROM g WINDOW w AS (PARTITION BY page_id ORDER BY i)),
    c AS (SELECT *, count(*) FILTER (ends = tag) OVER (PARTITION BY page_id, block ORDER BY i) AS closed FROM b),
    t AS (SELECT page_id, block, any_value(tag) AS tag, trim(regexp_replace(string_agg(tok, ' ' ORDER BY i), '\s+', ' ', 'g')) AS text FROM c WHERE block > 0 AND closed = 0 AND tok[1] <> '<' GROUP BY ALL),
    u AS (SELECT page_id, block, tag, replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS text FROM t),
    n AS (SELECT page_id, row_number() OVER w - 1 AS ordinal, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'title' THEN 'title' ELSE 'paragraph' END AS kind,
          coalesce(last_value(CASE WHEN tag LIKE 'h%' THEN text END IGNORE NULLS) OVER w, '') AS section, text FROM u WHERE text <> '' WINDOW w AS (PARTITION BY page_id ORDER BY block))"""


@query(f"""WITH {_blocks_sql("coalesce(html, '')")} SELECT page_id, ordinal::INT AS ordinal, kind, section, text FROM n""")
def a6_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page, without scripts, styles, navigation and footers."""
    return page_blocks(load(spark, sf_dir, "pages"))


#: What each page gets besides its html: a table of itself with an empty row, and its figure twice.
_TABLE = "<table><tr><th>page</th><th>host</th></tr><tr><td>%s</td><td>%s</td></tr><tr><td></td><td>nan</td></tr></table>"
_FIGURE = '<figure><img src="http://%s/i.png" alt="page %s"><figcaption>Figure %s</figcaption></figure>'
_PAGE_HOST = "^https?://([^/:?#]+)"


@query(
    f"""WITH {_blocks_sql("coalesce(html, '') || '<figcaption>Figure ' || page_id % 5 || '</figcaption><figcaption>Figure ' || page_id % 5 || '</figcaption>'")},
    l AS (SELECT page_id, max_by(section, ordinal) AS section FROM n GROUP BY page_id), x AS (SELECT page_id, regexp_extract(coalesce(url, ''), '{_PAGE_HOST}', 1) AS host, section FROM pages JOIN l USING (page_id)),
    w AS (SELECT 1 AS rank, page_id, ordinal, kind, section, string_split(text, ' ') AS w FROM n),
    a AS (SELECT rank, page_id, ordinal, s0, kind, section, array_to_string(w[s0 + 1 : s0 + 400], ' ') AS text FROM w, unnest(CASE WHEN len(w) <= 400 THEN [0] ELSE range(0, len(w), 350) END) AS z(s0)
          UNION ALL SELECT 0, page_id, 0, 0, 'table_row', section, concat_ws(' | ', 'page: ' || page_id, CASE WHEN host <> '' THEN 'host: ' || host END) FROM x
          UNION ALL SELECT 2, page_id, 0, 0, 'image', section, 'Image: url: http://' || host || '/i.png | alt: page ' || page_id || ' | caption: Figure ' || page_id % 5 FROM x)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY rank, ordinal, s0) - 1)::INT AS ordinal, kind, section, len(string_split(text, ' '))::INT AS token_count, sha256(text) AS text_hash FROM a"""
)
def c3_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every page with a table and a figure of its own: tables, then text, then images, each image once."""
    host, page = F.regexp_extract(F.coalesce("url", F.lit("")), _PAGE_HOST, 1), F.col("page_id").cast("string")
    figure = F.format_string(_FIGURE, host, page, (F.col("page_id") % 5).cast("string"))
    html = F.concat(F.coalesce("html", F.lit("")), F.format_string(_TABLE, page, host), figure, figure)
    pages = load(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return assemble(page_blocks(pages), ["page_id"]).drop("text")
