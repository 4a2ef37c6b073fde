"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontam, licenses, minhash, mixing, periods, planes, pq, ring, secrets, spelling, substring, toxicity, warc
from factloom.llm.common import table

#: Id that closes every document.
END_ID = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.token_table(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law that holds is `rows`: capacities are the shares of 16 shards, one apart at most, and sum to the number of rows."""
    return ring.assign(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each word of the corpus; no documents, no rows.  See spelling.word_counts() for null ids and texts."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; the owner is its source, the repository its source and language.  See secrets.scan_secrets()."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, every tenth of which is made periodic first.  See periods.periodic_runs()."""
    return periods.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_plane_files,
        op2_bounded_ring,
        op3_minhash,
        op4_systematic_mix,
        op5_warc_segments,
        op6_ngram_decontamination,
        op7_product_quantisation,
        op8_license_scan,
        op9_subword_toxicity,
        op10_cover_anchors,
        op11_spelling_variants,
        op12_secret_scan,
        op13_periodic_runs,
    )
}

_BENCH_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t"


def _crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes, with the table t of _CRC_TABLE at hand."""
    octet = f"('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT"
    return f"xor(list_reduce(list_transform(range(octet_length(encode({text}))), lambda k: {octet}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _secret_matches() -> str:
    """For each pattern, the matches of every text, the gaps before them, and the value."""
    parts = []
    for i, k in enumerate([*secrets.BASE, *secrets.MORE, secrets.RUN]):
        p = k.pattern.replace("'", "''")
        parts.append(
            f"SELECT uid, o, r, {i} AS pattern, {k.least} AS least, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS w, regexp_extract_all(t, '{p}', {k.group}) AS v FROM d WHERE regexp_matches(t, '{p}')"
        )
    return " UNION ALL ".join(parts)


def _secret_sql() -> str:
    n, base, known = len(secrets.BASE + secrets.MORE), len(secrets.BASE), secrets.NAMES.index(secrets.KNOWN)
    forms = " ".join(f"WHEN regexp_matches(v, '{form}') THEN {secrets.NAMES.index(name)}" for name, form in secrets.FORMS.items())
    letters_and_digits = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')"
    varied = f"{letters_and_digits} AND len(list_distinct(string_split(v[:256], ''))) >= {secrets.VARIED} AND NOT regexp_matches(lower(v), '{secrets.PLACEHOLDER}')"
    name = "[" + ", ".join(f"'{x}'" for x in secrets.NAMES) + "][kind + 1]"
    listed = f"string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, kind, e)"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(source, chr(30)) AS o, coalesce(source, chr(30)) || chr(31) || coalesce(lang, chr(30)) AS r, coalesce(text, '') AS t FROM documents),
        m AS ({_secret_matches()}),
        u AS (SELECT uid, o, r, pattern, least, unnest(gaps[1 : len(w)]) AS g, unnest(w) AS w, unnest(v) AS v, generate_subscripts(w, 1) AS pos FROM m),
        e AS (SELECT *, sum(length(g) + length(w)) OVER (PARTITION BY uid, pattern ORDER BY pos) AS e FROM u),
        k AS (SELECT uid, o, r, CASE WHEN pattern < {n} THEN pattern {forms} ELSE {known} END AS kind, e - length(w) AS s, e, v, {varied} AS varied
              FROM e WHERE CASE WHEN pattern < {n} THEN length(v) >= least ELSE {letters_and_digits} END),
        f AS (SELECT v, count(DISTINCT o) AS n_owners, count(DISTINCT r) AS n_repositories, bool_or(varied) AS varied FROM k GROUP BY v HAVING bool_or(kind <> {known})),
        j AS (SELECT uid, kind, s, e, n_owners, CASE WHEN n_owners >= {secrets.SHARED} THEN 'copied' WHEN f.varied THEN 'live' ELSE 'plain' END AS verdict FROM k JOIN f USING (v)),
        a AS (SELECT * FROM j WHERE kind <> {known} OR NOT EXISTS (SELECT 1 FROM j AS x WHERE x.uid = j.uid AND x.kind <> {known} AND x.s <= j.s AND x.e >= j.e)),
        p AS (SELECT uid, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k.name}" for i, k in enumerate(secrets.BASE))}, {listed} FILTER (kind < {base}) AS base, {listed} AS spans,
              count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied, min(n_owners) AS least_owners FROM a GROUP BY uid)
        SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0)::BIGINT AS n_{k.name}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
               coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied, least_owners FROM d LEFT JOIN p USING (uid)
    """


ORACLE_SQL: dict[str, str] = {
    "op11_spelling_variants": rf"""
        WITH RECURSIVE c AS ({_CRC_TABLE}),
        o AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
        g AS (SELECT id, run, count(*) AS n FROM o GROUP BY ALL),
        h AS (SELECT run, n, {_crc32("id || ':' || run")} AS h FROM g, c),
        w AS (SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5),
        x AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS key FROM w, unnest(range(1, length(word) + 1)) AS t(i)),
        p AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
              UNION SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.key UNION SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.key),
        b AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS form, max(m) AS form_n FROM p GROUP BY word),
        f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM w LEFT JOIN b USING (word)),
        r(word, root) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, r.root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM f JOIN r USING (word) JOIN f AS last ON last.word = r.root AND last.form IS NULL
    """,
    "op12_secret_scan": _secret_sql(),
    "op13_periodic_runs": rf"""
        WITH c AS ({_CRC_TABLE}),
        d AS (SELECT row_number() OVER () AS uid, doc_id, {_crc32("coalesce(doc_id::VARCHAR, '')")} AS h, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents, c),
        e AS (SELECT *, doc_id IS NOT NULL AND h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
        f AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS q FROM e),
        x AS (SELECT uid, i, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % q ELSE i END] AS word, len(w) AS n FROM f, unnest(range(len(w))) AS t(i)),
        m AS (SELECT y.uid, y.i, z.i - y.i AS p FROM x y JOIN x z ON y.uid = z.uid AND y.word = z.word AND z.i > y.i AND 3 * (z.i - y.i) <= y.n),
        g AS (SELECT uid, p, i, i - row_number() OVER (PARTITION BY uid, p ORDER BY i) AS k FROM m),
        s AS (SELECT uid, p, min(i) AS s, count(*) + p AS n FROM g GROUP BY uid, p, k),
        r AS (SELECT uid, s, n, min(p) AS p FROM s WHERE n >= greatest(24, 3 * p) GROUP BY ALL),
        b AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n::DOUBLE / p DESC, s, p) AS k FROM r),
        t AS (SELECT uid, count(*) AS n_runs, string_agg(s || ',' || n || ',' || p || chr(10), '' ORDER BY s, p) AS listed FROM r GROUP BY uid),
        l AS (SELECT uid, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.uid = x.uid AND x.i >= r.s + r.p AND x.i < r.s + r.n) GROUP BY uid)
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.n::BIGINT AS length, b.p::BIGINT AS period, (1000 * b.n // b.p)::BIGINT AS exponent_milli,
               sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM f LEFT JOIN b ON b.uid = f.uid AND b.k = 1 LEFT JOIN t ON t.uid = f.uid LEFT JOIN l ON l.uid = f.uid
    """,
    # A window's hash would not do here: windows are compared by their words.
    "op6_ngram_decontamination": rf"""
        WITH i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_BENCH_WORDS}') AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS gram
              FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(s) WHERE len(w) > 0),
        d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all({_LOWER}, '{_BENCH_WORDS}') AS w FROM documents),
        p AS (SELECT uid, s, l.n, array_to_string(w[s : s + l.n - 1], ' ') AS gram FROM d, (SELECT DISTINCT n FROM g) AS l, unnest(range(1, len(w) - l.n + 2)) AS t(s)),
        h AS (SELECT uid, s, p.n, item_id FROM p JOIN g USING (gram)),
        c AS (SELECT uid, count(DISTINCT k) AS n_hit FROM h, unnest(range(s, s + n)) AS t(k) GROUP BY uid),
        e AS (SELECT uid, count(DISTINCT item_id) AS n_items, sha256(coalesce(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR), '')) AS items FROM h GROUP BY uid)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (uid) LEFT JOIN e USING (uid)
    """,
    "op3_minhash": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(id, far) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.far = e.a)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(far) AS c FROM r GROUP BY id) ON id = d.doc_id
    """,
    "op5_warc_segments": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        m AS (SELECT d, max(page_id) AS newest FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN newest <> page_id THEN newest END AS refers_to
        FROM p LEFT JOIN m USING (d)
    """,
    "op7_product_quantisation": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.93),
        r(id, far) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.far = l.a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
        FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) ON a = vec_id JOIN (SELECT id, min(far) AS c FROM r GROUP BY id) ON id = vec_id
    """,
    "op10_cover_anchors": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
        x AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS g FROM d, unnest(range(1, len(w) - 18)) AS t(s)),
        f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM x),
        r AS (SELECT DISTINCT doc_id, p FROM f, unnest(range(s, s + 20)) AS t(p) WHERE k > 1),
        u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM u ANTI JOIN r USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """,
}
