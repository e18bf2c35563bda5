"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wovengraph.llm import bpe, collocations, exact_dedup, fill_middle, hyperplanes, jaccard, language, licences, main_text, packing, quality, rans, resharding
from wovengraph.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op2_exact_dedup",
    """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, sha256(s) AS text_sha256 FROM t
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op9_embedding_near_dedup")
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplanes.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_resharding")
def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six shards filled by source, one of them hot, become eight."""
    documents = table(spark, sf_dir, "documents")
    old = resharding.lay_out(documents, F.pmod(F.xxhash64("source"), F.lit(6)))
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))
    placed = resharding.slots(resharding.reshard(old, 8), F.col("row.doc_id").alias("doc_id"), F.col("size"), crc.alias("text_crc32"))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


@query("op1_quality_ranking")
def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_language_mixture")
def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op3_bpe_round_trip")
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = rans.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return written.checksums().withColumnRenamed("id", "doc_id")


def _licence_sql() -> str:
    fold = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    notices = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(licences.TEMPLATES))
    return f"""
    WITH given AS (SELECT * FROM (VALUES {notices}) v(no, licence, notice)),
    files AS (SELECT doc_id, text, CASE WHEN doc_id % 20 = 0 THEN concat_ws('/', source, doc_id // 1000) ELSE concat_ws('/', source, doc_id // 1000, doc_id // 100) END AS folder,
        CASE WHEN doc_id % 20 = 0 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS name FROM documents),
    gt AS (SELECT no, licence, unnest(regexp_extract_all({fold.format("notice")}, '[a-z0-9]+')) AS term FROM given),
    gtf AS (SELECT no, licence, term, count(*) AS tf FROM gt GROUP BY ALL),
    vocab AS (SELECT DISTINCT term FROM gtf),
    n AS (SELECT count(*) AS total FROM files),
    held AS (SELECT term, count(*) AS held FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all({fold.format("text")}, '[a-z0-9]+')) AS term FROM files) JOIN vocab USING (term) GROUP BY term),
    idf AS (SELECT term, coalesce(held, 0) AS held, ln((total + 1) / (coalesce(held, 0) + 1)) + 1 AS idf FROM vocab LEFT JOIN held USING (term), n),
    split AS (SELECT doc_id, {fold.format("text")} AS s, string_split(s, chr(10)) AS rows, name LIKE 'LICENSE%' AS whole FROM files),
    every AS (
        SELECT doc_id, unnest(flatten(list_transform(range(1, len(rows) + 1), lambda i: [array_to_string(rows[i:i + k], chr(10)) FOR k IN [0, 1, 2]]))) AS unit FROM split
        UNION ALL SELECT doc_id, unnest(string_split_regex(s, '\\n[ \\t\\r]*\\n')) FROM split
        UNION ALL SELECT doc_id, s FROM split WHERE whole),
    lines AS (SELECT doc_id, unit, row_number() OVER () AS line FROM (SELECT DISTINCT doc_id, unit FROM every)),
    words AS (SELECT doc_id, line, unnest(regexp_extract_all(unit, '[a-z0-9]+')) AS term FROM lines),
    tf AS (SELECT doc_id, line, term, count(*) AS tf FROM words GROUP BY ALL),
    w AS (SELECT doc_id, line, term, tf * coalesce(idf, ln(total + 1) + 1) AS weight FROM tf LEFT JOIN idf USING (term), n),
    norms AS (SELECT doc_id, line, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY ALL),
    gw AS (SELECT no, licence, term, tf * idf AS g FROM gtf JOIN idf USING (term)),
    sizes AS (SELECT no, sqrt(sum(g * g)) AS size FROM gw GROUP BY no),
    scores AS (SELECT doc_id, line, licence, round(sum(weight * g) / (any_value(norm) * any_value(size)), 6) AS score
        FROM w JOIN gw USING (term) JOIN norms USING (doc_id, line) JOIN sizes USING (no) GROUP BY doc_id, line, no, licence),
    own AS (SELECT doc_id, arg_max(licence, (score, licence)) AS own, max(score) AS score FROM scores WHERE score >= {licences.LEAST} GROUP BY doc_id),
    declared AS (SELECT folder AS above, arg_max(own, (score, own)) AS given FROM own JOIN files USING (doc_id) WHERE name LIKE 'LICENSE%' GROUP BY folder),
    nearest AS (SELECT f.folder, arg_max(above, length(above)) AS above, arg_max(given, length(above)) AS given
        FROM (SELECT DISTINCT folder FROM files) f JOIN declared d ON f.folder = d.above OR starts_with(f.folder, d.above || '/') GROUP BY f.folder)
    SELECT folder || '/' || name AS path, doc_id, own, score, coalesce(own, given) AS licence,
        CASE WHEN own IS NULL AND given IS NOT NULL THEN above END AS inherited_from
    FROM files LEFT JOIN own USING (doc_id) LEFT JOIN nearest USING (folder)
    """


@query("op7_licence_scan", _licence_sql())
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a tree of files: source, thousands, hundreds; every twentieth is a LICENSE file one folder up."""
    docs = table(spark, sf_dir, "documents")
    thousands, hundreds = F.expr("doc_id div 1000"), F.expr("doc_id div 100")
    licence = F.col("doc_id") % 20 == 0
    name = F.when(licence, F.concat(F.lit("LICENSE."), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    path = F.concat_ws("/", "source", thousands, F.when(~licence, hundreds), name)
    return licences.scan(docs.select(path.alias("path"), "doc_id", "text"))


@query(
    "op11_fill_in_middle",
    r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
        sha256('7:' || doc_id) AS d FROM documents),
    h AS (SELECT doc_id, s, u, len(u) AS n, ('0x' || d[1:8])::UBIGINT AS h1, ('0x' || d[9:16])::UBIGINT AS h2, ('0x' || d[25:32])::UBIGINT AS h4 FROM t),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS lo, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS hi,
        CASE WHEN s = '' OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:n], '') AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
        sha256(s) AS restored_sha256 FROM p
    """,
)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256")
    )


@query(
    "op12_collocations",
    r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS u FROM p),
    n AS (SELECT lang, sum(len(u)) AS n FROM w GROUP BY lang),
    g AS (SELECT lang, unnest(flatten(list_transform(range(1, least(len(u), 5) + 1), lambda m: list_transform(range(1, len(u) - m + 2), lambda i: array_to_string(u[i:i + m - 1], ' '))))) AS phrase FROM w WHERE len(u) > 0),
    f AS (SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS u FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
    c AS (SELECT lang, phrase, f AS a, u, unnest(range(1, len(u))) AS k FROM f WHERE len(u) > 1),
    s AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n.n, k, (1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS score
        FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.u[1:k], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.u[k + 1:len(c.u)], ' ') JOIN n ON n.lang = c.lang),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    i AS (SELECT lang, f, unnest(flatten(list_transform(range(2, len(u)), lambda m: list_transform(range(1, len(u) - m + 2), lambda i: array_to_string(u[i:i + m - 1], ' '))))) AS phrase FROM f WHERE len(u) > 2),
    d AS (SELECT b.* FROM b LEFT JOIN (SELECT lang, phrase, max(f) AS around FROM i GROUP BY lang, phrase) o USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
    FROM d QUALIFY rank <= 2000
    """,
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_main_text")
def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
