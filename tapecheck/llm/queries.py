"""The registered queries of this package and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapecheck.llm import (
    chat,
    decontaminate,
    divergence,
    exact,
    licences,
    middle,
    near,
    ngram_join,
    packing,
    pii,
    quality,
    shards,
    toxicity,
)
from tapecheck.llm.prefixes import Prefixes
from tapecheck.operators.blocks import new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = exact.exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")
    return marks.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return decontaminate.mark_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chats(_table(spark, sf_dir, "conversations"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"), near.Sketching(words=4))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit(docs))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(_table(spark, sf_dir, "documents"), store=new_folder(spark))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = ngram_join.Joining(words=3, prefixes=Prefixes(percent=90))
    return ngram_join.ngram_classes(_table(spark, sf_dir, "documents"), how)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle.with_restored(middle.fill_in_middle(_table(spark, sf_dir, "documents")))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_pii": op8_pii,
    "op9_sharding": op9_sharding,
    "op10_license_scans": op10_license_scans,
    "op11_source_divergence": op11_source_divergence,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    out = f"regexp_replace({_LOWER.format(column)}, {_literal(licences.COPYRIGHT_LINE)}, ' ', 'g')"
    for pattern, spelling in licences.SPELLINGS:
        out = f"regexp_replace({out}, {_literal(pattern)}, {_literal(spelling)}, 'g')"
    return f"trim(regexp_replace({out}, {_literal(licences.PUNCTUATION)}, ' ', 'g'))"


ORACLES: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_LOWER.format("text")} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)
    """,
    "op5_chat_formatting": """
        WITH t AS (
          SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
          FROM conversations
        ), c AS (
          SELECT conv_id, count(*) AS n_turns,
                 string_agg(turn || chr(1) || role || chr(1) || text || chr(2), '' ORDER BY turn, role, text) AS body,
                 string_agg('<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |')
                            || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS text
          FROM t GROUP BY conv_id
        ), p AS (
          SELECT DISTINCT string_agg(turn || chr(1) || role || chr(1) || text || chr(2), '')
                 OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS body,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)
                 < count(*) OVER (PARTITION BY conv_id) AS inner_prefix
          FROM t
        ), g AS (
          SELECT body, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS copies,
                 any_value(text) AS text
          FROM c GROUP BY body
        )
        SELECT conv_id, 0 AS part, n_turns, copies, text FROM g
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.inner_prefix AND p.body = g.body)
    """,
    "op10_license_scans": f"""
        WITH known AS (
          SELECT md5({_canonical("t")}) AS digest, min(l) AS license
          FROM (VALUES {", ".join(f"({_literal(n)}, {_literal(t)})" for n, t in licences.KNOWN)}) AS v(l, t)
          GROUP BY 1
        ), d AS (SELECT doc_id, text, md5({_canonical("text")}) AS digest FROM documents
        ), hits AS (
          SELECT doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS line_licenses, count(*) AS n
          FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) AS x
          JOIN known AS k ON k.digest = md5({_canonical("line")})
          GROUP BY doc_id
        )
        SELECT d.doc_id, d.digest, k.license, coalesce(h.line_licenses, '') AS line_licenses,
               coalesce(h.n, 0) AS n_license_lines
        FROM d LEFT JOIN known AS k USING (digest) LEFT JOIN hits AS h USING (doc_id)
    """,
    "op11_source_divergence": f"""
        WITH d AS (
          SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
          FROM documents
        ), w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
        kept AS (
          SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30
        ), v AS (SELECT lang, count(*) AS V, sum(lang_n) AS total FROM kept GROUP BY ALL),
        n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        whole AS (
          SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM n WHERE n.lang = g.lang AND n.source = g.source), 0)
                 + 5 * coalesce(V, 0) AS whole
          FROM g LEFT JOIN v USING (lang)
        ), dense AS (
          SELECT lang, source, term, coalesce(n, 0) AS n, lang_n,
                 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5)::HUGEINT // whole::HUGEINT AS p,
                 1 + 1000000000::HUGEINT * (lang_n + 5)::HUGEINT // (total + 5 * V)::HUGEINT AS q
          FROM whole JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)
        ), apart AS (
          SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
          FROM dense AS a JOIN dense AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), parts AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM dense WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value::BIGINT AS value,
               row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
        FROM parts
        QUALIFY part = 'pair' OR rank <= 50
    """,
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), u AS (
          SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, len(units) AS n,
                 ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
                 ('0x' || h[17:24])::BIGINT % 100 >= 100 AS uncut, ('0x' || h[25:32])::BIGINT % 100 < 50 AS first
          FROM d
        ), c AS (
          SELECT *, array_to_string(units[1:least(x, y)], '') AS head,
                 array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS mid,
                 array_to_string(units[greatest(x, y) + 1:], '') AS tail,
                 CASE WHEN text = '' OR uncut OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                      THEN 'plain' WHEN first THEN 'spm' ELSE 'psm' END AS form
          FROM u
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid
                      ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM c
    """,
}
