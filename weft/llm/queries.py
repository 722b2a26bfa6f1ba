"""Queries of the text operators; problem N's are named pN_..."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.llm import furniture, language, mixing, neardup, packing, repeated, residue, scans, splitting
from weft.registry import Registry
from weft.sources.tables import cache_text, latest_delivery, table

LLM = Registry()

_TEXTS = """
texts AS (
  SELECT entry_id, any_value(url) AS url,
         any_value(array_to_string(CAST(json(content) AS VARCHAR[]), chr(10))) AS text
  FROM cache_entries GROUP BY entry_id)
"""


@LLM.add(
    "p5_found",
    f"""WITH {_TEXTS}
    SELECT entry_id, 'oversized' AS kind FROM texts WHERE length(text) > 6000
    UNION
    SELECT entry_id, 'unbroken' AS kind FROM texts
    WHERE list_max(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: length(x))) > 6000""",
)
def p5_found(spark, sf_dir):
    return splitting.oversized_found(table(spark, sf_dir, "cache_entries"))


@LLM.add("p5_pieces")
def p5_pieces(spark, sf_dir):
    entries = latest_delivery(table(spark, sf_dir, "cache_entries").select("entry_id", "stored_at", "content"), "entry_id", "stored_at")
    return splitting.split_oversized(entries).withColumnRenamed("id", "entry_id")


@LLM.add("p7_found", "SELECT DISTINCT doc_id FROM documents WHERE octet_length(encode(text)) > 4096")
def p7_found(spark, sf_dir):
    return packing.split_found(table(spark, sf_dir, "documents"))


@LLM.add("p7_assignment")
def p7_assignment(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@LLM.add("p7_containers")
def p7_containers(spark, sf_dir):
    return packing.containers(packing.pack(table(spark, sf_dir, "documents")))


@LLM.add("p7_certificate")
def p7_certificate(spark, sf_dir):
    return packing.certificate(table(spark, sf_dir, "documents"))


@LLM.add(
    "p1_found",
    f"""WITH {_TEXTS},
    lines AS (
      SELECT entry_id, url, unnest(string_split(text, chr(10))) AS line,
             unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM texts),
    keyed AS (
      SELECT entry_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(lower(line), '[^\\p{{L}}]', '', 'g') AS letters,
             regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^www\\.', '') AS site
      FROM lines),
    counted AS (
      SELECT site, letters FROM keyed WHERE length(letters) >= 12
      GROUP BY site, letters HAVING count(DISTINCT entry_id) >= 5)
    SELECT DISTINCT entry_id, line_no FROM keyed JOIN counted USING (site, letters)""",
)
def p1_found(spark, sf_dir):
    return repeated.repeated_lines(table(spark, sf_dir, "cache_entries")).withColumnRenamed("id", "entry_id")


@LLM.add("p1_clean")
def p1_clean(spark, sf_dir):
    entries = latest_delivery(table(spark, sf_dir, "cache_entries").select("entry_id", "url", "content", "stored_at"), "entry_id", "stored_at")
    return repeated.without_repeats(entries).withColumnRenamed("id", "entry_id")


@LLM.add("p4_found")
def p4_found(spark, sf_dir):
    return residue.residue(table(spark, sf_dir, "cache_entries")).select(F.col("id").alias("entry_id")).distinct()


@LLM.add("p4_kept")
def p4_kept(spark, sf_dir):
    entries = latest_delivery(table(spark, sf_dir, "cache_entries").select("entry_id", "url", "content", "status", "stored_at"), "entry_id", "stored_at")
    return residue.kept(entries).withColumnRenamed("id", "entry_id")


@LLM.add("p6_found")
def p6_found(spark, sf_dir):
    return furniture.furniture(table(spark, sf_dir, "cache_entries")).withColumnRenamed("id", "entry_id")


@LLM.add("p6_main")
def p6_main(spark, sf_dir):
    entries = latest_delivery(table(spark, sf_dir, "cache_entries").select("entry_id", "url", "content", "stored_at"), "entry_id", "stored_at")
    found = furniture.furniture(entries)
    return repeated.without_lines(entries, found, "entry_id", cache_text()).withColumnRenamed("id", "entry_id")


@LLM.add("p9_found")
def p9_found(spark, sf_dir):
    return language.mislabelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples")).withColumnRenamed("id", "doc_id")


@LLM.add("p9_languages")
def p9_languages(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples")).withColumnRenamed("id", "doc_id")


@LLM.add(
    "p8_found",
    """WITH d AS (SELECT lower(trim(source)) AS src, coalesce(octet_length(encode(text)), 0) AS n FROM documents),
    total AS (SELECT sum(n) AS n FROM d),
    own AS (SELECT src, sum(n) AS n FROM d GROUP BY src)
    SELECT DISTINCT m.source FROM mix_targets m LEFT JOIN own ON own.src = lower(trim(m.source)), total
    WHERE m.max_repeats * coalesce(own.n, 0) < m.target_share * total.n""",
)
def p8_found(spark, sf_dir):
    return mixing.short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@LLM.add("p8_report")
def p8_report(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@LLM.add("p8_mix")
def p8_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).withColumnRenamed("id", "doc_id")


@LLM.add("p8_routes")
def p8_routes(spark, sf_dir):
    return mixing.routes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def _near(spark, sf_dir):
    return neardup.similar(
        [
            (table(spark, sf_dir, "cache_entries"), "entry_id", "content", "cache_entries", 120, True),
            (table(spark, sf_dir, "search_hits"), "hit_id", "snippet", "search_hits", 12, False),
        ]
    )


@LLM.add(
    "p3_found",
    f"""WITH {_TEXTS},
    items AS (
      SELECT 'cache_entries' AS tbl, entry_id AS id, text, 120 AS least FROM texts
      UNION ALL
      SELECT 'search_hits', hit_id, any_value(snippet), 12 FROM search_hits GROUP BY hit_id),
    words AS (SELECT tbl, id, least, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM items WHERE text IS NOT NULL),
    runs AS (
      SELECT tbl, id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s
      FROM words WHERE len(w) >= least),
    each AS (SELECT tbl, id, len(s) AS n, unnest(s) AS run FROM runs)
    SELECT a.tbl, a.id AS id_a, b.id AS id_b
    FROM each a JOIN each b ON a.tbl = b.tbl AND a.run = b.run AND a.id < b.id
    GROUP BY a.tbl, a.id, b.id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*))""",
)
def p3_found(spark, sf_dir):
    return neardup.all_pairs(*_near(spark, sf_dir))


@LLM.add("p3_classes")
def p3_classes(spark, sf_dir):
    return neardup.classes(*_near(spark, sf_dir))


@LLM.add("p2_found")
def p2_found(spark, sf_dir):
    return scans.scan_noise(table(spark, sf_dir, "pdf_results")).withColumnRenamed("id", "pdf_id")


@LLM.add("p2_paragraphs")
def p2_paragraphs(spark, sf_dir):
    return scans.paragraphs(table(spark, sf_dir, "pdf_results")).withColumnRenamed("id", "pdf_id")
