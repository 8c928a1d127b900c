"""SQL that says the same as a query, where SQL can."""

from __future__ import annotations

_EDGES = """
    m AS (SELECT DISTINCT source_a, index_a, source_b, index_b FROM chapter_matches),
    c AS (SELECT DISTINCT chapter_id, source_file, chapter_index FROM chapters),
    e AS (SELECT DISTINCT a.chapter_id AS x, b.chapter_id AS y FROM m
          JOIN c a ON a.source_file = m.source_a AND a.chapter_index = m.index_a
          JOIN c b ON b.source_file = m.source_b AND b.chapter_index = m.index_b
          WHERE a.chapter_id <> b.chapter_id),
    u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    r(x, y) AS (SELECT x, x FROM u UNION SELECT r.x, u.y FROM r JOIN u ON u.x = r.y),
    g AS (SELECT x AS chapter_id, min(y) AS group_id FROM r GROUP BY x)"""


_LEAKS = """
    w AS (SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM (SELECT DISTINCT doc_id, text FROM documents)
          UNION ALL
          SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') FROM (SELECT DISTINCT item_id, text FROM eval_items)),
    s AS (SELECT DISTINCT side, id, array_to_string(words[k : k + 13], ' ') AS run FROM (SELECT side, id, words, unnest(range(1, len(words) - 12)) AS k FROM w WHERE len(words) >= 14)),
    f AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM s d JOIN s i USING (run) WHERE d.side = 'd' AND i.side = 'i')"""

_FILES = """
    b AS (SELECT DISTINCT 0 AS o, kb_id AS id, body FROM kb_entries UNION SELECT DISTINCT 1, file_id, body FROM incoming_files),
    w AS (SELECT o, id, list_filter(regexp_split_to_array(lower(regexp_replace(body, '<[/!]?[A-Za-z\\-][^<>]*>', ' ', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM b),
    s AS (SELECT DISTINCT o, id, array_to_string(words[k : k + 4], ' ') AS run FROM (SELECT o, id, words, unnest(range(1, len(words) - 3)) AS k FROM w WHERE len(words) >= 5)),
    n AS (SELECT o, id, count(*) AS n FROM s GROUP BY o, id),
    p AS (SELECT x.id AS file_id, y.o, y.id, count(*) AS both FROM s x JOIN s y USING (run) WHERE x.o = 1 AND (y.o, y.id) < (x.o, x.id) GROUP BY 1, 2, 3),
    m AS (SELECT p.file_id, min((p.o, p.id)) AS first FROM p JOIN n a ON a.o = 1 AND a.id = p.file_id JOIN n b ON b.o = p.o AND b.id = p.id
          WHERE 2 * p.both >= a.n + b.n - p.both GROUP BY 1)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            SELECT DISTINCT 'chapters' AS origin, chapter_id AS item_id, chapter_index FROM chapters WHERE length(content) > 4000
            UNION
            SELECT 'segmented_sources', source_id, c.chapter_index FROM (SELECT source_id, unnest(chapters) AS c FROM segmented_sources)
            WHERE length(c.content) > 4000""",
        "p3_coverage": """
            SELECT DISTINCT origin, item_id, chapter_index, length(content) AS covered, true AS within, true AS overlapping FROM (
                SELECT 'chapters' AS origin, chapter_id AS item_id, chapter_index, content FROM chapters
                UNION ALL SELECT 'segmented_sources', source_id, c.chapter_index, c.content FROM (SELECT source_id, unnest(chapters) AS c FROM segmented_sources))
            WHERE length(content) > 4000""",
        "p6_values": f"""
            WITH RECURSIVE {_EDGES},
            t AS (SELECT lower(source_type) AS kind, min(trust_rank) AS r FROM source_trust GROUP BY 1),
            k AS (SELECT DISTINCT g.group_id, c.chapter_id, coalesce(length(c.content), -1) AS n, c.content, c.score, c.scored_at, c.source_file, coalesce(t.r, 2147483647) AS r
                  FROM g JOIN chapters c USING (chapter_id)
                  LEFT JOIN t ON t.kind = lower(regexp_extract(c.source_file, '\\.([\\p{{L}}\\p{{N}}]+)\\s*$', 1))),
            p AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, chapter_id) AS a, row_number() OVER (PARTITION BY group_id ORDER BY r, chapter_id) AS b,
                         CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY group_id, score IS NULL ORDER BY scored_at DESC NULLS LAST, chapter_id) END AS c FROM k)
            SELECT group_id, max(CASE WHEN a = 1 THEN md5(content) END) AS content_md5, max(CASE WHEN c = 1 THEN score END) AS score, max(CASE WHEN b = 1 THEN source_file END) AS source_file
            FROM p GROUP BY group_id""",
        "p9_sources": """
            WITH t AS (SELECT source, max(target_share) AS share, max(max_repeats) AS max_repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
            x AS (SELECT text, arg_min(source, doc_id) AS source FROM documents WHERE source IN (SELECT source FROM t) AND regexp_matches(coalesce(text, ''), '[^\\s\\p{Z}\\x{85}]') GROUP BY text),
            h AS (SELECT source, count(*) AS n FROM x GROUP BY 1), u AS (SELECT t.*, h.n > 0 AND share > 0 AND max_repeats > 0 AS usable FROM t LEFT JOIN h USING (source))
            SELECT source, round(share / (SELECT sum(share) FROM t), 9) AS target_share, max_repeats,
                   round(CASE WHEN usable THEN share / (SELECT sum(share) FROM u WHERE usable) ELSE 0e0 END, 9) AS attainable_share FROM u""",
        "p4_found": f"WITH {_FILES} SELECT file_id, CASE WHEN first[1] = 1 THEN 'incoming_files' ELSE 'kb_entries' END AS match_origin, first[2] AS match_id FROM m",
        "p6_found": f"""
            WITH RECURSIVE {_EDGES},
            t AS (SELECT lower(source_type) AS kind, min(trust_rank) AS r FROM source_trust GROUP BY 1),
            k AS (SELECT DISTINCT g.group_id, c.chapter_id, coalesce(length(c.content), -1) AS n, c.score, c.scored_at, coalesce(t.r, 2147483647) AS r
                  FROM g JOIN chapters c USING (chapter_id)
                  LEFT JOIN t ON t.kind = lower(regexp_extract(c.source_file, '\\.([\\p{{L}}\\p{{N}}]+)\\s*$', 1)))
            SELECT group_id,
                   arg_min(chapter_id, (-n, chapter_id)) AS content_from,
                   arg_min(chapter_id, (-epoch_us(scored_at), chapter_id)) FILTER (WHERE score IS NOT NULL) AS score_from,
                   arg_min(chapter_id, (r, chapter_id)) AS source_from
            FROM k GROUP BY group_id""",
        "p7_found": f"WITH RECURSIVE {_EDGES} SELECT chapter_id, group_id FROM g",
        "p8_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM f",
        "p8_items": f"""
            WITH {_LEAKS}
            SELECT e.item_id, e.suite, count(f.doc_id) AS n_documents FROM (SELECT DISTINCT item_id, suite FROM eval_items) e
            LEFT JOIN f USING (item_id) GROUP BY 1, 2""",
    }
