"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import best_fit, bpe_count, collocations, decontaminate, feistel_shards, html_blocks, induced_suffixes, ngram_join, quality_ledger, substring_dedup, token_alignment, url_gbt, zstd_lang


#: Similarity components from all pairs that share a shingle; for small tables.
OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
t AS (SELECT doc_id, unnest(w) AS w1, unnest(range(len(w))) AS i, len(w) AS n FROM d),
l AS (SELECT doc_id, n, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, md5_number(concat_ws(' ', w1, w2, w3, w4, w5)) AS g FROM l WHERE w5 IS NOT NULL
      UNION ALL SELECT doc_id, md5_number(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
r AS (SELECT doc_id AS i, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON r.i = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM d JOIN r ON r.i = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1
"""


def queries() -> dict:
    return {
        "op1_quality_ledger": quality_ledger.op1_quality_ledger,
        "quality_ablations": quality_ledger.quality_ablations,
        "op2_url_gbt": url_gbt.op2_url_gbt,
        "op3_bpe_count": bpe_count.op3_bpe_count,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_html_blocks": html_blocks.op5_html_blocks,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_zstd_lang": zstd_lang.op8_zstd_lang,
        "op9_feistel_shards": feistel_shards.op9_feistel_shards,
        "op10_best_fit": best_fit.op10_best_fit,
        "op11_induced_suffixes": induced_suffixes.op11_induced_suffixes,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_trie_collocations": collocations.op13_trie_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_ledger": quality_ledger.OP1_SQL,
        "quality_ablations": quality_ledger.ABLATIONS_SQL,
        "op4_decontaminate": decontaminate.OP4_SQL,
        "op6_substring_dedup": substring_dedup.OP6_SQL,
        "op7_ngram_join": OP7_SQL,
        "op11_induced_suffixes": induced_suffixes.OP11_SQL,
        "op13_trie_collocations": collocations.OP13_SQL,
    }
