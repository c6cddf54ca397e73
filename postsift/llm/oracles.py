"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


ORACLES = {
    "op2_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
            doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op10_warc_archive": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                sha1(coalesce(html, '')) AS h,
                min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
        )
        SELECT page_id, payload_bytes,
            list_aggregate([
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
                    1 + (('0x' || h[10 * (i // 8) + 1 : 10 * (i // 8) + 10])::BIGINT >> (35 - 5 * (i % 8)) & 31)
                ] FOR i IN range(32)
            ], 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p""",
}

# Phrases of documents: every occurrence, counted by language; the parts of each cut by a join.
ORACLES["op5_substring_dedup"] = r"""WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM d WHERE len(words) >= 13),
said AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS said FROM windows),
firsts AS (SELECT said, min(doc_id) AS first FROM said GROUP BY said),
starts AS (SELECT doc_id, i FROM said JOIN firsts USING (said) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM starts, (SELECT unnest(range(13)) AS k)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

ORACLES["op11_collocations"] = r"""
    WITH d AS (
        SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
    ), pieces AS (
        SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
    ), words AS (
        SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda w: w <> '') AS ws FROM pieces
    ), n AS (
        SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY lang
    ), f AS (
        SELECT lang, g AS ws, count(*) AS a FROM (
            SELECT lang, unnest([ws[i : i + k - 1] FOR i IN range(1, len(ws) - k + 2)]) AS g
            FROM words, (VALUES (1), (2), (3), (4)) AS t (k) WHERE len(ws) >= k
        ) GROUP BY ALL HAVING count(*) >= 30
    ), cuts AS (
        SELECT c.lang, c.ws, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
        FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1) AS c
        JOIN f AS x ON x.lang = c.lang AND x.ws = c.ws[1:c.k]
        JOIN f AS y ON y.lang = c.lang AND y.ws = c.ws[c.k + 1 :]
    ), best AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1
    ), longer AS (
        SELECT lang, ws, max(a) AS b FROM (
            SELECT lang, a, unnest([ws[i : i + k - 1] FOR i IN range(1, len(ws) - k + 2)]) AS ws
            FROM f, (VALUES (2), (3)) AS t (k) WHERE len(ws) > k
        ) GROUP BY lang, ws
    ), ranked AS (
        SELECT best.lang, array_to_string(best.ws, ' ') AS phrase, a, l, r, score,
            row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, array_to_string(best.ws, ' ')) AS rank
        FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.ws = best.ws
        WHERE b IS NULL OR 100::HUGEINT * b < 80::HUGEINT * a
    )
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def _clusters(k: int, dims: int, rounds: int) -> str:
    """Vectors and centroids as one row a component; a step each for assignment and mean."""
    steps = [
        f"""WITH kept AS (
        SELECT row_number() OVER () AS v, vec_id, embedding FROM embeddings WHERE len(embedding) = {dims}
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
    ), p AS MATERIALIZED (
        SELECT v, i, floor(256 * embedding[i]::DOUBLE)::BIGINT AS x FROM kept, range(1, {dims} + 1) AS t (i)
    ), seeds AS (
        SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept
        QUALIFY c < {k}
    ), c0 AS MATERIALIZED (SELECT c, i, x FROM seeds JOIN p USING (v))"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (
        SELECT v, min(struct_pack(d := d, c := c)) AS best FROM (
            SELECT v, c, sum((p.x - q.x) * (p.x - q.x))::BIGINT AS d FROM p JOIN c{r} AS q USING (i) GROUP BY v, c
        ) GROUP BY v
    )"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (
        SELECT best.c AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM near{r} JOIN p USING (v) GROUP BY best.c, i
    ), c{r + 1} AS MATERIALIZED (
        SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{r} LEFT JOIN m{r} USING (c, i)
    )"""
            )
    return (
        ", ".join(steps)
        + f""", named AS (
        SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c
    )
    SELECT vec_id, c::INTEGER AS cluster, best.d AS distance,
        (sum(best.d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
        centroid_sha256
    FROM near{rounds} JOIN kept USING (v) JOIN named ON c = best.c"""
    )


ORACLES["op13_clustering"] = _clusters(40, 64, 5)
