"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, hmm_lm, jaccard_join, lexical_search, license_scan, packing, secret_scan, spelling, substring_dedup, token_store, toxicity
from .common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hmm_lm(spark, sf_dir):
    return hmm_lm.score_documents(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op3_decontamination(spark, sf_dir):
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op8_token_store(spark, sf_dir):
    return token_store.store_and_read(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op9_license_scan(spark, sf_dir):
    return license_scan.scan_licences(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark, sf_dir):
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op13_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_hmm_lm": op1_hmm_lm,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_bpe": op4_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_store": op8_token_store,
    "op9_license_scan": op9_license_scan,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_lexical_search": op11_lexical_search,
    "op12_packing": op12_packing,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL = {
    "op2_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)
    """,
    "op10_jaccard_join": """
        WITH RECURSIVE d AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (
            SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id AS x, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x WHERE r.root < e.y)
        SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id
        FROM d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1
    """,
    "op11_lexical_search": """
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents),
        s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
        x AS (SELECT r, any_value(doc_id) AS doc_id, any_value(len(t)) AS n, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM d) GROUP BY r, term),
        q AS (
            SELECT item_id, term, count(*) AS c
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                  FROM (SELECT DISTINCT item_id, text FROM benchmark))
            GROUP BY 1, 2),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM x, s GROUP BY term, n_docs),
        scored AS (
            SELECT item_id, r, any_value(doc_id) AS doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM q JOIN x USING (term) JOIN w USING (term), s GROUP BY item_id, r),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    # crc32 by its table; near words share what is left without one letter (at one place, if they are of one size).
    "op13_spelling": """
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
            FROM range(256) r(i)),
        runs AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
            FROM documents),
        once AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
        bytes AS (
            SELECT id, run, n, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END FOR c IN string_split(id || ':' || run, '')]) AS b
            FROM once),
        hashed AS (
            SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[1 + (xor(c, x) & 255)])), 4294967295) AS h
            FROM bytes, crc),
        w AS (
            SELECT word, sum(n)::BIGINT AS n
            FROM (SELECT CASE WHEN h % 199 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed)
            WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
        less AS (SELECT DISTINCT word, i, word[: i] || word[i + 2 :] AS part FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
        near AS (
            SELECT a.word, b.word AS other FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
            UNION SELECT l.word, w.word FROM less l JOIN w ON w.word = l.part
            UNION SELECT w.word, l.word FROM less l JOIN w ON w.word = l.part),
        best AS (
            SELECT near.word, count(*) AS n_near, max(o.n) AS form_n, arg_min(o.word, (-o.n, o.word)) AS form
            FROM near JOIN w o ON o.word = near.other GROUP BY 1),
        f AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
            FROM w LEFT JOIN best ON best.word = w.word),
        r AS (
            SELECT word, word AS root, form AS onward FROM f
            UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.onward)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word WHERE r.onward IS NULL
    """,
}
