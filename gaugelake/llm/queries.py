"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.llm._shared import materialize, work_path
from gaugelake.llm.embedding_dedup import near_vectors
from gaugelake.llm.license_scan import PHRASES, TEMPLATES, scan_licenses, words_of
from gaugelake.llm.line_dedup import dedup_lines
from gaugelake.llm.minhash_dedup import near_duplicates
from gaugelake.llm.mixing import mix_sources, words_in
from gaugelake.llm.packing import pack_documents
from gaugelake.llm.phrases import mine_phrases
from gaugelake.llm.pretokens import tokenizer_path
from gaugelake.llm.quality_rules import CLASSES, COMMON_WORDS, quality_rules
from gaugelake.llm.sentence_spans import WIDE_STOPS, dedup_spans
from gaugelake.llm.substring_dedup import remove_repeats
from gaugelake.llm.token_counts import count_tokens
from gaugelake.llm.token_files import read_token_files, write_token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_documents(spark, sf_dir), carry=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("row.doc_id", *[F.col("quality").getField(n).alias(n) for n in names])


def _op3_sql() -> str:
    lists = " ".join(f"WHEN '{code}' THEN [{', '.join(repr(w) for w in words)}]" for code, words in COMMON_WORDS.items())
    classes = f"[{', '.join(CLASSES)}]"
    distance = """sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda x: 0.5 * (
        CASE WHEN x[1] > 0 THEN x[1] * log2(2 * x[1] / (x[1] + x[2])) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] * log2(2 * x[2] / (x[1] + x[2])) ELSE 0 END))), 0))"""
    share = lambda c: f"list_transform({c}, lambda x: x / nullif(list_sum({c})::DOUBLE, 0))"
    return f"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(repr(c) for c in COMMON_WORDS)}) THEN lang ELSE 'other' END AS lang,
            regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), c AS (
        SELECT *, len(w) AS n, length(array_to_string(w, '')) AS word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS symbol, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS upper,
            length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) - upper AS letter, length(regexp_replace(t, '[^\\p{{Nd}}]+', '', 'g')) AS digit,
            length(regexp_replace(t, '[^.,;:!?''"()-]+', '', 'g')) AS mark, length(t) - word_chars AS space,
            length(t) - upper - letter - digit - mark - symbol - space AS rest,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
            CASE lang {lists} END AS common
        FROM d
    ), h AS (
        SELECT *, {classes} AS chars, list_transform(list_concat(common, [NULL]), lambda u: CASE WHEN u IS NULL
            THEN len(list_filter(w, lambda x: NOT list_contains(common, lower(x)))) ELSE len(list_filter(w, lambda x: lower(x) = u)) END) AS words
        FROM c
    ), g AS (
        SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, n - 1)) AS i FROM h WHERE n >= 3)
    ), p AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g
    ), o AS (
        SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM p WHERE k >= 2) GROUP BY doc_id
    ), r AS (
        SELECT lang, {', '.join(f'sum(chars[{i + 1}]) AS c{i}' for i in range(len(CLASSES)))}, {', '.join(f'sum(words[{i + 1}]) AS w{i}' for i in range(21))}
        FROM h LEFT JOIN o ON h.doc_id = o.doc_id WHERE n >= 100 AND 100 * coalesce(n_repeat, 0) <= 50 * n GROUP BY lang
    ), rr AS (
        SELECT lang, [{', '.join(f'c{i}::DOUBLE' for i in range(len(CLASSES)))}] AS rc, [{', '.join(f'w{i}::DOUBLE' for i in range(21))}] AS rw FROM r
    ), f AS (
        SELECT h.doc_id, n, h.word_chars, symbol, len(lines) - len(list_distinct(lines)) AS dup, coalesce(n_repeat, 0) AS n_repeat,
            {distance.format(p=share('chars'), q=share('rc'))} AS cd,
            CASE WHEN words IS NULL THEN NULL ELSE {distance.format(p=share('words'), q=share('rw'))} END AS wd
        FROM h LEFT JOIN rr ON h.lang = rr.lang LEFT JOIN o ON h.doc_id = o.doc_id
    )
    SELECT doc_id, n::BIGINT AS n_words, word_chars::BIGINT AS word_chars, symbol::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words,
        (n < 50 OR 100 * n_repeat > 50 * n) AS base_failed,
        NOT (n < 50 OR 100 * n_repeat > 50 * n) AND NOT (n >= 100 AND (coalesce(cd, 0) > 0.28 OR coalesce(wd, 0) > 0.3)) AS kept
    FROM f"""


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), width=3, percent=85)


_OP1_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), p AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), l AS (
    SELECT a.doc_id AS u, b.doc_id AS v FROM p AS a JOIN p AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
    SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
), c AS (
    SELECT u, min(v) AS component_id FROM r GROUP BY u
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON doc_id = u
"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = materialize(_documents(spark, sf_dir).select("doc_id", "source", words_in(F.col("text")).alias("size")), "words")
    sized, draws, _ = mix_sources(docs, size_col="size")
    # Documents equal in id, source and size are drawn alike, once a pass each.
    drawn = draws.groupBy(F.col("row.doc_id").alias("_id"), F.col("row.source").alias("_source"), F.col("size").alias("_size"), "pass").agg(F.first("size").alias("words"))
    drawn = drawn.groupBy("_id", "_source", "_size").agg(F.sum("words").alias("words"))
    mine = F.col("row.doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    return sized.join(drawn, mine, "left").select("row.doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


_OP2_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS number FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source
), w AS (
    SELECT *, list_extract([3.0, 1.0, 2.0], ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT)::DOUBLE AS weight FROM s
), l AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY 2::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY 2::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
    SELECT source, source_size, n_docs, CASE WHEN source_size > 0 THEN least(2::DOUBLE * source_size,
        weight * coalesce(max(CASE WHEN level * weight <= 2::DOUBLE * source_size THEN level END) OVER (), 'inf'::DOUBLE)) ELSE 0 END AS target FROM l
), p AS (
    SELECT *, least(65536, greatest(1, n_docs // 16)) AS blocks, floor(target / greatest(source_size, 1)) AS passes, target - floor(target / greatest(source_size, 1)) * source_size AS rest FROM t
), e AS (
    SELECT d.*, p.source_size, p.target, p.passes, p.rest, number % blocks AS block,
        sum(size) OVER (PARTITION BY d.source ORDER BY number % blocks, number, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
        sum(size) OVER (PARTITION BY d.source ORDER BY number % blocks RANGE UNBOUNDED PRECEDING) AS block_end
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (size * (passes + CASE WHEN rest > 0 AND (block_end <= rest OR upto - size / 2 <= rest) THEN 1 ELSE 0 END))::BIGINT AS taken FROM e
"""


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_OP4_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: (x * x)::DOUBLE), 'sum') > 0
), l AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
    SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
), c AS (
    SELECT u, min(v) AS component_id FROM r GROUP BY u
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings AS e JOIN c ON e.vec_id = c.u LEFT JOIN (SELECT u, count(*) AS n FROM l GROUP BY u) AS k ON e.vec_id = k.u
"""


def _kept_text(found: DataFrame, *counts: str) -> DataFrame:
    n_bytes = F.octet_length(F.coalesce("row.text", F.lit("")))
    kept = F.coalesce("text", F.lit(""))
    return found.select("row.doc_id", n_bytes.cast("long").alias("n_bytes"), (n_bytes - F.octet_length(kept)).cast("long").alias("n_removed"), *counts, F.sha2(kept, 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_text(dedup_lines(_documents(spark, sf_dir).select("doc_id", "text", "source")), "n_lines", "n_removed_lines")


_OP5_SQL = r"""
WITH l AS (
    SELECT doc_id, source, i, line, regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g') AS t
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
), b AS (
    SELECT t, min((doc_id, i)) AS first FROM l WHERE regexp_matches(t, '^(?:[^ \t-\r]+[ \t-\r]+){2}[^ \t-\r]') GROUP BY t HAVING count(DISTINCT source) >= 5
), k AS (
    SELECT l.*, b.t IS NOT NULL AND (doc_id, i) <> first AS gone FROM l LEFT JOIN b ON l.t = b.t
), d AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed_lines, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id
)
SELECT o.doc_id, strlen(coalesce(o.text, ''))::BIGINT AS n_bytes, (strlen(coalesce(o.text, '')) - strlen(coalesce(kept, '')))::BIGINT AS n_removed,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents AS o LEFT JOIN d ON o.doc_id = d.doc_id
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "tokens")
    manifest = write_token_files(_documents(spark, sf_dir), folder, tokenizer_path("byte_bpe_50k.json"))
    read = read_token_files(spark, manifest, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_text(dedup_spans(_documents(spark, sf_dir).select("doc_id", "text")), "n_removed_words", "n_spans")


_OP10_SQL = rf"""
WITH t AS (
    SELECT doc_id, text, regexp_extract_all(text, '(?:[^ \t-\r{WIDE_STOPS}]*[{WIDE_STOPS}]|[^ \t-\r{WIDE_STOPS}]+)[ \t-\r]*') AS p FROM documents WHERE text IS NOT NULL
), a AS (
    SELECT doc_id, len(p) AS n_words, list_transform(p, lambda x: regexp_replace(x, '[ \t-\r]+$', '')) AS words FROM t
), w AS (
    SELECT doc_id, i, piece, regexp_replace(piece, '[ \t-\r]+$', '') AS word FROM (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS i FROM t)
), s AS (
    SELECT doc_id, i, piece, ('0x' || substr(md5(word), 1, 15))::BIGINT AS h,
        coalesce(sum((contains(piece, chr(10)) OR regexp_matches(word, '[.!?{WIDE_STOPS}]$'))::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w
), q AS (
    SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n, row_number() OVER (PARTITION BY doc_id, s ORDER BY i) - 1 AS p FROM s
), v AS (
    SELECT doc_id, n, p, min((h, -i)) OVER (PARTITION BY doc_id, s ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS m FROM q WHERE n > 16
), c AS (
    SELECT DISTINCT doc_id, -m[2] AS i FROM v WHERE p <= n - 16
), u AS (
    SELECT q.doc_id, q.i AS a, row_number() OVER (PARTITION BY q.doc_id ORDER BY q.i) AS u FROM q LEFT JOIN c ON q.doc_id = c.doc_id AND q.i = c.i WHERE p = 0 OR c.i IS NOT NULL
), e AS (
    SELECT u.*, coalesce(lead(a) OVER (PARTITION BY u.doc_id ORDER BY u), n_words) AS b FROM u JOIN a ON u.doc_id = a.doc_id
), r AS (
    SELECT x.doc_id, x.a, min(y.b) AS b FROM e AS x JOIN e AS y ON x.doc_id = y.doc_id AND y.u BETWEEN x.u + 1 AND x.u + 20 AND y.b - x.a >= 20 GROUP BY x.doc_id, x.a
), k AS (
    SELECT * FROM r UNION ALL SELECT doc_id, 0, n_words FROM a WHERE n_words > 0 AND doc_id NOT IN (SELECT doc_id FROM r)
), f AS (
    SELECT k.doc_id, k.a, k.b, min((k.doc_id, k.a)) OVER (PARTITION BY array_to_string(words[k.a + 1:k.b], ' ')) <> (k.doc_id, k.a) AS later FROM k JOIN a ON k.doc_id = a.doc_id
), g AS (
    SELECT DISTINCT doc_id, unnest(range(a, b)) AS i FROM f WHERE later
), x AS (
    SELECT q.*, g.i IS NOT NULL AS gone, g.i IS NOT NULL AND lag(g.i) OVER (PARTITION BY q.doc_id ORDER BY q.i) IS NULL AS starts FROM q LEFT JOIN g ON q.doc_id = g.doc_id AND q.i = g.i
), z AS (
    SELECT doc_id, count(*) FILTER (starts) AS n_spans, count(*) FILTER (gone) AS n_gone, bool_or(gone AND i = 0) AS gone0, coalesce(string_agg(piece, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM x GROUP BY doc_id
), o AS (
    SELECT d.doc_id, coalesce(d.text, '') AS text, coalesce(n_gone, 0) AS n_gone, coalesce(n_spans, 0) AS n_spans,
        CASE WHEN coalesce(n_gone, 0) = 0 THEN coalesce(d.text, '') WHEN gone0 THEN kept ELSE regexp_extract(d.text, '^[ \t-\r]*') || kept END AS kept
    FROM documents AS d LEFT JOIN z ON d.doc_id = z.doc_id
)
SELECT doc_id, strlen(text)::BIGINT AS n_bytes, (strlen(text) - strlen(kept))::BIGINT AS n_removed, n_gone::BIGINT AS n_removed_words, n_spans::BIGINT AS n_spans, sha256(kept) AS kept_sha256 FROM o
"""


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_documents(spark, sf_dir))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP11_SQL = rf"""
WITH p AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), f1 AS (
    SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(w) AS g FROM p) GROUP BY lang, g
), f2 AS (
    SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM p WHERE len(w) >= 2) GROUP BY lang, g
), f3 AS (
    SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM p WHERE len(w) >= 3) GROUP BY lang, g HAVING count(*) >= 10
), c AS (
    SELECT lang, g AS phrase, f AS a, 1 AS k, split_part(g, ' ', 1) AS head, split_part(g, ' ', 2) AS tail FROM f2 WHERE f >= 10
    UNION ALL SELECT lang, g, f, 1, split_part(g, ' ', 1), split_part(g, ' ', 2) || ' ' || split_part(g, ' ', 3) FROM f3
    UNION ALL SELECT lang, g, f, 2, split_part(g, ' ', 1) || ' ' || split_part(g, ' ', 2), split_part(g, ' ', 3) FROM f3
), f AS (
    SELECT * FROM f1 UNION ALL SELECT * FROM f2
), s AS (
    SELECT c.*, h.f AS l, t.f AS r, (1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f) AS score FROM c JOIN f AS h ON c.lang = h.lang AND head = h.g JOIN f AS t ON c.lang = t.lang AND tail = t.g
), b AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s) WHERE cut = 1
), i AS (
    SELECT lang, g, max(f) AS longer FROM (SELECT lang, f, unnest([split_part(g, ' ', 1) || ' ' || split_part(g, ' ', 2), split_part(g, ' ', 2) || ' ' || split_part(g, ' ', 3)]) AS g FROM f3) GROUP BY lang, g
), o AS (
    SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN i ON b.lang = i.lang AND b.phrase = i.g WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT o.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o JOIN (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang) AS t ON o.lang = t.lang WHERE rank <= 2000
"""


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_documents(spark, sf_dir))
    return found.drop("matches")


def _op12_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    rows = ", ".join(f"('{label}', {len(words_of(t))}, {quoted(sorted(set(words_of(t))))})" for label, t in TEMPLATES)
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(words_of(p))}] = {quoted(words_of(p))})) AS i FROM w" for label, p in PHRASES
    )
    return rf"""
    WITH w AS (
        SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), t AS (
        SELECT * FROM (VALUES {rows}) AS t(label, k, tokens)
    ), b AS (
        SELECT doc_id, label, tokens, w[a + 1:a + 2 * k] AS block FROM (SELECT *, unnest(range(0, len(w), k)) AS a FROM w, t)
    ), m AS (
        SELECT doc_id, label, len(list_intersect(list_distinct(block), tokens)) AS shared, len(tokens) AS size FROM b
    ), h AS (
        SELECT doc_id, label, max(shared::DOUBLE / size) AS share FROM m WHERE 100 * shared >= 85 * size GROUP BY doc_id, label
    ), p AS ({phrases}), n AS (
        SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id
    ), e AS (
        SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM h UNION ALL SELECT doc_id, label FROM p) GROUP BY doc_id
    ), s AS (
        SELECT doc_id, max(share) AS score FROM h GROUP BY doc_id
    )
    SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN e ON w.doc_id = e.doc_id LEFT JOIN s ON w.doc_id = s.doc_id"""


def queries() -> dict:
    every = (
        op1_minhash_dedup, op2_mix_sources, op3_quality_rules, op4_embedding_dedup, op5_line_dedup, op6_token_counts, op7_packing,
        op8_substring_dedup, op9_token_files, op10_sentence_spans, op11_phrases, op12_license_scan,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """None for op6, op7, op8 and op9: tokenizers and repeated byte strings of a whole corpus are beyond SQL; tests hold them against brute force."""
    return {
        "op1_minhash_dedup": _OP1_SQL,
        "op2_mix_sources": _OP2_SQL,
        "op3_quality_rules": _op3_sql(),
        "op4_embedding_dedup": _OP4_SQL,
        "op5_line_dedup": _OP5_SQL,
        "op10_sentence_spans": _OP10_SQL,
        "op11_phrases": _OP11_SQL,
        "op12_license_scan": _op12_sql(),
    }
