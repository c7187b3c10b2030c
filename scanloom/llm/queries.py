"""One query per operator with production parameters over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import ego_join, language_id, line_dedup, line_frequency, merkle, mixing, packing, secret_forest, sentence_pieces, simhash, spelling, token_counts, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_vectors(_table(spark, sf_dir, "embeddings"), 0.98)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_frequency.line_rules(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of all words as the budget."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), F.floor(F.col("all_tokens") * 4 / 5))
    return mixed.select("doc_id", "domain", F.col("language").alias("leaf_language"), F.coalesce("source", F.lit(mixing.NONE)).alias("leaf_source"), "epoch", "tokens", "draw")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "chunks", "widened")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    return kept.select("doc_id", "lines_removed", F.size(lines).cast("long").alias("lines_kept"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_forest.scan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "number", F.md5(F.encode("candidate", "UTF-8")).alias("candidate_md5"), F.col("size").cast("long").alias("size"), "held_out", "label", "p_secret", "secret")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven or more letters that occur twice or more; of one run in 31 a letter is deleted first. A null id deletes none."""
    runs = spelling.letter_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"), 7, "text", "doc_id")
    mark = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (mark % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(mark % 31 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= 7)
    return spelling.spelling_variants(words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows proved; of every seventh (by its id's checksum) a copy with another n_chars is what is claimed."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = [F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")) if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    proved = merkle.prove(merkle.build(_table(spark, sf_dir, "documents"), merkle.leaf_digest(claimed)))
    proof = F.sha2(F.array_join("siblings", "").cast("binary"), 256)
    return proved.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_line_frequency": op4_line_frequency,
    "op5_mixing_sources": op5_mixing_sources,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_secret_forest": op10_secret_forest,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_sentence_pieces": op13_sentence_pieces,
}

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE good AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM good UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(component_id, e.vec_id), false) AS kept
FROM embeddings e LEFT JOIN counts ON counts.a = e.vec_id LEFT JOIN least ON least.a = e.vec_id
""",
    "op4_line_frequency": """
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw FROM docs),
worded AS (SELECT *, regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS lw
    FROM lines WHERE regexp_matches(raw, '[^\\x20\\x09-\\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM worded GROUP BY doc_id),
frequent AS (SELECT source, array_to_string(lw, ' ') AS line FROM worded GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 10),
removed AS (SELECT doc_id, sum(len(lw)) AS gone FROM worded JOIN frequent ON worded.source IS NOT DISTINCT FROM frequent.source
    AND array_to_string(lw, ' ') = line GROUP BY doc_id),
positions AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM positions),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(gone, 0))::BIGINT AS words_left
    FROM docs LEFT JOIN dups USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND words_left >= 20 AND words_left >= 0.3::DOUBLE * n_words AS kept FROM base
""",
    "op6_warc": """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM rows),
coded AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS v FROM firsts)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM coded
""",
    "op5_mixing_sources": """
WITH docs AS (
    SELECT doc_id, coalesce(lang, 'none') AS l, coalesce(source, 'none') AS s,
        coalesce('domain' || (try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT) % 4), 'none') AS d,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens
    FROM documents),
leaves AS (SELECT d, l, s, sum(tokens)::BIGINT AS have, 3 * sum(tokens)::BIGINT AS cap FROM docs GROUP BY ALL),
usable AS (SELECT * FROM leaves WHERE cap > 0),
d1 AS (SELECT d, sum(cap)::BIGINT AS cap, coalesce(map {'domain0': 4, 'domain1': 3, 'domain2': 2}[d], 1) AS w,
        floor((SELECT sum(have) FROM leaves) * 4 / 5)::DOUBLE AS b FROM usable GROUP BY d),
d2 AS (SELECT *, (b - coalesce(sum(cap) OVER (ORDER BY cap / w, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(w) OVER (ORDER BY cap / w, d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM d1),
d3 AS (SELECT d, CASE WHEN cap / w <= level THEN cap::DOUBLE
        ELSE w * max(CASE WHEN cap / w > level THEN level END) OVER () END AS b FROM d2),
l1 AS (SELECT u.d, u.l, sum(cap)::BIGINT AS cap, coalesce(map {'en': 5, 'de': 2, 'fr': 2}[u.l], 1) AS w, any_value(b) AS b
        FROM usable u JOIN d3 USING (d) GROUP BY u.d, u.l),
l2 AS (SELECT *, (b - coalesce(sum(cap) OVER (PARTITION BY d ORDER BY cap / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(w) OVER (PARTITION BY d ORDER BY cap / w, l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM l1),
l3 AS (SELECT d, l, CASE WHEN cap / w <= level THEN cap::DOUBLE
        ELSE w * max(CASE WHEN cap / w > level THEN level END) OVER (PARTITION BY d) END AS b FROM l2),
s1 AS (SELECT u.*, 1 AS w, b FROM usable u JOIN l3 USING (d, l)),
s2 AS (SELECT *, (b - coalesce(sum(cap) OVER (PARTITION BY d, l ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(w) OVER (PARTITION BY d, l ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM s1),
s3 AS (SELECT d, l, s, have, floor(CASE WHEN cap / w <= level THEN cap::DOUBLE
        ELSE w * max(CASE WHEN cap / w > level THEN level END) OVER (PARTITION BY d, l) END + 1e-6)::BIGINT AS given FROM s2),
plan AS (SELECT d, l, s, given // have AS whole, given % have AS rest FROM s3),
drawn AS (SELECT docs.*, whole, rest, md5('mix-1|' || whole || '|' || doc_id) AS next FROM docs JOIN plan USING (d, l, s)),
cut AS (SELECT *, sum(tokens) OVER (PARTITION BY d, l, s ORDER BY next) AS upto FROM drawn),
epochs AS (SELECT *, unnest(range(0, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM cut)
SELECT doc_id, d AS domain, l AS leaf_language, s AS leaf_source, epoch, tokens, md5('mix-1|' || epoch || '|' || doc_id) AS draw FROM epochs
""",
    "op11_spelling_variants": """
WITH RECURSIVE runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
pairs AS (SELECT doc_id, run, count(*) AS times, doc_id::VARCHAR || ':' || run AS s FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
marked AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(s) + 1),
        lambda i: CASE WHEN ord(s[i]) < 128 THEN [ord(s[i])::BIGINT] ELSE [(ord(s[i]) >> 6 | 192)::BIGINT, (ord(s[i]) & 63 | 128)::BIGINT] END))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) AS h FROM pairs),
words AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(times)::BIGINT AS n
    FROM marked GROUP BY 1 HAVING length(word) >= 7 AND sum(times) >= 2),
cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
variants AS (SELECT word, n, i, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS v FROM cuts),
links AS (
    SELECT a.word AS a, b.word AS b, b.n FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM variants a JOIN words b ON a.v = b.word
    UNION SELECT b.word, a.word, a.n FROM variants a JOIN words b ON a.v = b.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS top FROM links GROUP BY a),
forms AS (SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * words.n THEN top END AS form_n,
    CASE WHEN top >= 10 * words.n THEN (SELECT min(b) FROM links WHERE links.a = word AND links.n = top) END AS form FROM words LEFT JOIN best ON a = word),
ways AS (SELECT word, word AS place, form AS next FROM forms UNION ALL SELECT w.word, f.word, f.form FROM ways w JOIN forms f ON f.word = w.next)
SELECT forms.word, form, place AS root, n, n_near, form_n FROM forms JOIN ways ON ways.word = forms.word AND ways.next IS NULL
""",
    "op12_merkle_manifest": """
WITH RECURSIVE coded AS (
    SELECT doc_id, lang, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')) AS f,
        coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1), '-') AS more,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)),
            lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) AS crc FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM (
    SELECT doc_id, lang, sha256(array_to_string(f, '')) AS leaf, sha256(f[1] || f[2] || f[3] || (CASE WHEN crc % 7 = 0 THEN more ELSE f[4] END) || f[5]) AS claimed FROM coded)),
low AS (SELECT lang, 0 AS level, i, n, leaf AS h FROM leaves UNION ALL
    SELECT lang, level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lang, level, i // 2),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS k FROM low WHERE n = 1),
top AS (SELECT 0 AS level, g AS i, k AS n, h FROM subroots UNION ALL
    SELECT level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2),
steps AS (
    SELECT l.lang, l.i, p.level, p.i & 1 AS side, s.h FROM leaves l JOIN low p ON p.lang IS NOT DISTINCT FROM l.lang AND p.n > 1 AND p.i = l.i >> p.level
        LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = p.level AND s.i = xor(p.i, 1)
    UNION ALL
    SELECT l.lang, l.i, 1000 + p.level, p.i & 1, s.h FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN top p ON p.n > 1 AND p.i = r.g >> p.level
        LEFT JOIN top s ON s.level = p.level AND s.i = xor(p.i, 1)),
paths AS (SELECT lang, i, list(CASE WHEN h IS NULL THEN 'N' WHEN side = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY level) AS path,
    coalesce(string_agg(h, '' ORDER BY level), '') AS proof FROM steps GROUP BY lang, i),
folded AS (SELECT l.*, r.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(claimed, coalesce(path, [])), lambda a, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || a) WHEN 'R' THEN sha256(a || s[2:]) ELSE sha256(a) END) AS folded_root
    FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
""",
}
