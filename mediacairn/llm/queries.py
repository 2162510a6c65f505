"""The corpus operators over the given tables, and the SQL that checks them where SQL can."""

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    bpe,
    embedding_dedup,
    exact_dedup,
    html_extract,
    language_id,
    lm_scoring,
    mixing,
    near_dedup,
    resampling,
    secret_scan,
    spelling,
    topk_search,
    toxicity,
)
from .common import LOWER, UPPER, table

QUERIES = {}
CHECKS = {}


def query(name, check=None):
    def add(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check.strip()
        return fn
    return add


@query("op2_exact_dedup", f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
""")
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op6_mixing", f"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS words FROM t GROUP BY source),
w AS (SELECT source, words, 2 * words AS cap,
             [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
f AS (SELECT *, (1.5 * sum(words) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, words, least(cap, weight * max(level) OVER ()) AS target,
             ('0x' || md5('{mixing.SEED}' || coalesce(':' || source, '?'))[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size,
             doc_id % (SELECT greatest(1, ceil(count(*) / {mixing.ROWS_A_SALT})::BIGINT) FROM documents), doc_id) - 1 AS rank FROM t)
SELECT doc_id, size, words::BIGINT AS source_size, target,
       (size * least(2, floor(coalesce(target / nullif(words, 0), 0) * (rank + 1) + u) - floor(coalesce(target / nullif(words, 0), 0) * rank + u)))::BIGINT AS taken
FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source
""")
def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_bpe")
def op4_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("row.doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_near_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) > 3 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
                                        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS set FROM w),
d AS (SELECT list_sort(set) AS set, min(doc_id) AS id, len(any_value(set)) AS n FROM s WHERE len(set) > 0 GROUP BY 1),
x AS (SELECT id, n, unnest(set) AS shingle FROM d),
p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (WITH RECURSIVE r(id, root) AS (SELECT id, id FROM d UNION SELECT p.b, r.root FROM r JOIN p ON r.id = p.a) SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT s.doc_id, len(s.set)::BIGINT AS n_shingles, coalesce(r.root, s.doc_id) AS component_id, s.doc_id = coalesce(r.root, s.doc_id) AS kept
FROM s LEFT JOIN d ON list_sort(s.set) = d.set LEFT JOIN r ON r.id = d.id
""")
def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op7_topk_search", """
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             coalesce(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])), 0)::BIGINT AS score
      FROM t q JOIN t c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def op7_topk_search(spark, sf_dir):
    rows = topk_search.quantised(table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")))
    return topk_search.top_k(rows.filter("id % 50 = 0"), rows, 5)


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = lambda doc_id: F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
    network = language_id.learn(docs.filter(~held_out("doc_id")).select("doc_id", "lang", "text"))
    found = language_id.predict(docs.select("doc_id", "text"), network)
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), F.col("lang").alias("lang_pred"), "score")


@query("op10_html_extract", r"""
SELECT page_id, url, text, len(text)::BIGINT AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), ''), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages)
""")
def op10_html_extract(spark, sf_dir):
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op8_lm_scoring")
def op8_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    found = lm_scoring.scores(docs, docs.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query("op5_secret_scan")
def op5_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.learn(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.predict(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("row.doc_id", "toxic", "p_insult", "p_contempt", "p_toxic")


def crc32_sql(text):
    """DuckDB SQL of the CRC-32 of a string's UTF-8 bytes: each byte is mixed in, then eight bits go through the polynomial."""
    steps = f"flatten(list_transform(range(0, octet_length(encode({text}))), lambda i: [('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(list_reduce(list_concat([4294967295], {steps}), "
            "lambda c, x: CASE WHEN x < 0 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, x) END), 4294967295)")


@query("op11_spelling_variants", rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE len(run) >= 5 GROUP BY ALL),
h AS (SELECT *, {crc32_sql("doc_id || ':' || run")} AS h FROM d),
o AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, len(word) AS l, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM w)),
e AS (SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.l = b.l AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.rest = w.word
      UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.rest = w.word),
b AS (SELECT word, other, n AS other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k FROM e),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
      FROM w LEFT JOIN b ON w.word = b.word AND k = 1),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM f JOIN c USING (word) JOIN f AS last ON c.at = last.word AND last.form IS NULL
""")
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_embedding_dedup", """
WITH RECURSIVE g AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS root FROM g UNION SELECT p.b, r.root FROM r JOIN p ON r.id = p.a),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m.root, vec_id) AS component_id, vec_id = coalesce(m.root, vec_id) AS kept
FROM embeddings LEFT JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id
""")
def op12_embedding_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embedding_dedup.near_vectors(rows).select("vec_id", "n_links", "component_id", "kept")


@query("op13_importance_resampling", rf"""
WITH t AS (SELECT true AS aim, item_id AS id, text FROM benchmark UNION ALL SELECT false, doc_id, text FROM documents),
o AS (SELECT aim, id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM t),
c AS (SELECT aim, id, word, count(*) AS n FROM o GROUP BY ALL),
k AS (SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM c)),
q AS (SELECT bucket, sum(CASE WHEN aim THEN 0 ELSE n END)::DOUBLE AS s, sum(CASE WHEN aim THEN n ELSE 0 END)::DOUBLE AS t FROM c JOIN k USING (word) GROUP BY bucket),
z AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM q),
w AS (SELECT id, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM c JOIN k USING (word) JOIN z USING (bucket) WHERE NOT aim GROUP BY id),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM documents LEFT JOIN w ON w.id = doc_id),
f AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
             count(*) FILTER (n_features >= 20) OVER () AS able FROM d)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM f
""")
def op13_importance_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resampling.resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")
