"""The operators on the fixture tables, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import language_id, quality_fm, toxicity
from logtide.llm.chat_format import LOG_ORDER, digests, formatted, logged
from logtide.llm.collocations import collocations
from logtide.llm.common import fold, table
from logtide.llm.conversation_trie import prefix_trie
from logtide.llm.decontaminate import marked
from logtide.llm.html_extract import main_texts
from logtide.llm.jaccard_join import near_copies
from logtide.llm.sentencepiece_sampling import sampled_segmentations
from logtide.llm.simhash_join import near_duplicates
from logtide.llm.token_counts import token_counts
from logtide.llm.topk_search import top_k


def in_fold(of: int, left_out: int) -> Column:
    """Whether a row is held out; one without an id is learned from by nobody, but not held out."""
    return F.coalesce(fold(F.col("doc_id"), of) == left_out, F.lit(False))


def op1_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(spark, table(spark, folder, "embeddings"), every=50, k=5)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = toxicity.scored(spark, docs, toxicity.learn(docs, table(spark, folder, "labels")))
    held_out = in_fold(toxicity.FOLDS, toxicity.LEFT_OUT)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


def op3_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(spark, table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(spark, table(spark, folder, "documents"))


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digests(formatted(logged(rows.union(extra)), *LOG_ORDER))


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sampled_segmentations(spark, table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = quality_fm.scored(spark, docs, quality_fm.learn(docs, table(spark, folder, "labels")))
    held_out = in_fold(quality_fm.FOLDS, quality_fm.LEFT_OUT)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_fm.GOOD).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = marked(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span[1] - span[0])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.identified(spark, docs, language_id.learn(docs))
    return found.select("doc_id", in_fold(3, 1).alias("held_out"), "lang_pred", "score", "accepted")


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark, table(spark, folder, "documents"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(spark, table(spark, folder, "conversations"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(spark, table(spark, folder, "documents"))


QUERIES = {"op1_topk_search": op1_topk_search, "op2_toxicity": op2_toxicity, "op3_html_extract": op3_html_extract, "op4_token_counts": op4_token_counts, "op5_jaccard_join": op5_jaccard_join, "op6_chat_format": op6_chat_format, "op7_sentencepiece": op7_sentencepiece, "op8_quality_fm": op8_quality_fm, "op9_decontaminate": op9_decontaminate, "op10_language_id": op10_language_id, "op11_simhash": op11_simhash, "op12_prefix_trie": op12_prefix_trie, "op13_collocations": op13_collocations}

#: The escapes of chat formatting: backslashes first, then one after the first character of each control string.
_ESCAPED = """replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op5_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                          lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
             e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
             l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
                   GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
             r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
        FROM s JOIN (SELECT id, min(reached) AS component_id FROM r GROUP BY id) ON doc_id = id""",
    "op9_decontaminate": rf"""
        WITH i AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             p AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS x
                   FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
             d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             o AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS x
                   FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p))),
             h AS (SELECT doc_id, item_id, k, n FROM o JOIN p USING (n, x)),
             c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM h) GROUP BY doc_id),
             t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
                   FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op1_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
                   FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_chat_format": f"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role)) AS loss_sha256,
               CAST(sum(11 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
        FROM r GROUP BY conv_id""",
    "op12_prefix_trie": r"""
        WITH t AS (SELECT conv_id, coalesce(text, '') AS text, coalesce(role, '') AS role, turn,
                          md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL),
             o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, x) AS k FROM t),
             c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, list(x ORDER BY k) AS own FROM o GROUP BY conv_id),
             h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(unicode(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
                          lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 4 AS h FROM c),
             r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h], h.own[h + 1:]) AS s FROM h LEFT JOIN c b ON b.conv_id = h.base),
             m AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS p FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM r)),
             w AS (SELECT x, any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words FROM t GROUP BY x),
             g AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                          sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY p, d),
             k AS (SELECT p[1:d - 1] AS parent, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
             v AS (SELECT g.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(words, 0) AS saved FROM g LEFT JOIN k ON k.parent = g.p LEFT JOIN w ON w.x = g.p[d]),
             a AS (SELECT p[1:e] AS top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
                   FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM v) GROUP BY 1)
        SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
        FROM v JOIN a ON a.top = v.p LEFT JOIN v u ON v.d > 0 AND u.p = v.p[1:v.d - 1]""",
    "op13_collocations": rf"""
        WITH q AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS q FROM documents),
             w AS (SELECT lang, regexp_extract_all(q, '[^\x20\x09]+') AS w FROM q),
             n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
             o AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
             f AS (SELECT lang, k, array_to_string(p, ' ') AS phrase, any_value(p) AS p, count(*) AS a FROM o GROUP BY lang, k, phrase HAVING count(*) >= 30),
             c AS (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
             s AS (SELECT c.lang, c.phrase, c.k, c.a, x.a AS l, y.a AS r, cut, CAST((CAST(c.a AS HUGEINT) * 2000000) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
                   FROM c JOIN f x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(c.p[1:cut], ' ')
                          JOIN f y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(c.p[cut + 1:c.k], ' ')),
             b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM s),
             i AS (SELECT DISTINCT lang, a, z, array_to_string(p[st:st + z - 1], ' ') AS phrase
                   FROM (SELECT *, unnest(range(1, k - z + 2)) AS st FROM (SELECT *, unnest(range(2, k)) AS z FROM f WHERE k > 2))),
             d AS (SELECT lang, z AS k, phrase, max(a) AS longer FROM i GROUP BY lang, z, phrase),
             e AS (SELECT b.* FROM b LEFT JOIN d USING (lang, k, phrase) WHERE best = 1 AND NOT coalesce(100 * CAST(longer AS HUGEINT) >= 80 * CAST(a AS HUGEINT), false)),
             t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
        SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000""",
}
