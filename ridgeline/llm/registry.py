"""The corpus operators as named queries over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, merkle, mixing, neighbours, packing, quality, secrets, simhash, spelling, substrings, tokencounts, toxicity
from .common import n_words, table, written

#: A public byte-level vocabulary; any path that the driver can read will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written within, so that texts go to Python in small batches; the digest itself is a short row a document.
    return written(substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))), "digest")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.best_fit(docs, n_words("text"), ["doc_id"])


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # A document stands for a repository, and its source for the owner.
    return secrets.digest(secrets.scan_secrets(docs, carry=["doc_id"]))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    kinds = turns.schema
    extra = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"].dataType).alias("conv_id"), F.col("id").cast(kinds["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return chat.digest(chat.format_chats(turns.unionByName(extra)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality.judge_quality(docs, table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, lexicon, [F.col("doc_id")])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    return tokencounts.length_histogram(tokencounts.encoded(docs, VOCABULARY))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, n_words("text"), ["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    later = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.manifest(docs, changed={"n_chars": later})
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"), noise=31)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_best_fit_packing, op3_secret_scans, op4_chat_formatting, op5_quality_rules, op6_nearest_neighbours, op7_toxicity, op8_token_counts, op9_jaccard_join, op10_mixing_sources, op11_merkle_manifest, op12_simhash_near_dedup, op13_spelling_variants)}

_TURN = "coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10)"
#: unsigned crc32 of a text's UTF-8 bytes, by a table of 256 entries that the first CTE makes from the polynomial.
_CRC = """
        steps AS (SELECT list(c ORDER BY i) AS tab FROM (
            SELECT i, list_reduce(list_concat([i], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS c FROM range(256) r(i)))"""


def _crc32(text: str) -> str:
    bytes_ = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"


def _levels(name: str, of: str, by: str) -> str:
    """All levels of the trees of lists `of` (by, nodes), as a recursive CTE."""
    above = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
    return f"{name} AS (SELECT {by}, 0 AS level, nodes FROM {of} UNION ALL SELECT {by}, level + 1, {above} FROM {name} WHERE len(nodes) > 1)"


ORACLES = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE {_CRC.strip()}, d AS (
            SELECT doc_id, coalesce(lang, '') AS lang, lang IS NOT NULL AS named, {_LEAF} AS leaf,
                   CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS later, n_chars, source, text FROM documents, steps
        ), p AS (
            SELECT doc_id, lang, named, leaf, {_LEAF.replace("n_chars", "later").replace("strlen(lang::VARCHAR) || ':' || lang", "CASE WHEN named THEN strlen(lang) || ':' || lang END")} AS found,
                   row_number() OVER (PARTITION BY named, lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d
        ), trees AS (SELECT named, lang, list(leaf ORDER BY idx) AS nodes FROM p GROUP BY ALL),
        {_levels("low", "trees", "named, lang")},
        tops AS (SELECT named, lang, nodes[1] AS subroot, row_number() OVER (ORDER BY named, lang) - 1 AS top_idx FROM low WHERE len(nodes) = 1),
        forest AS (SELECT list(subroot ORDER BY top_idx) AS nodes, 1 AS one FROM tops),
        {_levels("high", "forest", "one")},
        fold AS (
            SELECT doc_id, leaf, found AS digest, named, lang, idx, 0 AS level, 0 AS part, '' AS said FROM p
            UNION ALL
            SELECT doc_id, leaf, CASE WHEN width = 1 THEN digest WHEN idx % 2 = 0 THEN sha256(digest || coalesce(sibling, '')) ELSE sha256(sibling || digest) END, named, lang,
                   CASE WHEN width = 1 THEN top_idx ELSE idx // 2 END, CASE WHEN width = 1 THEN 0 ELSE level + 1 END, CASE WHEN width = 1 THEN 1 ELSE part END, said || coalesce(sibling, '')
            FROM (
                SELECT f.*, t.top_idx, nodes[(xor(f.idx, 1) + 1)::BIGINT] AS sibling, len(nodes) AS width
                FROM fold f JOIN tops t USING (named, lang) JOIN (SELECT 0 AS part, named, lang, level, nodes FROM low UNION ALL SELECT 1, named, lang, level, high.nodes FROM high, tops) l
                    ON l.part = f.part AND l.named = f.named AND l.lang = f.lang AND l.level = f.level
            ) WHERE part = 0 OR width > 1
        )
        SELECT doc_id, leaf, subroot, root, sha256(said) AS proof_sha256, digest AS folded_root, digest = root AS verified
        FROM fold JOIN tops USING (named, lang), (SELECT nodes[1] AS root, level AS height FROM high WHERE len(nodes) = 1)
        WHERE part = 1 AND level = height""",
    "op4_chat_formatting": rf"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, length(text) + (length(text) - length(replace(text, chr(92), ''))) + (length(text) - length(replace(text, '<', ''))) + (length(text) - length(replace(text, '|', ''))) AS n,
                   length(role) + (length(role) - length(replace(role, chr(92), ''))) + (length(role) - length(replace(role, '<', ''))) + (length(role) - length(replace(role, '|', ''))) AS rn,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
                   lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS after
            FROM t
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg({_TURN}, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(n + CASE WHEN before = role THEN 3 ELSE 5 + rn END + CASE WHEN after = role THEN 0 ELSE 4 END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op13_spelling_variants": f"""
        WITH RECURSIVE {_CRC.strip()}, runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
        ), h AS (
            SELECT run, k, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL), steps
        ), w AS (
            SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h)
            WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
        ), cut AS (
            SELECT DISTINCT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
        ), near AS (
            SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON w.word = c.rest
            UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON w.word = c.rest
        ), best AS (
            SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS form, max(m) AS form_n FROM near GROUP BY word
        ), f AS (
            SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)
        ), walk AS (
            SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL
        ), last AS (SELECT walk.word, root FROM walk JOIN f ON f.word = root WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)""",
}
