"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtally.llm.common import lower_ascii, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundtally.llm.exact_dedup import exact_dedup

    found = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundtally.llm import quality_rules as q

    entries = q.ledger(table(spark, sf_dir, "documents"))
    return entries.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          (~q.passes(q.POLICIES["v1"])).alias("base_failed"), q.passes(q.CURRENT).alias("kept"), "failures")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundtally.llm.token_store import store_round_trip

    return store_round_trip(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundtally.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundtally.llm.page_diff import extract_main_text

    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from groundtally.llm.bpe_transducer import code_digests

    found = code_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundtally.llm.chat_rotation import rotate

    return rotate(table(spark, sf_dir, "conversations"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundtally.llm.packing import cut_pieces, pack_pieces

    return pack_pieces(cut_pieces(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op9_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundtally.llm.credential_links import scan_secrets, span_digests

    return span_digests(scan_secrets(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundtally.llm.cotraining import measure, train_measured

    rows = measure(table(spark, sf_dir, "documents"))  # read by the fits and by the scores
    return train_measured(rows, table(spark, sf_dir, "labels")).score_measured(rows).withColumnRenamed("id", "doc_id")


def plant_period(doc_id: int | None, words: list[str]) -> list[str]:
    """The contract's planted runs: in a tenth of all documents the rest of the text repeats a stretch of it. None without an id."""
    import zlib

    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_digests(found: DataFrame) -> DataFrame:
    """The strongest run (by exact length / period, then start, then period) and digests of all runs and of the collapsed text."""
    stronger = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.aggregate(F.col("runs"), F.get("runs", F.lit(0)), stronger)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return found.withColumn("best", best).select(
        "id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundtally.llm.periodic_runs import periodic_runs

    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), rewrite=plant_period)).withColumnRenamed("id", "doc_id")


def id_digests(found: DataFrame) -> DataFrame:
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return found.select("id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
                        sha(F.col("decoded")).alias("decoded_sha256"))


def op12_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundtally.llm.chunk_reuse import encode_texts
    from groundtally.llm.tokens import vocabulary_path

    path = vocabulary_path("word_bpe_49k.json")
    return id_digests(encode_texts(table(spark, sf_dir, "documents"), path, decode=True)).withColumnRenamed("id", "doc_id")


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf of a row whose text's A-Z were lower-cased; null where 5 doesn't divide the id's checksum, or there is no id."""
    from groundtally.llm.merkle_manifest import leaf_digest

    changed = leaf_digest(docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], lower_ascii(docs["text"]))
    return F.when(F.crc32(F.encode(docs["doc_id"].cast("string"), "UTF-8")) % 5 == 0, changed)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundtally.llm.merkle_manifest import build_manifest, proofs

    docs = table(spark, sf_dir, "documents")
    made = build_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], claimed=tampered_leaf(docs))
    return proofs(made).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_quality_rules, op3_token_store, op4_ngram_jaccard_join, op5_page_diff,
                                     op6_bpe_transducer, op7_chat_rotation, op8_best_fit_packing, op9_credential_links, op10_cotraining, op11_periodic_runs, op12_chunk_reuse, op13_merkle_manifest)}

SMALLS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, sha256({SMALLS}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)""",
    "op2_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{BLANKS}') AS ws FROM documents),
        pos AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i,
                  unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM d WHERE len(ws) > 2),
        win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS met FROM pos),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE met > 1) GROUP BY doc_id),
        ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
        dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '{BLANKS}') GROUP BY doc_id),
        m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
                length(text) - length(replace(text, '!', '')) AS n_exclaims, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, length(text) AS n_chars
              FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
        f AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 3 * n_words OR word_chars > 15 * n_words THEN 8 ELSE 0 END
                + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END + CASE WHEN 100 * n_exclaims > 20 * n_words THEN 32 ELSE 0 END
                + CASE WHEN 100 * n_capitals > 30 * n_chars THEN 64 ELSE 0 END AS INT) AS failures FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) > 0 AS base_failed, failures = 0 AS kept, failures FROM f""",
    "op7_chat_rotation": r"""
        WITH t AS (SELECT conv_id, turn, CASE WHEN regexp_replace(coalesce(role, ''), '\s+', ' ', 'g') = '' THEN 'unknown'
                     ELSE regexp_replace(replace(coalesce(role, ''), '<|im_', '<| im_'), '\s+', ' ', 'g') END AS role,
                     replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations),
        s AS (SELECT DISTINCT conv_id AS of, role AS speaker FROM t WHERE role <> 'system'),
        p AS (SELECT conv_id, speaker, turn >> 6 AS part, turn, role, text, role = speaker AS own, '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant'
                WHEN role = 'system' THEN role ELSE 'user name=' || role END || chr(10) || text || '<|im_end|>' || chr(10) AS piece
              FROM t JOIN s ON conv_id IS NOT DISTINCT FROM of),
        q AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM p),
        r AS (SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(piece, '' ORDER BY turn, role, text) AS rendered, CAST(sum(length(piece)) AS BIGINT) AS n_chars,
                coalesce(string_agg(CASE WHEN own THEN (upto - length(piece) + 22) || ':' || (upto - 1) END, ',' ORDER BY turn, role, text), '') AS targets
              FROM q GROUP BY ALL)
        SELECT *, CAST(coalesce(sum(n_chars) OVER (PARTITION BY conv_id, speaker ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM r""",
}


def _merkle_sql() -> str:
    """Trees level by level (8 inside a source, 5 over sources); a group with one node left is passed on unchanged."""
    field = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || {v} END"
    leaf = lambda text: "sha256(" + " || ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
               lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
               lambda a, _: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))))"""
    parts = [f"""leaf AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf('text')} AS leaf,
                   CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(small)} ELSE {leaf('text')} END AS claimed FROM documents)""",
             "p0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, claimed AS node, '' AS proof FROM leaf)",
             "n0 AS MATERIALIZED (SELECT grp, i, leaf AS d, count(*) OVER (PARTITION BY grp) AS cnt FROM p0)"]

    def climb(k: int) -> None:
        """Runs ``r`` of level k, the nodes of the next level, and every row's way one level up."""
        parts.append(f"r{k} AS MATERIALIZED (SELECT grp, i // 16 AS run, list(d ORDER BY i) AS ds, max(cnt) AS cnt FROM n{k} GROUP BY ALL)")
        parts.append(f"""n{k + 1} AS MATERIALIZED (SELECT grp, run AS i, CASE WHEN cnt = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d,
                           count(*) OVER (PARTITION BY grp) AS cnt FROM r{k})""")
        before, after = "array_to_string(ds[1:i % 16], '')", "array_to_string(ds[i % 16 + 2:], '')"
        parts.append(f"""p{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (i // 16 AS i, CASE WHEN cnt = 1 THEN node ELSE sha256({before} || node || {after}) END AS node,
                           proof || {before} || {after} AS proof) FROM p{k} p JOIN r{k} r ON p.grp = r.grp AND p.i // 16 = r.run)""")

    for k in range(8):
        climb(k)
    parts.append("roots AS MATERIALIZED (SELECT grp AS member, d AS subroot, row_number() OVER (ORDER BY grp) - 1 AS g FROM n8)")
    parts.append("n9 AS MATERIALIZED (SELECT '' AS grp, g AS i, subroot AS d, count(*) OVER () AS cnt FROM roots)")
    parts.append("p9 AS MATERIALIZED (SELECT p.* REPLACE ('' AS grp, g AS i), subroot FROM p8 p JOIN roots ON grp = member)")
    for k in range(9, 14):
        climb(k)
    return f"""WITH {", ".join(parts)} SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = d AS verified
               FROM p14 JOIN n14 USING (grp, i)"""


ORACLES["op13_merkle_manifest"] = _merkle_sql()
