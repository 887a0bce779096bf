"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, language_id, merkle, mixing, near_dedup, packing, periodic_runs, quality, substring_dedup, tokens, toxicity
from .split import held_out


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In training order: a document's words are taken at its positions."""
    rows = mixing.schedule(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_position", F.get("positions", F.lit(1)).alias("second_position"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    read = chat.read_chats(chat.format_chats(turns.unionByName(planted)))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    rows = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), size=4).select("doc_id", "n_shingles", "component_id", "kept")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document, by checksum, is found again with its capitals in lower case."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    rows = merkle.leaves(_read(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": tampered})
    proved = merkle.prove(merkle.manifest(rows)).withColumn("folded_root", merkle.folded(F.col("observed"), F.col("steps")))
    return proved.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.decode(bpe.encode(_read(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """One in ten texts, by checksum of the doc_id, repeats with a period from some word on."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    rows = docs.select("doc_id", "text", checksum.alias("h"), F.when(checksum % 10 == 0, words).alias("words"))
    n, g = F.size("words").cast("long"), F.expr("h div 10")
    a = g % n
    rows = rows.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, 1 + F.expr("(size(words) - h div 10 % size(words)) div (3 + h div 10 % 8)")))
    planted = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)])), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.periodic_runs(with_planted_period(_read(spark, sf_dir, "documents")))
    # quotients of whole numbers below 2**26 are equal or apart also as doubles
    ranked = F.transform("runs", lambda r: F.struct((-r.length / r.period).alias("exponent"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    best = rows.withColumn("best", F.array_min(ranked)).withColumn("listed", listed)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_mixing, op2_chat, op3_tokens, op4_quality, op5_exact_dedup, op6_language, op7_toxicity, op8_packing, op9_substring_dedup, op10_near_dedup, op11_merkle, op12_bpe, op13_periodic_runs)}

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"
_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
_RULES = " AND ".join(f"({r.measure}) BETWEEN {r.low} AND {r.high}" for r in quality.RULES)

#: crc32 of a doc_id's decimal digits, bit by bit from the lowest of each byte.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length(CAST(doc_id AS VARCHAR))),
  lambda k: CAST((ascii(substring(CAST(doc_id AS VARCHAR), CAST(k // 8 + 1 AS INTEGER), 1)) >> CAST(k % 8 AS INTEGER)) & 1 AS BIGINT))),
  lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT)"""


def _merkle_levels(name: str, levels: int) -> str:
    """SQL of a tree's levels: from nodes ``name``0 (tree, i, h, m) and ways ``name``_w0 (tree, i, proof, fold) to ``name``_w{levels}."""
    out = []
    for k in range(levels):
        left, right = (f"coalesce(array_to_string(hs[{x}], ''), '')" for x in (f"1:w.i // {16**k} % 16", f"w.i // {16**k} % 16 + 2:"))
        out += [
            f"{name}_g{k} AS (SELECT tree, i // 16 AS i, list(h ORDER BY i) AS hs, any_value(m) AS m FROM {name}{k} WHERE m > 1 GROUP BY tree, i // 16)",
            f"{name}{k + 1} AS (SELECT tree, i, sha256(array_to_string(hs, '')) AS h, (m + 15) // 16 AS m FROM {name}_g{k})",
            f"{name}_w{k + 1} AS (SELECT w.* REPLACE (proof || {left} || {right} AS proof, CASE WHEN g.i IS NULL THEN fold ELSE sha256({left} || fold || {right}) END AS fold) "
            f"FROM {name}_w{k} AS w LEFT JOIN {name}_g{k} AS g ON g.tree = w.tree AND g.i = w.i // {16 ** (k + 1)})",
        ]
    out.append(f"{name}_top AS ({' UNION ALL '.join(f'SELECT tree, h FROM {name}{k} WHERE m = 1' for k in range(levels + 1))})")
    return ",\n".join(out)


_FIELDS = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"

ORACLE_SQL = {
    "op1_mixing": rf"""
WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () * 150 AS demand FROM p),
f AS (SELECT *, coalesce(sum(source_size) OVER fill, 0) * 200 AS full_, sum(weight) OVER () - coalesce(sum(weight) OVER fill, 0) AS open_ FROM w
      WINDOW fill AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, (demand - full_) * weight > source_size * 200 * open_ AS over_ FROM f),
l AS (SELECT demand - full_ AS left_, open_ FROM o WHERE NOT over_ ORDER BY full_, open_ DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN over_ OR (SELECT count(*) FROM l) = 0 THEN CAST(source_size * 2 AS DOUBLE)
      ELSE CAST((SELECT left_ FROM l) AS DOUBLE) * CAST(weight AS DOUBLE) / CAST((SELECT open_ FROM l) AS DOUBLE) / 100.0 END AS target, place FROM o),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, [-0.5, 0, 0.5][t.place % 3 + 1]::DOUBLE AS tilt,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size > 0 THEN list_filter([before_, before_ + source_size], lambda x: x < target) ELSE [] END AS starts FROM b),
e AS (SELECT *, list_transform(starts, lambda x: CASE WHEN tilt = 0 THEN x / target
      ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * x / target) - (1 - tilt)) / (2 * tilt) END) AS positions FROM c)
SELECT doc_id, size, source_size, target, CAST(size * len(starts) AS BIGINT) AS taken, positions[1] AS first_position, positions[2] AS second_position FROM e""",
    "op2_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS body, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS head,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS merged FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN merged THEN 8 ELSE 12 + head + 1 + 11 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op4_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(3) AS x(k) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words FROM d LEFT JOIN n USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_RULES} AS kept FROM m""",
    "op5_exact_dedup": rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS h FROM documents),
k AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k""",
    "op11_merkle": f"""
WITH d AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {_FIELDS} AS fields, text,
  CASE WHEN {_CRC32} % 5 = 0 THEN translate(text, '{ascii_uppercase}', '{ascii_lowercase}') ELSE text END AS found FROM documents),
l AS (SELECT doc_id, tree, sha256(fields || {_TEXT.format("text")}) AS leaf, sha256(fields || {_TEXT.format("found")}) AS observed FROM d),
t AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, observed) - 1 AS i, count(*) OVER (PARTITION BY tree) AS m FROM l),
n0 AS (SELECT tree, i, leaf AS h, m FROM t),
n_w0 AS (SELECT *, '' AS proof, observed AS fold FROM t),
{_merkle_levels("n", 8)},
u0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h, count(*) OVER () AS m FROM n_top),
u_w0 AS (SELECT w.* REPLACE ('' AS tree), p.place AS i, s.h AS subroot FROM (SELECT * EXCLUDE (i) FROM n_w8) AS w JOIN (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS place FROM n_top) AS p ON p.tree = w.tree JOIN n_top AS s ON s.tree = w.tree),
{_merkle_levels("u", 6)}
SELECT doc_id, leaf, subroot, u_top.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u_top.h AS verified FROM u_w6, u_top""",
    "op13_periodic_runs": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws, {_CRC32} AS h FROM documents),
a AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN h // 10 % len(ws) END AS a, h // 10 AS g, row_number() OVER () AS r FROM d),
w AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS ws FROM a),
g AS (SELECT r, n, i, hash(ws[i + 1:i + 16]) AS g FROM (SELECT *, unnest(range(0, n - 15)) AS i FROM w)),
p AS (SELECT x.r, y.i - x.i AS p, x.i FROM g AS x JOIN g AS y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT r, p, min(i) AS start, count(*) + 15 + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM p) GROUP BY r, p, island),
q AS (SELECT r, start, length, min(p) AS period FROM s WHERE length >= greatest(24, 3 * p) GROUP BY r, start, length),
m AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
  arg_min({{'s': start, 'l': length, 'p': period}}, {{'e': -(length / period), 's': start, 'p': period}}) AS best FROM q GROUP BY r),
c AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM q),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(ws) AS word, unnest(range(0, n)) AS i FROM w) ANTI JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM w LEFT JOIN m USING (r) LEFT JOIN k USING (r)""",
}
