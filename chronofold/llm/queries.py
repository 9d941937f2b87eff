"""The queries opN_<name> over whole tables, each a thin use of its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import bpe, chat, decontaminate, filter_audit, language, line_dedup, mixing, near_dup, phrases, pii, simhash, suffixes, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(_docs(spark, sf_dir), bound=3, min_equal=1)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    formatted = chat.format_chats(chat.pack(rows.unionByName(more)))
    return formatted.withColumn("d", chat.digests()).select("conv_id", "d.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_docs(spark, sf_dir), weights=(5, 2, 1), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare(_docs(spark, sf_dir))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(_docs(spark, sf_dir), width=200))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_docs(spark, sf_dir)))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_docs(spark, sf_dir), words=3, percent=85)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_docs(spark, sf_dir))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) as lines:
        vocabulary = bpe.Vocabulary.read(lines.read())
    return bpe.digests(_docs(spark, sf_dir), vocabulary)


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_docs(spark, sf_dir), least=100, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_lines, op3_chat, op4_mixing, op5_simhash, op6_suffixes, op7_pii, op8_minhash, op9_decontaminate, op10_language, op11_bpe, op12_filters, op13_collocations]
    return {f.__name__: f for f in found}


_CONTROL = r"<\|turn\|>|<\|says\|>|<\|end\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|</s>|<s>"
_WIDTH = "length({0}) + length({0}) - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, '" + _CONTROL + "'))"

_CHAT = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + {_WIDTH.format("role")} + {_WIDTH.format("text")}) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id"""

_NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], chr(1))) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b WHERE 100 * c >= 85 * (m.n + n.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id, min(b) = a AS kept
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.a GROUP BY a"""


_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 199, 0))) AS p FROM d)),
dup AS (SELECT doc_id, p FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
runs AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g
  FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM dup)),
spans AS (SELECT doc_id, g, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY 1, 2),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), n FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id, n)
SELECT doc_id, n AS n_bytes, n - CAST(sum(y - x) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans, sha256(unhex(string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x))) AS kept_sha256
FROM d JOIN pieces USING (doc_id) GROUP BY doc_id, n"""


_FILTERS = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(doc_id > least, false) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN flags USING (doc_id)),
c AS (SELECT part, mask, good, bad, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.f || q.f || r.f || s.f || u.f AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits FROM f p, f q, f r, f s, f u
  WHERE p.f NOT IN (q.f, r.f, s.f, u.f) AND q.f NOT IN (r.f, s.f, u.f) AND r.f NOT IN (s.f, u.f) AND s.f <> u.f),
steps AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS b, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INTEGER) AS past FROM o, range(1, 6) x(i)),
found AS (SELECT part, filter_order, step, b,
    coalesce(sum(n) FILTER (mask & (b | past) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & b <> 0 AND mask & past = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & b <> 0 AND mask & past <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails,
    coalesce(sum(n) FILTER (mask & b <> 0 AND mask & past = 0 AND good), 0) AS good_lost, coalesce(sum(n) FILTER (mask & b <> 0 AND mask & past = 0 AND bad), 0) AS toxic_lost
  FROM c, steps GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM found"""


_PHRASES = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) x(k)) GROUP BY ALL HAVING count(*) >= 100),
own AS (SELECT lang, phrase, k, f AS a FROM g WHERE k > 1 AND NOT EXISTS (
  FROM g AS y WHERE y.lang = g.lang AND y.k > g.k AND y.f >= g.f AND contains(' ' || y.phrase || ' ', ' ' || g.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS k FROM own),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:c.k], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(w[c.k + 1:], ' ')
  JOIN totals ON totals.lang = c.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM worst QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express on whole tables; tests hold the others against brute force."""
    return {"op3_chat": _CHAT, "op6_suffixes": _REPEATS, "op8_minhash": _NEAR, "op12_filters": _FILTERS, "op13_collocations": _PHRASES}
