"""Queries of the text operators: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import conversation_digests, format_turns, probe
from .codes import vector_codes
from .decontaminate import contamination
from .exact import exact_duplicates
from .jaccard import jaccard_components
from .language import identify
from .mixing import mix
from .neighbours import nearest_vectors
from .quality import judge_quality
from .secrets import secret_digests
from .sharding import shard_documents
from .urls import judge_urls
from .variants import spelling_variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_table(spark, sf_dir, "documents"))


def _op1_sql() -> str:
    """All kinds by their patterns; positions from the lengths of the pieces between the matches."""
    kinds = (
        ("assign", "(" + "|".join(re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""),
        ("access", "AKIA[A-Z0-9]{16,}"),
        ("hex", "[0-9a-f]{24,}"),
        ("github", "gh[oprsu]_[A-Za-z0-9]{36}"),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
        ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
        ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    )
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS place, '{kind}' AS kind, regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}') AS hits, regexp_split_to_array(text, '{pattern.replace(chr(39), chr(39) * 2)}') AS pieces FROM d"
        for k, (kind, pattern) in enumerate(kinds)
    )
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({found}),
u AS (SELECT doc_id, place, kind, hits, list_transform(pieces, lambda x: length(x)) AS gaps, list_transform(hits, lambda x: length(x)) AS sizes, unnest(range(1, len(hits) + 1)) AS i FROM f WHERE len(hits) > 0),
k AS (
  SELECT doc_id, place, kind, hits[i] AS hit, (coalesce(list_sum(gaps[1:i]), 0) + coalesce(list_sum(sizes[1:i - 1]), 0))::BIGINT AS start FROM u
), o AS (
  SELECT doc_id, place, kind, start, kind || ':' || start || ':' || (start + length(hit)) AS span FROM k
  WHERE CASE kind WHEN 'assign' THEN length(regexp_replace(hit, '^[^:=]*[:=]\x20*["'']?', '')) >= 6 WHEN 'access' THEN length(hit) >= 20 WHEN 'hex' THEN length(hit) >= 24 ELSE true END
), a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY start, place) AS spans FROM o GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM t
), s AS (
  SELECT kind, id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END AS sh FROM w
), d AS (SELECT id AS doc_id, sh FROM s WHERE kind = 'd'), i AS (SELECT id AS item_id, sh FROM s WHERE kind = 'i' AND len(sh) > 0),
near AS (
  SELECT DISTINCT a.doc_id, b.item_id FROM (SELECT doc_id, unnest(sh) AS h FROM d) a JOIN (SELECT item_id, unnest(sh) AS h FROM i) b ON a.h = b.h
), win AS (
  SELECT doc_id, item_id, len(i.sh) AS size, unnest(range(1, greatest(len(d.sh) - len(i.sh) + 1, 1) + 1)) AS start, d.sh AS sh FROM near JOIN d USING (doc_id) JOIN i USING (item_id)
), cut AS (SELECT doc_id, item_id, start, size, sh[start:start + size - 1] AS sh FROM win),
c AS (SELECT doc_id, item_id, start, h, count(*) AS n FROM (SELECT doc_id, item_id, start, unnest(sh) AS h FROM cut) GROUP BY ALL),
ic AS (SELECT item_id, h, count(*) AS n FROM (SELECT item_id, unnest(sh) AS h FROM i) GROUP BY ALL),
inter AS (SELECT doc_id, item_id, start, sum(least(c.n, ic.n)) AS both_ FROM c JOIN ic USING (item_id, h) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, max(both_ / (len(sh) + size - both_)) AS similarity FROM inter JOIN cut USING (doc_id, item_id, start) WHERE 100 * both_ >= 80 * (len(sh) + size - both_) GROUP BY ALL),
per AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, round(max(similarity), 6) AS similarity FROM sim GROUP BY 1)
SELECT d.doc_id, per.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, similarity
FROM documents d LEFT JOIN per USING (doc_id)
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(format_turns(turns.unionByName(probe(turns))))


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM sym UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON sym.a = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1) r ON r.doc_id = d.doc_id
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1:' || doc_id::VARCHAR) AS turn FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source
), q AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    sum(source_size) OVER (ORDER BY source_size / weight RANGE UNBOUNDED PRECEDING) AS below,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY source_size / weight RANGE UNBOUNDED PRECEDING) AS above FROM p
), f AS (SELECT *, below * 2 + source_size * 2 / weight * above <= budget AS is_full FROM q),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN (source_size * 2)::DOUBLE
    ELSE least((budget - 2 * coalesce(sum(source_size) FILTER (is_full) OVER (), 0))::DOUBLE * weight / sum(weight) FILTER (NOT is_full) OVER (), source_size * 2) END AS target FROM f
), r AS (
  SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (SELECT floor(sum(target) + 1e-6)::BIGINT AS budget FROM t),
s AS (SELECT *, greatest(floor(target / 1000), 1)::BIGINT AS most, unnest([0, 1]) AS pass FROM r WHERE size > 0 AND target > 0),
k AS (SELECT *, before + source_size * pass AS begin_, unnest(range(0, (size - 1) // most + 1)) AS k FROM s),
w AS (SELECT *, least(most, size - k * most)::BIGINT AS words FROM k),
u AS (SELECT doc_id, source, turn, size, before, pass, k, words, (begin_ + k * most + words) / target AS time FROM w),
m AS (SELECT *, coalesce(sum(words) OVER (ORDER BY time, source NULLS FIRST, turn, size, before, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS mix_start FROM u),
g AS (
  SELECT doc_id, sum(least(words, budget - mix_start))::BIGINT AS taken, max(time) FILTER (pass = 0) AS finish, min(mix_start) FILTER (pass = 0) AS mix_start
  FROM m, b WHERE budget - mix_start > 0 GROUP BY doc_id
)
SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(g.taken, 0)::BIGINT AS taken, g.finish, g.mix_start FROM r LEFT JOIN g ON g.doc_id = r.doc_id
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


#: Hashes by a table of 256 remainders, bytes from code points, pairs by what is left of a word without one of its points.
OP11_SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), c AS (SELECT doc_id, run, count(*) AS n, string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '') AS points FROM r GROUP BY doc_id, run),
b AS (SELECT run, n, flatten(list_transform(points, lambda p: CASE WHEN unicode(p) < 128 THEN [unicode(p)::BIGINT] ELSE [195::BIGINT, unicode(p)::BIGINT - 64] END)) AS bytes FROM c),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM b, tab),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
g AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word != b.word
  UNION SELECT g.word, v.word FROM g JOIN v ON v.word = g.rest UNION SELECT v.word, g.word FROM g JOIN v ON v.word = g.rest
), best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, struct_pack(less := -v.n, word := other)) AS form, max(v.n) AS form_n FROM near JOIN v ON v.word = near.other GROUP BY near.word
), told AS MATERIALIZED (
  SELECT v.word, CASE WHEN form_n >= 2 * v.n THEN form END AS form, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)
), chain AS (SELECT word, word AS at FROM v UNION ALL SELECT chain.word, told.form FROM chain JOIN told ON told.word = chain.at WHERE told.form IS NOT NULL),
root AS (SELECT chain.word, chain.at AS root FROM chain JOIN told ON told.word = chain.at WHERE told.form IS NULL)
SELECT told.word, told.form, root.root, told.n, told.n_near, told.form_n FROM told JOIN root USING (word)
"""


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(_table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = 6) -> str:
    """Every round compares all parts with all entries."""
    near = "SELECT vec_id, j, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (SELECT p.vec_id, p.j, b.e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{k} b ON b.j = p.j) GROUP BY vec_id, j"
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        steps.append(
            f"m{k} AS (SELECT j, e, list(v ORDER BY i) AS x FROM (SELECT j, e, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS v FROM (SELECT a.j, a.e, unnest(p.x) AS v, unnest(range(1, len(p.x) + 1)) AS i FROM a{k} a JOIN p ON p.vec_id = a.vec_id AND p.j = a.j) GROUP BY j, e, i) GROUP BY j, e)"
        )
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.j, b.e, list_transform(coalesce(m.x, b.x), lambda v: v::BIGINT) AS x FROM b{k} b LEFT JOIN m{k} m ON m.j = b.j AND m.e = b.e)")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 4096)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(embedding) > 0
), p AS MATERIALIZED (SELECT vec_id, j, x[j * len(x) // 8 + 1:(j + 1) * len(x) // 8] AS x FROM (SELECT *, unnest(range(0, 8)) AS j FROM v)),
b0 AS MATERIALIZED (SELECT p.j, r.e, p.x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v) r ON r.vec_id = p.vec_id WHERE r.e < 16),
{", ".join(steps)},
f AS ({near.format(k=rounds)}),
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY j) AS code, sum(d)::BIGINT AS error FROM f GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM b{rounds})
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY v.label))::BIGINT AS label_error, s.codebooks_sha256 FROM c JOIN v ON v.vec_id = c.vec_id, s
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_quality": op2_quality,
        "op3_url_filter": op3_url_filter,
        "op4_language_id": op4_language_id,
        "op5_decontamination": op5_decontamination,
        "op6_sharding": op6_sharding,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_chat_format": op8_chat_format,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_mixing": op10_mixing,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_nearest": op12_nearest,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secrets": _op1_sql(),
        "op5_decontamination": OP5_SQL,
        "op7_exact_dedup": OP7_SQL,
        "op8_chat_format": OP8_SQL,
        "op9_jaccard_join": OP9_SQL,
        "op10_mixing": OP10_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op13_vector_codes": _op13_sql(),
    }
