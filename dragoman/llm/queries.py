"""Registered queries of this folder, each next to the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dragoman.llm import jaccard, language, lines, merkle, mixing, neighbours, packing, quality, runs, secrets, substring_dedup, token_counts, warc
from dragoman.llm.common import let, read, words
from dragoman.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPLIT = r"[\x20\x09-\x0D]+"


def query(key: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


MEASURES_SQL = f"""
measured AS (
  SELECT d.doc_id, d.n_words, d.word_chars, d.n_symbols, len(d.ls) AS n_lines,
         len(d.ls) - len(list_distinct(d.ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM (
    SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
    FROM worded
  ) d LEFT JOIN (
    SELECT doc_id, count(DISTINCT p) AS n FROM (
      SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (
          SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM worded)
        )
      ) WHERE times > 1
    ) GROUP BY doc_id
  ) r USING (doc_id)
),
judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (2 * n_symbols > n_words)::BIGINT
      + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT AS fail_bits
  FROM measured
)"""


def worded(table: str = "documents") -> str:
    return f"""worded AS (
  SELECT *, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{SPLIT}'), lambda x: x <> '') AS ws
  FROM {table}
)"""


@query(
    "op3_quality_rules",
    f"""WITH {worded()}, {MEASURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits = 0 AS kept,
       (fail_bits & 3) = 0 AS kept_v1, n_lines, fail_bits FROM judged""",
)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(read(spark, sf_dir, "documents"))
    book = quality.apply_policy(book, quality.POLICIES[1], "kept_v1")
    book = quality.apply_policy(book, quality.POLICIES[quality.CURRENT])
    return book.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "NOT kept_v1 AS base_failed",
        "kept", "kept_v1", "n_lines", "fail_bits",
    )


def mix_sql(table: str = "documents") -> str:
    return f"""{worded(table)},
sized AS (
  SELECT *, len(ws)::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM worded
),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM sized GROUP BY source
),
ordered AS (
  SELECT *, 3 * source_size AS lim, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
    coalesce(sum(3 * source_size) OVER b, 0)::BIGINT AS lim_before, coalesce(sum(weight) OVER b, 0)::BIGINT AS weight_before
  FROM per WINDOW b AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
limits AS (SELECT *, lim::DOUBLE * (weights - weight_before) <= (total - lim_before)::DOUBLE * weight AS limited FROM ordered),
shares AS (
  SELECT *, coalesce(sum(lim) FILTER (limited) OVER (), 0)::BIGINT AS used, coalesce(sum(weight) FILTER (limited) OVER (), 0)::BIGINT AS gone
  FROM limits
),
goals AS (
  SELECT source, source_size,
    CASE WHEN limited THEN lim::DOUBLE ELSE (total - used)::DOUBLE * weight / (weights - gone) END AS target FROM shares
),
repeated AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM goals),
placed AS (
  SELECT s.*, r.source_size, r.target, r.repeats, r.target - r.repeats * r.source_size AS budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h)::BIGINT AS upto,
    sum(s.size) OVER (PARTITION BY s.source, s.h)::BIGINT AS tied
  FROM sized s JOIN repeated r ON s.source IS NOT DISTINCT FROM r.source
),
mixed AS (
  SELECT *, repeats + (upto <= budget OR (upto - tied <= budget AND 2 * (budget - (upto - tied)) >= tied))::BIGINT AS uses FROM placed
)"""


@query("op5_source_mix", f"WITH {mix_sql()} SELECT doc_id, size, source_size, target, size * uses AS taken, source FROM mixed")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def _secrets_sql() -> str:
    parts = []
    for order, (kind, pattern, group, least) in enumerate(secrets.KINDS):
        p = pattern.replace("'", "''")
        extra = " AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')" if kind == "opaque" else ""
        parts.append(f"""
SELECT doc_id, source, {order} AS kind_order, '{kind}' AS kind, start, start + length(whole) AS stop, value FROM (
  SELECT doc_id, source, whole, value,
    (sum(length(gap)) OVER w + sum(length(whole)) OVER w - length(whole))::BIGINT AS start
  FROM (
    SELECT doc_id, source, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS whole, unnest(v) AS value, unnest(g[1:len(m)]) AS gap FROM (
      SELECT doc_id, source, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS v,
        regexp_split_to_array(text, '{p}') AS g
      FROM documents WHERE regexp_matches(text, '{p}')
    )
  ) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)
) WHERE length(value) >= {least}{extra}""")
    found = "\nUNION ALL".join(parts)
    return f"""WITH found AS ({found}),
held AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM found GROUP BY value),
kept AS (
  SELECT f.*, h.owners >= {secrets.COPIED_OWNERS} AS copied, kind || ':' || start || ':' || stop AS span
  FROM found f JOIN held h USING (value) WHERE kind <> 'opaque' OR h.owners < {secrets.COPIED_OWNERS}
),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, kind_order) FILTER (kind_order < 3) AS base,
    string_agg(span, ',' ORDER BY start, kind_order) AS spans, count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM documents d LEFT JOIN per USING (doc_id)"""


@query("op4_secret_scan", _secrets_sql())
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents")).drop("holders")


@query("op1_substring_dedup")
def remove_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept_text")


@query("op8_packing")
def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query("op2_language_id")
def identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


@query("op10_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(read(spark, sf_dir, "documents"))


LINES_SQL = """
tokens AS (
  SELECT doc_id, line, list_distinct(list_filter(regexp_split_to_array(content, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS s
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content,
          unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents)
  WHERE regexp_matches(content, '[^\\x20\\x09-\\x0D]')
),
classes AS (SELECT list_sort(s) AS s, min((doc_id, line)) AS pos FROM tokens GROUP BY list_sort(s)),
numbered AS (SELECT *, row_number() OVER (ORDER BY pos) AS c, len(s) AS n FROM classes),
words AS (SELECT c, pos, n, unnest(s) AS w FROM numbered),
shared AS (
  SELECT x.c AS later, y.c AS earlier, x.n AS n, y.n AS m, count(*) AS common FROM words x JOIN words y ON x.w = y.w AND y.c < x.c
  AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) GROUP BY ALL
),
matched AS (SELECT DISTINCT later FROM shared WHERE 9 * common >= 4 * (n + m)),
gone AS (
  SELECT t.doc_id, t.line FROM tokens t JOIN numbered k ON list_sort(t.s) = k.s LEFT JOIN matched m ON m.later = k.c
  WHERE m.later IS NOT NULL OR (t.doc_id, t.line) <> k.pos
)"""


@query(
    "op7_line_dedup",
    f"""WITH {LINES_SQL}
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, []::INT[]) AS removed
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM tokens GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_removed, list(line::INT ORDER BY line) AS removed FROM gone GROUP BY doc_id) USING (doc_id)""",
)
def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read(spark, sf_dir, "documents"))


@query("op6_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


@query("op9_warc_derivatives")
def warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(read(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


@query("op13_token_counts")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def crc32_sql(value: str) -> str:
    """Unsigned CRC-32 of ASCII text, bit by bit."""
    step = "lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1))"
    signs = f"list_transform(string_split({value}, ''), lambda c: ascii(c)::BIGINT)"
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], {signs}),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), {step})), 4294967295::BIGINT)"""


def row_hash_sql(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return f"""sha256({" || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)})"""


def runs_sql(nodes: str) -> str:
    """What stands before and after each node of a level."""
    return f"""SELECT c.tree, c.level, c.place, c.n, c.digest, coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < c.place), '') AS before,
    coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > c.place), '') AS after
  FROM {nodes} c JOIN {nodes} s ON s.tree = c.tree AND s.level = c.level AND s.place // 16 = c.place // 16 GROUP BY ALL"""


def climb_sql(leaves: str, name: str) -> str:
    return f"""{name}(tree, level, place, digest, n) AS (
  SELECT tree, 0::BIGINT, place, digest, n FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 15) // 16 FROM {name}
  WHERE n > 1 GROUP BY tree, level, place // 16
)"""


@query(
    "op12_merkle_manifest",
    f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, digest, CASE WHEN hit THEN changed ELSE digest END AS found,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
  FROM (
    SELECT *, {row_hash_sql("text")} AS digest,
      {row_hash_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed,
      coalesce({crc32_sql("doc_id::VARCHAR")} % 5 = 0, false) AS hit
    FROM documents
  )
),
{climb_sql("leaves", "low")},
tops AS (
  SELECT '' AS tree, tree AS id, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1
),
{climb_sql("tops", "high")},
low_runs AS ({runs_sql("low")}),
high_runs AS ({runs_sql("high")}),
steps AS (
  SELECT l.tree, l.place AS leaf_place, r.level, r.before, r.after FROM leaves l JOIN low_runs r
  ON r.tree = l.tree AND r.n > 1 AND r.place = l.place // (16 ** r.level)::BIGINT
  UNION ALL
  SELECT l.tree, l.place, 1000 + r.level, r.before, r.after FROM leaves l JOIN tops t ON t.id = l.tree JOIN high_runs r
  ON r.n > 1 AND r.place = t.place // (16 ** r.level)::BIGINT
),
paths AS (
  SELECT tree, leaf_place, string_agg(before || after, '' ORDER BY level) AS siblings,
    list({{'b': before, 'd': '', 'a': after}} ORDER BY level) AS path
  FROM steps GROUP BY tree, leaf_place
),
folded AS (
  SELECT l.doc_id, l.digest AS leaf, t.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
    list_reduce(list_concat([{{'b': '', 'd': l.found, 'a': ''}}], coalesce(p.path, [])),
      lambda x, s: {{'b': '', 'd': sha256(s.b || x.d || s.a), 'a': ''}}).d AS folded_root
  FROM leaves l JOIN tops t ON t.id = l.tree LEFT JOIN paths p ON p.tree = l.tree AND p.leaf_place = l.place
)
SELECT *, folded_root = root AS verified FROM folded""",
)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle.manifest(read(spark, sf_dir, "documents"), audited={"text": lower}, where=fifth)
    digests = [merkle.as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")]
    proof = F.sha2(merkle.as_text(merkle.proof(F.col("path"))).cast("binary"), 256)
    return out.select("doc_id", *digests, proof.alias("proof_sha256"), (F.col("folded_root") == F.col("root")).alias("verified"))


def _periodic(words_of: Column, h: Column) -> Column:
    """Words of a text from place a on said over with period p; both follow from h."""
    g, n = F.floor(h / 10), F.size(words_of)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    shape = F.struct(words_of.alias("w"), a.alias("a"), p.alias("p"))
    said = let(shape, lambda x: F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["w"], x["a"] + (i - x["a"]) % x["p"]))))
    return F.array_join(said, " ")


@query(
    "op11_periodic_runs",
    f"""WITH {worded()},
shaped AS (
  SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS hit, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a, 3 + (h // 10) % 8 AS d
  FROM (SELECT doc_id, ws, {crc32_sql("doc_id::VARCHAR")} AS h FROM worded)
),
said AS (
  SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // d) END]) ELSE ws END AS ws
  FROM shaped
),
grams AS (
  SELECT doc_id, i, array_to_string(ws[i + 1 : i + 6], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(n - 5)) AS i FROM said WHERE n >= 12)
),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i
),
stretches AS (
  SELECT doc_id, min(i) AS start, q, count(*) + 5 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= 12 AND length >= 2 * q GROUP BY doc_id, start, length
),
per AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'n': length, 'q': period}}, (-length, start, period)) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT t.doc_id, string_agg(t.w, ' ' ORDER BY t.i) AS text
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(n)) AS i FROM said) t ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id
)
SELECT s.doc_id, s.n AS n_words, coalesce(p.n_runs, 0) AS n_runs, p.best.s AS start, p.best.n AS length, p.best.q AS period,
  1000 * p.best.n // p.best.q AS exponent_milli, sha256(coalesce(p.listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM said s LEFT JOIN per p USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
)
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), _periodic(words(F.col("text")), h)).otherwise(F.col("text"))
    found = runs.periodic_runs(docs.select("doc_id", text.alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    found = found.withColumn("best", best).select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.col3")).alias("period"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return found.withColumn("exponent_milli", F.expr("1000 * length div period"))
