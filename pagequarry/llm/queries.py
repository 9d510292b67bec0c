"""One query for each operator, over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontaminate, language, licenses, line_dedup, negatives, pii, quality_rules, rule_ensemble, secrets, simhash
from .common import read


def vocabulary() -> tuple[str, str]:
    """File of ranks and split pattern of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents")).drop("clean_text", "lost_chars")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    ensemble = rule_ensemble.train(docs, labels.where(~held_out))
    return rule_ensemble.classify(docs, ensemble).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), *vocabulary())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id) and pages (page_id) alike, with the profile of the documents' labels."""
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    profile = language.train(docs)
    rows = language.document_rows(docs).withColumn("key", F.concat(F.lit("d"), "key")).unionByName(language.page_rows(pages).withColumn("key", F.concat(F.lit("p"), "key")))
    found = language.fuse(language.evidence(rows, profile), profile)
    of = lambda c: F.when(F.substring("key", 1, 1) == c, F.substring("key", 2, 20).cast("long"))
    return found.select(of("d").alias("doc_id"), of("p").alias("page_id"), "lang", "posterior", "accepted")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.digest(turns.unionByName(own))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_bpe": op4_bpe,
    "op5_pii": op5_pii,
    "op6_language": op6_language,
    "op7_licenses": op7_licenses,
    "op8_secrets": op8_secrets,
    "op9_decontamination": op9_decontamination,
    "op10_chat": op10_chat,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_alignment": op12_alignment,
    "op13_line_dedup": op13_line_dedup,
    "pipeline": pipeline,
}

_W = r"[^\x20\x09-\x0D]+"
_LOW = f"translate({{}}, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"


def _quality_sql() -> str:
    rule, q = quality_rules, lambda s: "'" + s.replace("'", "''") + "'"
    symbols = "length(regexp_replace({}, '[^#*$%&|<>]', '', 'g'))".format
    separators = ", ".join(map(q, rule.SEPARATORS))
    phrases = " OR ".join(f"contains({_LOW.format('l')}, {q(p)})" for p in rule.PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_W}') AS ws FROM d),
win AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY r),
ln AS (SELECT r, i, ls[i] AS l, regexp_extract_all(ls[i], '{_W}') AS own
  FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT r, string_split(t, chr(10)) AS ls FROM d))),
lw AS (SELECT *, row_number() OVER (PARTITION BY r, l ORDER BY i) > 1 AS dup, length(array_to_string(own, '')) AS chars,
  len(list_filter(own, lambda x: x IN ({separators}))) AS seps, len(own) AS n FROM ln WHERE len(own) > 0),
lf AS (SELECT r, dup, chars, dup OR (seps >= 2 AND seps >= {rule.MAX_SEPARATORS}::DOUBLE * n) OR {symbols("l")} > {rule.MAX_SYMBOLS}::DOUBLE * chars
  OR len(regexp_extract_all(l || ' ', '[!?]{{2,}}[\\x20\\x09-\\x0D]')) >= greatest(2, {rule.MAX_SHOUTED}::DOUBLE * n)
  OR (n < 4 AND NOT regexp_matches(l, '\\p{{L}}')) OR {phrases} AS fails FROM lw),
la AS (SELECT r, count(*) FILTER (dup) AS dups, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM lf GROUP BY r),
s AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {symbols("t")} AS n_symbols,
  coalesce(dups, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost FROM w LEFT JOIN cov USING (r) LEFT JOIN la USING (r)),
b AS (SELECT *, n_words < {rule.MIN_WORDS} OR 100 * n_repeat_words > {rule.MAX_REPEAT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost <= {rule.MAX_LOST}::DOUBLE * word_chars AS kept FROM b"""


def _licence_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known, tags, names = (", ".join(f"({q(a)}, {q(b)})" for a, b in x.items()) for x in (licenses.known_sentences(), licenses.tagged_names(), licenses.phrase_names()))
    rest, n = "'|' || ids || '|'", 0
    ctes = [f"r0 AS (SELECT r, doc_id, ids, {rest} AS rest, []::VARCHAR[] AS found FROM j)"]
    for n, (name, run) in enumerate(licenses.rules(), 1):
        run = q(f"|{'|'.join(run)}|")
        ctes.append(f"r{n} AS (SELECT r, doc_id, ids, replace(rest, {run}, '|') AS rest, CASE WHEN contains(rest, {run}) AND NOT list_contains(found, {q(name)}) THEN list_append(found, {q(name)}) ELSE found END AS found FROM r{n - 1})")
    norm = f"regexp_replace(trim(regexp_replace(regexp_replace(x, '[^a-z0-9.]+', ' ', 'g') || ' ', '\\.+ ', ' ', 'g')), {q(licenses.NAMED)}, {q(licenses.SENTENCES['bsd-names'])})"
    low = f"regexp_replace(regexp_replace(lower(replace(coalesce(text, ''), chr(1), ' ')), {q(licenses.COMMENT)}, '\\1', 'g'), {q(licenses.START)}, chr(10) || chr(10) || '\\1', 'g')"
    cut = lambda p: f"list_transform(string_split(regexp_replace(low, '{p}', chr(1), 'g'), chr(1)), lambda x: {norm})"
    wide, narrow = r"[.!?;:]+(?:\s+|\z)|\n\s*\n", r"[.!?;:]+(?:\s+|\z)|\n\s*\n|\n"
    return f"""
WITH known(s, id) AS (VALUES {known}),
tags(s, id) AS (VALUES {tags}),
names(s, id) AS (VALUES {names}),
d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS low FROM documents),
c AS (SELECT r, {cut(wide)} AS a, {cut(narrow)} AS b FROM d),
u AS (SELECT r, 1 AS part, i, a[i] AS s FROM (SELECT r, a, unnest(range(1, len(a) + 1)) AS i FROM c) UNION ALL SELECT r, 2, i, b[i] FROM (SELECT r, b, unnest(range(1, len(b) + 1)) AS i FROM c)),
h AS (SELECT r, part, i, id FROM u JOIN known USING (s)),
e AS (SELECT r, es, unnest(range(1, len(es) + 1)) AS i FROM (SELECT r, regexp_extract_all(low, '{licenses.TAG}', 1) AS es FROM d)),
n AS (SELECT r, i, ns, unnest(range(1, len(ns) + 1)) AS j FROM (SELECT r, i, regexp_extract_all(es[i], '{licenses.TAG_NAME}') AS ns FROM e)),
k AS (SELECT * FROM h WHERE part = 1 OR NOT EXISTS (SELECT 1 FROM h g WHERE g.r = h.r AND g.part = 1 AND g.id = h.id)
  UNION ALL SELECT r, 3, i * 1000000 + j, id FROM (SELECT r, i, j, ns[j] AS s FROM n) JOIN tags USING (s)),
x AS (SELECT r, part, i, v[i] AS x FROM (SELECT r, part, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT r, 4 AS part, regexp_extract_all(low, {q(licenses.FIELD)}, 1) AS v FROM d UNION ALL SELECT r, 5, regexp_extract_all(low, {q(licenses.phrase())}, 1) FROM d))),
y AS (SELECT r, part, i, id FROM x JOIN tags ON s = regexp_replace(x, {q(licenses.FIELD_END)}, '') WHERE part = 4 UNION ALL SELECT r, part, i, id FROM x JOIN names ON s = {norm} WHERE part = 5),
z AS (SELECT * FROM k UNION ALL SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.r = y.r AND k.id = y.id)),
j AS (SELECT d.r, doc_id, coalesce(string_agg(id, '|' ORDER BY part, i), '') AS ids FROM d LEFT JOIN z USING (r) GROUP BY d.r, doc_id),
{", ".join(ctes)}
SELECT doc_id, ids AS sentence_ids, array_to_string(found, '|') AS licenses, len(found) AS n_licenses FROM r{n}"""


def _chat_sql() -> str:
    t = chat.TEMPLATE
    q = lambda s: "'" + s.replace("'", "''") + "'"
    escaped = "{}"
    for a, b in t.escapes:
        escaped = f"replace({escaped}, {q(a)}, {q(b)})"
    fixed = len(t.begin) + len(t.middle) + len(t.end)
    moves = " OR ".join(f"(before = {q(a)} AND role = {q(r)})" for a, r, _ in t.moves)
    return f"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) v(i)),
b AS (SELECT *, coalesce(lag(role) OVER w, 'start') AS before, row_number() OVER w AS k FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS told,
  coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS lost,
  sum({fixed} + length({escaped.format("role")}) + length({escaped.format("text")})) AS formatted_chars,
  bool_and({moves}) AND last(role ORDER BY k) = 'assistant' AS valid FROM b GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars, valid FROM c"""


def _negatives_sql() -> str:
    low, high = negatives.BAND
    order = "ORDER BY score DESC, vec_id"
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, x.vec_id, x.label, list_inner_product(a.q, x.q)::BIGINT AS score FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id {order}) <= {negatives.POSITIVES}),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id {order}) AS rank
  FROM p JOIN s USING (anchor_id) WHERE s.label <> p.own AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives.NEGATIVES}"""


def _lines_sql() -> str:
    blank = " || ".join(f"chr({ord(c)})" for c in line_dedup.BLANK)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
k AS (SELECT r, doc_id, i, ls[i] AS l, {_LOW.format(f"trim(ls[i], {blank})")} AS key FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
t AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
g AS (SELECT r, k.doc_id, i, l, t.key IS NOT NULL AND k.doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN t USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r, doc_id"""


ORACLE_SQL = {
    "op2_quality_rules": _quality_sql(),
    "op7_licenses": _licence_sql(),
    "op10_chat": _chat_sql(),
    "op11_hard_negatives": _negatives_sql(),
    "op13_line_dedup": _lines_sql(),
}
