"""The registered queries of the text operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import ann, bpe, decontam, iblt, langid, license, linededup, quality, runs, simhash, substring, trie, warc
from shelfcast.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out("doc_id")))
    told = langid.identify(docs, model)
    return told.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), *how), *how)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.groupBy("doc_id", "item_id").agg(F.max("common").alias("common"), F.max("answer").alias("answer"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), size=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"),
                      F.array_join("left_over", ",").alias("left_over"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, bits=3)
    return out.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = iblt.fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", F.sha2(iblt.serialised(F.col("cells")), 256).alias("fingerprint"),
                      F.sha2(iblt.serialised(F.col("edited_cells")), 256).alias("edited_fingerprint"), "near_edited", "near_next", "n_paragraphs")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.with_heads(trie.conversations(table(spark, sf_dir, "conversations"))))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.collapse_runs(table(spark, sf_dir, "documents"), planted=True, texts=False)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_byte_bpe, op3_decontamination, op4_substring, op5_nearest, op6_warc, op7_license_scan, op8_simhash, op9_line_dedup, op10_quality,
                                  op11_document_fingerprints, op12_prefix_trie, op13_periodic_runs)}


def _license_sql() -> str:
    names = "MAP {" + ", ".join(f"'{t}': '{name}'" for name, texts in license.SENTENCES.items() for t in texts) + "}"
    steps, left = [], "s0"
    for i, (_, ids) in enumerate(license.by_length()):
        p = "," + ",,".join(ids) + ","
        steps.append(f"s{i + 1} AS (SELECT *, contains(l{i}, '{p}') AS h{i}, replace(l{i}, '{p}', '') AS l{i + 1} FROM {left})")
        left = f"s{i + 1}"
    hits = ", ".join(f"CASE WHEN h{i} THEN '{name}' END" for i, (name, _) in enumerate(license.by_length()))
    n = len(license.RULES)
    return f"""
WITH cut AS (
  SELECT doc_id, list_transform(string_split(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(text, ''),
      '\\n([^A-Za-z0-9\\n]*[A-Z][a-z])', chr(1) || '\\1', 'g'), '[.;:!?]+([ \\t\\n\\v\\f\\r]|$)|\\n[ \\t\\n\\v\\f\\r]*\\n', chr(1), 'g')),
      '[^a-z0-9.+\\x01]+', ' ', 'g'), chr(1)), lambda s: regexp_replace(s, '^[ .]+|[ .]+$', '', 'g')) AS ss FROM documents),
k AS (SELECT {names} AS m),
ids AS (SELECT doc_id, list_filter(list_transform(ss, lambda s: m[s]), lambda x: x IS NOT NULL) AS found FROM cut, k),
s0 AS (SELECT doc_id, array_to_string(found, ',') AS sentence_ids, ',' || array_to_string(list_transform(found, lambda x: x || ',,'), '') AS l0 FROM ids),
{', '.join(steps)}
SELECT doc_id, sentence_ids, array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))), ',') AS licences,
       array_to_string(list_filter(string_split(l{n}, ','), lambda x: x <> ''), ',') AS left_over FROM {left}"""


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS m FROM p GROUP BY h),
b AS (SELECT page_id, strlen(p.h) AS n, unhex(sha1(p.h))::BIT::VARCHAR AS bits, m FROM p JOIN g USING (h))
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + 16 * substr(bits, CAST(5 * i + 1 AS INT), 1)::INT + 8 * substr(bits, CAST(5 * i + 2 AS INT), 1)::INT + 4 * substr(bits, CAST(5 * i + 3 AS INT), 1)::INT
           + 2 * substr(bits, CAST(5 * i + 4 AS INT), 1)::INT + substr(bits, CAST(5 * i + 5 AS INT), 1)::INT AS INT), 1)), '') AS payload_digest,
       CASE WHEN m IS NOT DISTINCT FROM page_id OR m IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m IS DISTINCT FROM page_id THEN m END AS refers_to FROM b"""

SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
         FROM win JOIN (SELECT k, min(doc_id) AS m FROM win GROUP BY k) USING (k) WHERE m < doc_id),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Of two texts: paragraphs cut at line breaks and after sentence marks, the digests' set, and the cells of a sketch.
_KEYS = r"""list_distinct(list_transform(list_filter(string_split(regexp_replace({0}, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)),
    lambda p: p <> ''), lambda p: ('0x' || md5(p)[1:15])::BIGINT))"""


def _cells_sql(keys: str) -> str:
    """The serialised sketch of a list of digests, from the hash coefficients of level 0."""
    def place(j: int) -> str:
        return f"{iblt.PART * j} + (((k % {iblt.P}) * 48271 + (k % {iblt.Q}) * 69621) % {iblt.P} >> {iblt.PART_BITS * j}) % {iblt.PART}"

    hit = " OR ".join(f"i = {place(j)}" for j in range(3))
    check = f"(k % {iblt.P}) * (k % {iblt.Q})"
    return f"""array_to_string(list_transform(list_transform(range({iblt.CELLS}), lambda i: list_filter({keys}, lambda k: {hit})),
    lambda f: len(f) || ':' || lower(to_hex(list_reduce(list_prepend(0::BIGINT, f), lambda a, k: xor(a, k)))) || ':' ||
              lower(to_hex(list_reduce(list_prepend(0::BIGINT, list_transform(f, lambda k: {check})), lambda a, k: xor(a, k))))), ',')"""


FINGERPRINT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n_chars, coalesce(lead(t) OVER (ORDER BY doc_id DESC NULLS LAST), first_value(t) OVER (ORDER BY doc_id DESC NULLS LAST)) AS nx FROM d),
e AS (SELECT *, left(t, n_chars - n_chars // 2) || left(nx, n_chars // 2) AS ed FROM n),
k AS (SELECT doc_id, n_chars, sha256(ed) AS edited_sha256, {_KEYS.format('t')} AS a, {_KEYS.format('ed')} AS e, {_KEYS.format('nx')} AS b FROM e)
SELECT doc_id, n_chars, edited_sha256, sha256({_cells_sql('a')}) AS fingerprint, sha256({_cells_sql('e')}) AS edited_fingerprint,
       CASE WHEN len(a) + len(e) = 0 THEN 1 ELSE 2 * len(list_intersect(a, e)) / (len(a) + len(e)) END AS near_edited,
       CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE 2 * len(list_intersect(a, b)) / (len(a) + len(b)) END AS near_next,
       len(a)::INT AS n_paragraphs FROM k"""

TRIE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, turn, sha256(length(r) || ':' || r || x)[1:32] AS k, len(regexp_extract_all(x, '[^ 	-
]+')) AS w FROM t),
c AS (SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, k) AS own,
        xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
            lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 4 AS h FROM g GROUP BY conv_id),
m AS (SELECT a.conv_id, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS ts FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id - a.conv_id % 20),
p AS (SELECT conv_id, len(ts) AS n, unnest(range(len(ts) + 1)) AS depth, ts FROM m),
q AS (SELECT conv_id, n, depth, array_to_string(list_transform(ts[1:depth], lambda s: s.k), '') AS node,
             CASE WHEN depth > 0 THEN array_to_string(list_transform(ts[1:depth - 1], lambda s: s.k), '') END AS parent, coalesce(ts[depth].w, 0) AS w FROM p),
v AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saves,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM q GROUP BY node),
z AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN (SELECT parent AS node, count(*) AS n_children FROM v WHERE parent IS NOT NULL GROUP BY parent) USING (node)),
s AS (SELECT DISTINCT a.node AS top, b.node FROM q a JOIN q b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
u AS (SELECT top AS node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saves)::BIGINT AS saved_tokens FROM s JOIN z USING (node) GROUP BY top)
SELECT z.conv_id, z.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, z.n_convs, z.n_children, n_leaves, saved_tokens, z.ends_sha256
FROM z JOIN u USING (node) LEFT JOIN z o ON o.node = z.parent"""

ORACLE = {"op4_substring": SUBSTRING_SQL, "op6_warc": WARC_SQL, "op7_license_scan": _license_sql(),
          "op11_document_fingerprints": FINGERPRINT_SQL, "op12_prefix_trie": TRIE_SQL}
