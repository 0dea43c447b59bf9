"""One registered query for each operator of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path() -> str:
    """The public byte-level BPE file of the contracts; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.token_store import token_file_round_trip

    return token_file_round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), added=True)


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
"""
_OP3_TAIL = """
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) m ON m.x = d.doc_id
"""


@query("op3_near_duplicates", OP3_SQL.replace("WITH w", "WITH RECURSIVE w", 1) + _OP3_TAIL)
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM v),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, l WHERE len(w) >= n),
h AS (SELECT p.doc_id, p.n, p.i, v.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM p) p JOIN v ON p.win = v.win AND p.n = v.n),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query("op10_decontamination", OP10_SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.winnowing import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.common import held_out
    from gridloom.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 4).alias("held_out"))
    model = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op7_retrieval_packing")
def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), added=True)


@query("op9_document_fingerprints")
def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.bloom_lookup import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


@query("op5_suffix_repeats")
def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from gridloom.llm.suffixes import remove_repeats

    rows = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_warc")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.warc import archive_round_trip

    rows = archive_round_trip(table(spark, sf_dir, "pages")).where("gap is null")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_lm_scores")
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.common import held_out
    from gridloom.llm.hmm import score_documents

    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 7).alias("held_out")))


@query("op8_licence_scan")
def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.licences import fit, sample_paragraphs, scan

    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(sample_paragraphs(docs)))


@query("op11_source_mix")
def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


#: CRC-32 of the text ``s`` by its table of 256 steps.
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, list_transform(range(8), lambda k: k::BIGINT)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t"""
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode({s}))), 2), lambda i: ('0x' || substr(hex(encode({s})), i, 2))::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"""

OP12_SQL = """
WITH RECURSIVE crc AS (TABLE_OF_CRC),
f AS (SELECT d.*, coalesce(CAST(doc_id AS VARCHAR), '') AS idt FROM documents d),
x AS (SELECT doc_id, source, text, CRC_OF_ID % 2 = 0 AS torn,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
      FROM f, crc),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(CASE WHEN torn THEN replace(text, chr(10), '') ELSE text END) || ':' || CASE WHEN torn THEN replace(text, chr(10), '') ELSE text END, '-')) AS shown FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
u AS (SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM o GROUP BY source
      UNION ALL SELECT source, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM u WHERE len(nodes) > 1),
s AS (SELECT source, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM u WHERE len(nodes) = 1),
v AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s
      UNION ALL SELECT level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM v WHERE len(nodes) > 1),
r AS (SELECT nodes[1] AS root FROM v WHERE len(nodes) = 1),
p AS (SELECT o.doc_id, o.source, o.pos, o.leaf, u.level, nodes[3 * (pos // CAST(pow(3, u.level + 1) AS BIGINT)) + 1:3 * (pos // CAST(pow(3, u.level + 1) AS BIGINT)) + 3] AS run, pos // CAST(pow(3, u.level) AS BIGINT) % 3 AS seat
      FROM o JOIN u ON o.source IS NOT DISTINCT FROM u.source WHERE len(nodes) > 1
      UNION ALL SELECT o.doc_id, o.source, o.pos, o.leaf, s.height + v.level, v.nodes[3 * (place // CAST(pow(3, v.level + 1) AS BIGINT)) + 1:3 * (place // CAST(pow(3, v.level + 1) AS BIGINT)) + 3], place // CAST(pow(3, v.level) AS BIGINT) % 3
      FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source, v WHERE len(v.nodes) > 1),
q AS (SELECT source, pos, list({'lo': array_to_string(run[1:seat], ''), 'hi': array_to_string(run[seat + 2:len(run)], '')} ORDER BY level) AS path FROM p GROUP BY source, pos),
g AS (SELECT o.source, o.pos, shown AS node, coalesce(path, []) AS path, 1 AS k FROM o LEFT JOIN q ON o.source IS NOT DISTINCT FROM q.source AND o.pos = q.pos
      UNION ALL SELECT source, pos, sha256(path[k].lo || node || path[k].hi), path, k + 1 FROM g WHERE k <= len(path))
SELECT o.doc_id, o.leaf, s.subroot, r.root, sha256(coalesce(array_to_string(list_transform(g.path, lambda e: e.lo || e.hi), ''), '')) AS proof_sha256, g.node AS folded_root, g.node = r.root AS verified
FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source JOIN g ON g.source IS NOT DISTINCT FROM o.source AND g.pos = o.pos AND g.k = len(g.path) + 1, r
"""
OP12_SQL = OP12_SQL.replace("TABLE_OF_CRC", _CRC_TABLE).replace("CRC_OF_ID", _CRC.format(s="idt"))


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.merkle import document_manifest

    return document_manifest(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE crc AS (TABLE_OF_CRC),
a AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
b AS (SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM a WHERE length(run) >= 6 GROUP BY ALL),
c AS (SELECT run, n, CRC_OF_K AS h FROM b, crc),
d AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM c),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
e AS (SELECT DISTINCT word, n, i, word[1:i] || word[i + 2:] AS cut FROM w, unnest(range(length(word))) AS t(i)),
x AS (SELECT DISTINCT p.word AS a, q.word AS b, q.n AS m FROM e p JOIN e q ON p.cut = q.cut AND p.i = q.i AND p.word <> q.word
      UNION SELECT e.word, w.word, w.n FROM e JOIN w ON e.cut = w.word
      UNION SELECT w.word, e.word, e.n FROM e JOIN w ON e.cut = w.word),
y AS (SELECT a, count(*) AS n_near, max(m) AS most FROM x GROUP BY a),
z AS (SELECT x.a, min(x.b) AS b, min(x.m) AS m FROM x JOIN y USING (a) JOIN w ON w.word = x.a WHERE x.m = y.most AND x.m >= 5 * w.n GROUP BY x.a),
f AS (SELECT word, word AS root, 0 AS k FROM w UNION ALL SELECT f.word, z.b, k + 1 FROM f JOIN z ON z.a = f.root)
SELECT w.word, z.b AS form, (SELECT arg_max(root, k) FROM f WHERE f.word = w.word) AS root, w.n, coalesce(y.n_near, 0) AS n_near, z.m AS form_n
FROM w LEFT JOIN y ON y.a = w.word LEFT JOIN z ON z.a = w.word
"""
OP13_SQL = OP13_SQL.replace("TABLE_OF_CRC", _CRC_TABLE).replace("CRC_OF_K", _CRC.format(s="k"))


@query("op13_spelling_variants", OP13_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))
