"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.llm import bpe, chat, decontaminate, exact_dedup, langid, learning, line_dedup, minhash, mixing, repair, spelling, topk, toxicity, warc
from symlattice.session import table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


SQL_TOPK = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


SQL_EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.Bpe(spark, vocabulary_path())
    ids = table(spark, sf_dir, "documents").select("doc_id", codec.both(F.col("text")).alias("both"))
    return with_digests(ids.select("doc_id", "both.ids", "both.decoded")).drop("ids", "decoded")


def with_digests(df: DataFrame) -> DataFrame:
    return df.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256), "decoded_sha256": F.sha2("decoded", 256)})


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


SQL_MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
o AS (
  SELECT *, row_number() OVER a AS nth, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget,
    coalesce(sum(cap) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(weight) OVER () - coalesce(sum(weight) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM c WINDOW a AS (ORDER BY ratio, source NULLS LAST)
), l AS (SELECT *, (budget - spent) / rest AS level FROM o),
e AS (SELECT min(nth) AS nth FROM l WHERE ratio > level),
t AS (
  SELECT source, source_size, CASE WHEN l.nth >= e.nth THEN (SELECT level FROM l l2 WHERE l2.nth = e.nth) * weight ELSE cap END AS target FROM l, e
), p AS (
  SELECT *, CAST(round(target) AS BIGINT) AS want FROM t
), g AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN want % source_size ELSE 0 END AS extra FROM p
)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, extra - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
"""


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learnt(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(F.col("id").alias("doc_id"), learning.held_out("id").alias("held_out"), "score", "predicted", "offending")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, vocabulary_path("piece_bpe_32k.model"))
    return langid.identify(docs, model).select(F.col("id").alias("doc_id"), learning.held_out("id").alias("held_out"), "lang_pred", "score")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.from_turns(table(spark, sf_dir, "conversations"))
    return chat.link(calls, results, chat.SCHEMAS).drop("problems")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def _sql_repair() -> str:
    """The same by dynamic programming forwards: for each state the least text of cost and edits, a row of every conversation in a step."""
    add = lambda x, cost, edit: f"(lpad(CAST(CAST(left({x}, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || substr({x}, 7) || '{edit}')"
    to_user = lambda src: f"SELECT * REPLACE (least(n2, {add('n0', 2, 'I')}, {add('n1', 2, 'I')}, {add('n3', 2, 'I')}) AS n2) FROM ({src})"
    to_assistant = lambda src: f"SELECT * REPLACE (least(n3, {add('n2', 2, 'I')}) AS n3) FROM ({src})"
    inserted = lambda src: to_user(to_assistant(to_user(src)))
    more = "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END"
    keep = lambda x, initial: f"CASE WHEN free AND initial = '{initial}' THEN {add(x, more, 'K')} END"
    rerole = lambda x: f"CASE WHEN free THEN {add(x, f'(2 + {more})', 'R')} END"
    fold = lambda xs, f: ", ".join(f(x) for x in xs)
    stepped = (
        f"SELECT c, pos + 1 AS pos, {add('n0', 3, 'D')} AS n0, least({add('n1', 3, 'D')}, {keep('n0', 's')}) AS n1, "
        f"least({add('n2', 3, 'D')}, {fold(('n0', 'n1', 'n3'), lambda x: keep(x, 'u'))}, {fold(('n0', 'n1', 'n3'), rerole)}) AS n2, least({add('n3', 3, 'D')}, {keep('n2', 'a')}, {rerole('n2')}) AS n3 "
        f"FROM ({inserted('SELECT l.*, f.initial, f.fault, f.free FROM l JOIN f ON f.c = l.c AND f.pos = l.pos + 1')})"
    )
    return rf"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([CAST(i AS BIGINT)] || [CAST(0 AS BIGINT) FOR _ IN range(8)], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))
), ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
h AS (
  SELECT ids.c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ord(x) AS BIGINT) FOR x IN string_split(coalesce(CAST(v.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')], lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS how
  FROM conversations v JOIN ids ON ids.conv_id IS NOT DISTINCT FROM v.conv_id, tab
), d AS (
  SELECT c, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE how <> 0
), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS pos, left(role, 1) AS initial, regexp_replace(text, '[ 	-
]+$', '') AS body FROM d),
f AS MATERIALIZED (
  SELECT *, fault IS NULL OR fault = 'truncated' AS free, lag(initial) OVER (PARTITION BY c ORDER BY pos) || initial AS two
  FROM (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM r)
), l AS (
  SELECT c, CAST(0 AS BIGINT) AS pos, '000000' AS n0, CAST(NULL AS VARCHAR) AS n1, CAST(NULL AS VARCHAR) AS n2, CAST(NULL AS VARCHAR) AS n3 FROM ids
  UNION ALL {stepped}
), z AS (SELECT c, least(n0, n3) AS best FROM ({inserted('SELECT l.* FROM l JOIN (SELECT c, max(pos) AS pos FROM l GROUP BY c) USING (c, pos)')})),
e AS (
  SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER w AS pos, sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER w AS nth
  FROM (SELECT c, nr, substr(best, 6 + nr, 1) AS edit FROM (SELECT c, best, CAST(unnest(range(1, length(best) - 5)) AS INTEGER) AS nr FROM z)) WINDOW w AS (PARTITION BY c ORDER BY nr)
), s AS (SELECT c, count(*) AS headed FROM e JOIN f USING (c, pos) WHERE edit = 'K' AND nth = 1 AND initial = 's' GROUP BY c),
t AS (
  SELECT e.c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - coalesce(headed, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY nr) AS said
  FROM e LEFT JOIN f ON f.c = e.c AND f.pos = e.pos AND edit <> 'I' LEFT JOIN s ON s.c = e.c WHERE edit <> 'D' GROUP BY e.c
), g AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(left(best, 6) AS BIGINT) AS cost, substr(best, 7) AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM ids JOIN z USING (c) LEFT JOIN g USING (c) LEFT JOIN t USING (c)
"""


SQL_REPAIR = _sql_repair()


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build(table(spark, sf_dir, "documents"))
    found = decontaminate.contamination(index, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


SQL_DECONTAMINATE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), p AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS s FROM d),
h AS (
  SELECT k, s, q.n, item FROM p JOIN (SELECT DISTINCT n FROM q) l ON s + l.n - 1 <= len(w) JOIN q ON q.n = l.n AND q.phrase = array_to_string(w[s:s + l.n - 1], ' ')
), c AS (SELECT k, count(DISTINCT hit) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS hit FROM (SELECT DISTINCT k, s, n FROM h)) GROUP BY k),
i AS (SELECT k, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN i USING (k)
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


# crc32 bit by bit in tables of 256; a word's deletions at each place are the keys on which near words meet
SQL_SPELLING = r"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([CAST(i AS BIGINT)] || [CAST(0 AS BIGINT) FOR _ IN range(8)], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))
), d AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), r AS (SELECT doc, run, count(*) AS m, encode(doc || ':' || run) AS e FROM d WHERE length(run) >= 7 GROUP BY ALL),
h AS (
  SELECT run, m, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ord(x) AS BIGINT) FOR x IN string_split(doc || ':', '')] || flatten([CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + (ord(x) >> 6) AS BIGINT), CAST(128 + (ord(x) & 63) AS BIGINT)] END FOR x IN string_split(run, '')]), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM r, t
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, CAST(sum(m) AS BIGINT) AS n FROM h GROUP BY 1
), v AS (SELECT word, n, length(word) AS len FROM w WHERE length(word) >= 7 AND n >= 2),
x AS (SELECT word, n, len, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT *, unnest(range(len)) AS i FROM v)),
p AS (
  SELECT DISTINCT * FROM (SELECT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM x a JOIN v b ON a.cut = b.word UNION ALL SELECT b.word, b.n, a.word, a.n FROM x a JOIN v b ON a.cut = b.word)
), f AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-nb, b)) AS to_word, max(nb) AS to_n FROM p GROUP BY a),
g AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN to_n >= 10 * n THEN to_word END AS form, CASE WHEN to_n >= 10 * n THEN to_n END AS form_n FROM v LEFT JOIN f USING (word)),
c AS (SELECT word, form AS last, 1 AS step FROM g WHERE form IS NOT NULL UNION ALL SELECT c.word, g.form, step + 1 FROM c JOIN g ON g.word = c.last WHERE g.form IS NOT NULL),
z AS (SELECT word, arg_max(last, step) AS root FROM c GROUP BY word)
SELECT word, n, n_near, form, form_n, coalesce(root, word) AS root FROM g LEFT JOIN z USING (word)
"""


QUERIES = {
    "op1_topk": op1_topk,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_warc": op3_warc,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_langid": op6_langid,
    "op7_chat": op7_chat,
    "op8_mix": op8_mix,
    "op9_minhash": op9_minhash,
    "op10_line_dedup": op10_line_dedup,
    "op11_repair": op11_repair,
    "op12_decontaminate": op12_decontaminate,
    "op13_spelling": op13_spelling,
}
ORACLES = {"op1_topk": SQL_TOPK, "op2_exact_dedup": SQL_EXACT_DEDUP, "op3_warc": SQL_WARC, "op8_mix": SQL_MIX, "op11_repair": SQL_REPAIR, "op12_decontaminate": SQL_DECONTAMINATE, "op13_spelling": SQL_SPELLING}
