"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesengine.llm import decontaminate, fingerprints, html_extract, packing, pii, prefix_trie, quality, secret_scan, sharding, simhash, spelling, substring, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


SHARDS = [f"shard-{i:03d}" for i in range(128)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and shard of every document, 128 shards."""
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, F.col("doc_id"), SHARDS)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how like they and the next document are."""
    return fingerprints.with_edited_and_next(_read(spark, sf_dir, "documents"))


#: Of the registered query; a deployment passes its own secret.
PII_KEY = "registered-query"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their entities replaced, and how many."""
    return pii.pseudonymise(_read(spark, sf_dir, "documents"), PII_KEY, "n_replaced")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; learnt from the labelled rows that aren't held out."""
    docs = _read(spark, sf_dir, "documents")
    net = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, net, "doc_id").select("doc_id", quality.held_out().alias("held_out"), "score", quality.predicted().alias("predicted"))


def tokenizer_path() -> str:
    """The public vocabulary that the packing query counts tokens by."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    sized = packing.pieces(_read(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(sized).drop("copy")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_read(spark, sf_dir, "pages"), "page_id", "url")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    found = decontaminate.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment").distinct()


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 13-word windows of earlier ones."""
    return substring.deduplicated(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by a ledger that starts empty."""
    docs = _read(spark, sf_dir, "documents")
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    addresses = secret_scan.addressed(versions)
    ledger = secret_scan.scan(versions, addresses=addresses)
    found = secret_scan.findings(addresses, ledger)
    base = [r.name for r in secret_scan.BASE_RULES]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["rule"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("path").alias("doc_id"), *map(count, base),
        F.sha2(joined(F.filter("found", lambda s: s["rule"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learnt from the labelled rows that aren't held out."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    held_out = (toxicity.fold() == 0).alias("held_out")
    return toxicity.score(docs, model, "doc_id").select("doc_id", held_out, "score", toxicity.predicted().alias("predicted"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent long word of the documents with its near words, form and root."""
    runs = spelling.runs(_read(spark, sf_dir, "documents"))
    out = spelling.grouped(spelling.counted(runs.select(spelling.misspelt().alias("word"))))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations that share openings."""
    turns, ids = prefix_trie.with_shared_openings(prefix_trie.numbered(_read(spark, sf_dir, "conversations")))
    return prefix_trie.trie(turns, ids).drop("a", "b")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_fingerprints": op2_fingerprints,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_html": op7_html,
    "op8_decontaminate": op8_decontaminate,
    "op9_substring": op9_substring,
    "op10_secret_scan": op10_secret_scan,
    "op11_toxicity": op11_toxicity,
    "op12_spelling": op12_spelling,
    "op13_prefix_trie": op13_prefix_trie,
}

_OP8 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT 5 AS k UNION SELECT len(w) FROM b WHERE len(w) BETWEEN 1 AND 4),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)
       UNION SELECT item_id, array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1),
hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(n_shared AS INTEGER) AS n_shared, CAST(n_item AS INTEGER) AS n_item, round(n_shared / n_item, 6) AS containment
FROM hit JOIN n USING (item_id) WHERE n_shared >= n_item * 0.8 - 1e-9
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM x JOIN f USING (s), range(0, 13) AS r(k) WHERE doc_id > first),
p AS (SELECT doc_id, i, w[i] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT p.doc_id, string_agg(t, ' ' ORDER BY i) AS text, count(*) AS n FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

#: The checksum's table by its rule (reflected polynomial), and the checksum of text whose code points are ASCII or U+00C0 to U+00FF.
_CRC_TABLE = """(SELECT list(t ORDER BY i) AS crc FROM (SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS t FROM range(256) r(i)))"""


def _crc32(text: str) -> str:
    points = f"list_transform(string_split({text}, ''), lambda ch: CAST(unicode(ch) AS BIGINT))"
    octets = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [195, p - 64] END))"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


_OP12 = f"""
WITH RECURSIVE tab AS MATERIALIZED {_CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
h AS (SELECT run, {_crc32("doc_id || ':' || run")} AS h FROM r, tab WHERE length(run) >= 6),
c AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h),
w AS (SELECT word, count(*) AS n FROM c WHERE length(word) >= 6 GROUP BY 1 HAVING count(*) >= 5),
d AS (SELECT word, n, i, word[1:i - 1] AS a, word[i + 1:] AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
swap AS (SELECT x.word, y.word AS other, y.n AS other_n FROM d x JOIN d y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word),
gap AS (SELECT DISTINCT x.word AS longer, x.n AS longer_n, y.word AS shorter, y.n AS shorter_n FROM d x JOIN w y ON x.a || x.b = y.word),
near AS (SELECT * FROM swap UNION ALL SELECT longer, shorter, shorter_n FROM gap UNION ALL SELECT shorter, longer, longer_n FROM gap),
g AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS best FROM near GROUP BY 1),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * n THEN -best[1] END AS form_n FROM w LEFT JOIN g USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON walk.next = f.word)
SELECT f.word, n, n_near, form, CAST(form_n AS BIGINT) AS form_n, root FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""

_OP13 = f"""
WITH tab AS MATERIALIZED {_CRC_TABLE},
t AS (SELECT conv_id, coalesce(text, '') AS text, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS k, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'k': md5(k), 'n': length(text)}} ORDER BY turn NULLS FIRST, md5(k)) AS turns FROM t GROUP BY 1),
h AS (SELECT conv_id, turns, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM o, tab),
p AS (SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns FROM h c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 100),
m AS (SELECT conv_id, d, len(turns) AS size, md5(array_to_string(list_transform(turns[1:d], lambda x: x.k), '')) AS node,
             md5(array_to_string(list_transform(turns[1:greatest(d - 1, 0)], lambda x: x.k), '')) AS up, coalesce(turns[d].n, 0) AS chars FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM p)),
n AS (SELECT d AS depth, node, up, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = size) AS ends FROM m GROUP BY 1, 2, 3),
k AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
a AS (SELECT n.depth, n.node, n.conv_id, n.n_convs, n.chars, n.up, n.ends, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, depth)),
above AS (SELECT DISTINCT x.d AS depth, x.node, y.d AS top_depth, y.node AS top FROM m x JOIN m y ON x.conv_id = y.conv_id AND y.d <= x.d),
s AS (SELECT top_depth AS depth, top AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM above JOIN a USING (depth, node) GROUP BY 1, 2)
SELECT CAST(a.depth AS BIGINT) AS depth, a.conv_id, q.conv_id AS parent_conv_id, a.n_convs, a.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM a JOIN s USING (depth, node) LEFT JOIN a q ON q.node = a.up AND q.depth = a.depth - 1 AND a.depth > 0
"""

ORACLE: dict[str, str] = {"op9_substring": _OP9, "op8_decontaminate": _OP8, "op12_spelling": _OP12, "op13_prefix_trie": _OP13}
