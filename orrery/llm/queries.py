"""The queries of the corpus operators, for the entry module."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, decontaminate, embeddings, language_model, licences, packing, passages, periodic, quality, simhash, suffixes, token_counts, vector_codes
from orrery.llm.common import table


#: Where the vocabulary files are; a parameter of the operators.
TOKENIZERS = Path(public_tokenizers.path("README.md")).parent


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources, paths their languages."""
    found = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))
    return found.select(F.col("id").alias("doc_id"), "p_quality", "p_toxic", "kept")


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(table(spark, sf_dir, "documents"), str(TOKENIZERS / "word_bpe_49k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_found", "containment")


OP3_SQL = """
WITH lowered AS (
  SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
split AS (
  SELECT side, id, string_split_regex(regexp_replace(t, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '[\\x20\\x09-\\x0D]+') AS ws FROM lowered WHERE regexp_matches(t, '[^\\x20\\x09-\\x0D]')),
item_at AS (SELECT id, ws, least(len(ws), 5) AS w, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM split WHERE side = 'b'),
item AS (SELECT DISTINCT id AS item_id, w, array_to_string(ws[i:i + w - 1], ' ') AS gram FROM item_at),
sizes AS (SELECT item_id, count(*) AS n FROM item GROUP BY item_id),
doc_at AS (SELECT id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM split, (SELECT DISTINCT w FROM item) AS widths WHERE side = 'd' AND len(ws) >= w),
doc AS (SELECT DISTINCT id AS doc_id, w, array_to_string(ws[i:i + w - 1], ' ') AS gram FROM doc_at)
SELECT doc_id, item_id, CAST(any_value(n) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_found, count(*) / any_value(n) AS containment
FROM doc JOIN item USING (w, gram) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n) >= 0.8
"""


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_bytes_removed(table(spark, sf_dir, "documents"))
    kept = F.octet_length("kept").cast("long")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 99))) AS s FROM d)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
new AS (SELECT doc_id, s, CASE WHEN s <= max(s + 100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM late),
runs AS (SELECT doc_id, s, sum(n) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM new),
spans AS (SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM spans),
cut AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept, max(hi) AS last FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""


def op5_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_paragraphs(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.class_bigram_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, l.b FROM reach JOIN l ON reach.r = l.a),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, and after two edits: five characters go at a third, a word comes in at two thirds."""
    docs = table(spark, sf_dir, "documents")
    third = F.floor(F.coalesce(F.length("text"), F.lit(0)) / 3).cast("int")
    edit = lambda start, end, text: F.struct(start.alias("start"), end.alias("end"), F.lit(text).alias("text"))
    edits = F.array(edit(third, third + 5, ""), edit(2 * third, 2 * third, " [edited] "))
    path = str(TOKENIZERS / "byte_bpe_50k.json")
    found = token_counts.edited_trees(token_counts.counted_trees(docs.select("doc_id", "text", edits.alias("edits")), path, edits_col="edits"), path)
    return found.select(F.col("id").alias("doc_id"), F.col("n_pre_tokens_before").alias("n_pre_tokens"), F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_reencoded")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, sf_dir, "documents"), keep=1)
    return found.select(F.col("id").alias("doc_id"), "start_word", "end_word", F.col("source_id").alias("source_doc_id"), "source_start", "source_end", "similarity")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), str(TOKENIZERS / "byte_bpe_50k.json"))
    pieces = pieces.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, book = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return found.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _op12_sql(rounds: int = 6) -> str:
    """The rounds one after the other; ``near`` picks the first of the nearest entries."""
    near = "SELECT vec_id, part, arg_min(entry, 16 * d + entry) AS entry, min(d) AS d FROM (SELECT p.vec_id, p.part, c.entry, sum((p.x - c.x) * (p.x - c.x)) AS d FROM p JOIN {c} c USING (part, pos) GROUP BY ALL) GROUP BY vec_id, part"
    ctes = [
        "kept AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, i // (n // 8) AS part, i % (n // 8) AS pos, CAST(floor(4096 * CAST(e[i + 1] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT vec_id, e, len(e) AS n, unnest(range(len(e))) AS i FROM kept))",
        "c0 AS MATERIALIZED (SELECT part, pos, entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})")
        if r < rounds:
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.pos, c.entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT part, pos, entry, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM p JOIN a{r} USING (vec_id, part) GROUP BY ALL) m USING (part, pos, entry))")
    return f"""WITH {", ".join(ctes)},
v AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
s AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN kept USING (vec_id), s"""


OP12_SQL = _op12_sql()


def _planted(doc_id, text):
    """The text of a tenth of the documents with one of its ends repeated, as the query's contract says: crc32 of the id decides."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " "))

    # The words are an array's only member, so that they are divided once and not for each word.
    words = F.array(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return F.when(h % 10 == 0, F.get(F.transform(words, repeated), F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs)
    # Of the longest runs the first, of these the one with the shorter period.
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("id", "runs", "collapsed", top.alias("top"), lines.alias("lines"))
    period = -F.col("top.shorter")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("top.before")).alias("start"), F.col("top.length").alias("length"), period.alias("period"),
        F.expr("(1000 * top.length) div -top.shorter").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _op13_sql() -> str:
    table_of = "SELECT b, b AS c FROM (SELECT unnest(range(256)) AS b)"
    for _ in range(8):
        table_of = f"SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({table_of})"
    return rf"""
WITH crc AS (SELECT list(CAST(c AS BIGINT) ORDER BY b) AS tab FROM ({table_of})),
d AS MATERIALIZED (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) AS h,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents, crc),
g AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AS hit, (h // 10) % greatest(len(ws), 1) AS a, (h // 10) % 8 AS g8 FROM d),
w AS MATERIALIZED (SELECT doc_id, n, i, ws[1 + CASE WHEN hit AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g8)) ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM g)),
same AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i WHERE 2 * (y.i - x.i) <= x.n),
isle AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM same),
long AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS l FROM isle GROUP BY doc_id, p, k HAVING count(*) + p >= greatest(12, 2 * p)),
runs AS MATERIALIZED (SELECT doc_id, s, l, min(p) AS p FROM long GROUP BY doc_id, s, l),
r AS (SELECT doc_id, count(*) AS n_runs, first((s, l, p) ORDER BY l DESC, s, p) AS best, string_agg(concat(s, ',', l, ',', p, chr(10)), '' ORDER BY s, p) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + l)) AS i FROM runs),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best[1] AS BIGINT) AS start, CAST(best[2] AS BIGINT) AS length, CAST(best[3] AS BIGINT) AS period, CAST(1000 * best[2] // best[3] AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""


OP13_SQL = _op13_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_bpe_encode_decode, op3_benchmark_decontamination, op4_suffix_array_dedup, op5_licence_scans, op6_lm_scoring, op7_embedding_near_dedup, op8_token_counts, op9_simhash_near_dedup, op10_substring_dedup, op11_best_fit_packing, op12_vector_codes, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": OP3_SQL, "op4_suffix_array_dedup": OP4_SQL, "op7_embedding_near_dedup": OP7_SQL, "op12_vector_codes": OP12_SQL, "op13_periodic_runs": OP13_SQL}
