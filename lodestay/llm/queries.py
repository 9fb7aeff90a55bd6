"""The queries of this subpackage: name -> function of (spark, sf_dir), and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestay.llm.common import table
from lodestay.storage import kept_path


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: distinct 4-word shingles and the smallest doc_id that links of similarity 0.85 or more lead to."""
    from lodestay.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score and prediction of the factorisation machine."""
    from lodestay.llm.quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: what the archive, written and read back, says of its record. Null pages are empty payloads."""
    from lodestay.llm.warc import read_archive, write_archive

    path = kept_path(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts and digest of base spans, all spans, and the novelty of each."""
    from lodestay.llm.secrets import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query vector: its ten nearest vectors by Euclidean distance."""
    from lodestay.llm.binary_codes import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a document: where it lies in the packed sequences."""
    from lodestay.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, predicted language and its probability."""
    from lodestay.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, crc32 of the little-endian ids, and whether decoding gives the text back."""
    from lodestay.llm.sentencepieces import decode, encode

    path = tokenizer_path("piece_bpe_32k.model")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: where its ids lie in the token files, how many there are, and their crc32, read from the files."""
    from lodestay.llm.wavelet import read_documents, write_tokens

    path = kept_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_documents(spark, path)


def op10_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query vector: its five highest integer inner products."""
    from lodestay.llm.inner_products import top_products

    return top_products(table(spark, sf_dir, "embeddings"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: leaf, roots and proof of the manifest, and whether the text, where tampered with, still verifies.

    The text of a document with an even crc32 of its id loses its line breaks; null ids and null texts stay.
    """
    from lodestay.llm.merkle import fold, leaf_digest, manifest, proof_digest

    docs = table(spark, sf_dir, "documents")
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    tampered = F.when(hit, leaf_digest([*plain, F.replace("text", F.lit("\n"), F.lit(""))]))
    rows = manifest(spark, docs, "source", "doc_id", leaf_digest([*plain, F.col("text")]), {"tampered": tampered})
    rows = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    proof = proof_digest(F.col("path")).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: places of the base phrases, labels of all templates, and the share of words that they cover."""
    from lodestay.llm.licenses import digest, license_spans

    return digest(license_spans(table(spark, sf_dir, "documents")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frequent word: its form, root, occurrences, near words and the form's occurrences."""
    from lodestay.llm.spelling import variants

    return variants(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ngram_jaccard, op2_quality, op3_warc, op4_secrets, op5_nearest, op6_packing, op7_language, op8_sentencepiece, op9_wavelet_tokens, op10_inner_products, op11_merkle, op12_licenses, op13_spelling)
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries whose rows it can state: the archive's digests, the exact product search, the manifest, the spellings."""
    return {"op3_warc": _WARC, "op10_inner_products": _PRODUCTS, "op11_merkle": _MERKLE, "op13_spelling": _SPELLING}


#: Base32 from the SHA-1's hex digits: every five bits, most significant first, pick a letter.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, octet_length(encode(body)) AS payload_bytes, sha1(body) AS h FROM p),
b AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1), '' ORDER BY i) AS payload_digest
      FROM (SELECT DISTINCT h FROM d), range(32) r(i) GROUP BY h),
m AS (SELECT h, max(page_id) AS last FROM d GROUP BY h)
SELECT d.page_id, d.payload_bytes, b.payload_digest,
       CASE WHEN d.page_id = m.last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id = m.last THEN NULL ELSE m.last END AS refers_to
FROM d JOIN b ON d.h = b.h JOIN m ON d.h = m.h
"""

_PRODUCTS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: crc32 of a text: byte by byte through the table of the 256 remainders, which eight halvings of each number give.
_CRC = """
r AS (SELECT i, 0 AS step, i::BIGINT AS v FROM range(256) t(i)
      UNION ALL SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM r WHERE step < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM r WHERE step = 8)"""


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII or Latin-1 text, where ``crc`` is joined."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(crc.t[xor(c & 255, b) + 1], c >> 8)), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
_MERKLE = f"""
WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, source, sha256({_HEAD} || {_field("text")}) AS leaf,
             CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN sha256({_HEAD} || {_field("replace(text, chr(10), '')")}) END AS tampered
      FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (SELECT source, 0 AS height, place, n, leaf AS h FROM leaves
       UNION ALL SELECT source, height + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY source, height, place // 3, n),
subroots AS (SELECT source, height, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS height, place, n, h FROM subroots
        UNION ALL SELECT height + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY height, place // 3, n),
line AS (SELECT l.*, s.h AS subroot, s.height AS depth, s.place AS tree FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source),
beside AS (
  SELECT l.source, l.place, u.height AS step, u.place AS other, (l.place // (3 ** u.height)::BIGINT) AS own, u.h
  FROM line l JOIN up u ON u.source IS NOT DISTINCT FROM l.source AND u.height < l.depth AND u.place // 3 = l.place // (3 ** (u.height + 1))::BIGINT
  UNION ALL
  SELECT l.source, l.place, l.depth + t.height, t.place, (l.tree // (3 ** t.height)::BIGINT), t.h
  FROM line l JOIN top t ON t.n > 1 AND t.place // 3 = l.tree // (3 ** (t.height + 1))::BIGINT),
steps AS (SELECT source, place, step, coalesce(string_agg(h, '' ORDER BY other) FILTER (other < own), '') AS before,
                 coalesce(string_agg(h, '' ORDER BY other) FILTER (other > own), '') AS after FROM beside GROUP BY source, place, step),
proofs AS (SELECT source, place, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY source, place),
fold AS (SELECT source, place, 0 AS step, coalesce(tampered, leaf) AS h FROM line
         UNION ALL SELECT f.source, f.place, f.step + 1, sha256(s.before || f.h || s.after)
         FROM fold f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.place = f.place AND s.step = f.step),
folded AS (SELECT source, place, max_by(h, step) AS folded_root FROM fold GROUP BY source, place)
SELECT l.doc_id, l.leaf, l.subroot, t.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.h AS verified
FROM line l JOIN top t ON t.n = 1 JOIN folded f ON f.source IS NOT DISTINCT FROM l.source AND f.place = l.place
LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM l.source AND p.place = l.place
"""

_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One ASCII character that no word holds for each of U+00C0 to U+00FF: the edit distance of DuckDB counts bytes.
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_STAND_INS = _A_TO_Z + "0123456789" + "!#$%&()*+,-./:;<=>?@[]^_{|}~"
_SPELLING = f"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{_A_TO_Z}', '{_A_TO_Z.lower()}') AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS said, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
checked AS (SELECT run, n, {_crc32("said")} AS h FROM counted, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM checked),
w AS (SELECT word, sum(n)::BIGINT AS n, translate(word, '{_WIDE}', '{_STAND_INS}') AS plain FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
near AS (SELECT a.word, b.word AS other, a.n, b.n AS other_n FROM w a JOIN w b ON abs(length(a.plain) - length(b.plain)) <= 1 WHERE levenshtein(a.plain, b.plain) = 1),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near),
f AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 5 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 5 * w.n THEN r.other_n END AS form_n
      FROM w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT word, max_by(root, step) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM f JOIN last l USING (word)
"""
