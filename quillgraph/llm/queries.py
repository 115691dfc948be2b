"""Queries of the text problems, and their SQL where SQL can say them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.current import current_rows
from ..session import materialize, read_table
from . import distinctive, encode, frequency, leakage, markup, spans, split


# Bodies, their clean text, and whether there was markup.
_MARKED = [
    ("Una <b>zona</b> lenta", "Una zona lenta", True),
    ("a &amp;nbsp; b &lt; c", "a b < c", True),
    ("## **Cada** _zona_", "Cada zona", True),
    ("1. uno\n2. *dos*\n- tres", "1. uno\n2. dos\n• tres", True),
    ("el [pero](../rule/x-4.md) no", "el pero no", True),
    ("la [[sla/route-603|La]] no {{nota|{{aviso|estante}}|pie=x}}", "la La no estante", True),
    ("== Uno ==\ntexto\n{|\n|-\n| a || 1\n|}", "Uno\n\ntexto\n\na\t1", True),
    ("\\section{Uno} caf\\'{e} \\textbf{\\emph{ruta}} $d_0$", "Uno\n\ncafé ruta d_0", True),
    ("```py\nx = 1  # **no**\n```", "x = 1  # **no**", True),
    ("uno<ref>a</ref> dos\\footnote{b}", "uno dos", True),
    ("[Inicio](/) | [Guía](/g)\n[[Portada]]\n\nEl palé cabe.\n", "El palé cabe.", True),
    ("2*3*4 y 5 * 6, x == 6 | y == 5", "2*3*4 y 5 * 6, x == 6 | y == 5", False),
    ("D:\\bultos\\77, peso_neto_kg, US$ 17, ~26 kg", "D:\\bultos\\77, peso_neto_kg, US$ 17, ~26 kg", False),
    ("", "", False),
    (None, None, False),
]
# Texts and their ids by the public tokenizer (as its other library gives them).
_ENCODED = [
    ("el palé número 21 no cabe", "417 6340 2634 299 21356 647 78 2310 645 269 11231"),
    ("it's we'll they've", "270 338 356 1183 484 1053"),
    ("  two  spaces\n\n\nand lines ", "220 734 220 9029 628 198 392 3951 220"),
    ("aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "24794 24794 24794 24794 24794 24794 24794"),
    ("漢字 y 🚚🏽 é", "162 120 95 27764 245 331 12520 248 248 8582 237 121 304 136 223"),
    ("<|endoftext|>", "27 91 437 1659 5239 91 29"),
    ("!!!!????....", "13896 9805 1106"),
    ("12345678901234567890", "10163 2231 3134 4531 486 1954 2231 30924 3829"),
    ("", ""),
    (None, ""),
]


def _clean(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return markup.clean_bodies(read_table(spark, d, "entities"), read_table(spark, d, "components"), current_rows, columns)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d, "residue").filter("residue").select("src_table", "id").distinct()


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d, "text", "marks", "kinds", "notes")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_bodies(read_table(spark, d, "entities"), read_table(spark, d, "size_limits"), current_rows)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).filter(F.col("n_pieces") > 1).select("id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    one = _pieces(spark, d).select("id", F.explode("pieces").alias("p"))
    return one.select("id", "p.piece_no", "p.start", "p.end", "p.piece")


def p3_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The pieces put together again: the body, whether all are within the limit, and whether each repeats what it should."""
    whole = _pieces(spark, d).select("id", "max_chars", "overlap_chars", F.explode("pieces").alias("p")).select("id", "max_chars", "overlap_chars", "p.*")
    order = Window.partitionBy("id").orderBy("piece_no")
    end = F.coalesce(F.lag("end").over(order), F.lit(0))
    fresh = F.substring("piece", (end - F.col("start") + 1).cast("int"), F.length("piece"))
    shared = F.coalesce(F.lag("piece").over(order), F.lit(""))
    repeats = (F.col("piece_no") == 0) | ((end - F.col("start") == F.col("overlap_chars")) & F.endswith(shared, F.left("piece", end - F.col("start"))))
    parts = whole.select("id", "piece_no", fresh.alias("fresh"), (F.length("piece") <= F.col("max_chars")).alias("within"), repeats.alias("repeats"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "fresh"))), lambda x: x["fresh"]), "")
    return parts.groupBy("id").agg(F.md5(text).alias("body"), F.every("within").alias("within"), F.every("repeats").alias("repeats"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    tables = read_table(spark, d, "entities"), read_table(spark, d, "terms")
    return distinctive.distinctive_terms(*tables, current_rows, materialize)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_records")
    return _scores(spark, d).filter((n >= 2) & (n <= 12) & (F.col("n_in_body") >= 3)).select("entity_id", "term")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).withColumn("score", F.round("score", 9))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    marked = frequency.term_frequencies(read_table(spark, d, "terms"))
    return marked.filter(F.col("mark").isNotNull()).select("term", "mark")


def p5_frequency(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(read_table(spark, d, "terms"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(read_table(spark, d, "documents"), materialize)


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each document as text again."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        enc = encode.encoder(encode.TOKENIZER, encode.LEAF_CHARS)
        return pd.Series([b"".join(enc.bytes[i] for i in x).decode() for x in ids], dtype=object)

    return p8_ids(spark, d).select("doc_id", F.md5(text("ids")).alias("text"))


def encode_cases(spark: SparkSession, d: str) -> DataFrame:
    """Fixed texts, cut into leaves of three characters."""
    docs = spark.createDataFrame([(i, x[0]) for i, x in enumerate(_ENCODED)], "doc_id bigint, text string")
    return encode.encode_corpus(docs, materialize, leaf_chars=3).select("doc_id", F.array_join("ids", " ").alias("ids"))


def markup_cases(spark: SparkSession, d: str) -> DataFrame:
    """Fixed bodies of each kind of markup."""
    bodies = spark.createDataFrame([(f"{i:02d}", x[0]) for i, x in enumerate(_MARKED)], "id string, body string")
    none = bodies.limit(0)
    return markup.clean_bodies(none.withColumn("updated_at", F.lit("x")), bodies, current_rows, ("text", "residue")).select("id", "text", "residue")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"), materialize)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(spans.shared_classes(read_table(spark, d, "documents"), materialize))


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    shares = spans.shared_shares(read_table(spark, d, "documents"), materialize)
    return shares.select("doc_id", "n_chars", "shared_chars", F.round("share", 9).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_clean, p3_found, p3_pieces, p4_found, p4_scores, p5_found, p5_frequency, p8_ids, p9_found, p9_items, p10_found, p10_share, p3_roundtrip, p8_roundtrip, markup_cases, encode_cases)
}

def _values(rows: list[tuple], columns: str) -> str:
    def cell(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


_SPACES = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TERMS = rf"""
pairs AS (
  SELECT lower(trim(regexp_replace(term, '{_SPACES}+', ' ', 'g'))) AS term,
    nullif(entity_id, '') AS entity_id FROM terms),
counts AS (
  SELECT term, count(*) AS n_rows, count(DISTINCT entity_id) AS n_records FROM pairs WHERE term <> '' GROUP BY term),
marked AS (
  SELECT *, CASE WHEN n_records > 0.2 * (SELECT count(DISTINCT nullif(entity_id, '')) FROM terms) THEN 'common'
                 WHEN n_records = 1 THEN 'rare' END AS mark FROM counts)
"""

_GRAMS = """
words AS (SELECT kind, id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items)),
grams AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 11], ' ') AS g
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 10)) AS i FROM words WHERE len(w) >= 12)),
found AS (
  SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM grams d JOIN grams i ON d.g = i.g WHERE d.kind = 'd' AND i.kind = 'i')
""".replace("\\\\", "\\")

_WINDOWS = """
windows AS (
  SELECT doc_id, i, md5(substring(text, i, 300)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
repeated AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) <> max(doc_id)),
shared AS (SELECT w.* FROM windows w SEMI JOIN repeated r ON w.h = r.h)
"""

# RE2 has no look-around: every character that is no word character is doubled, so that each hit can take one at either end.
_COUNTS = rf"""{_TERMS},
        cur AS (SELECT id, body FROM entities WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
        plain AS (SELECT id, lower(regexp_replace(coalesce(body, ''), '{_SPACES}+', ' ', 'g')) AS s FROM cur),
        texts AS (SELECT id, s, regexp_replace(s, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') AS t FROM plain),
        listed AS (SELECT DISTINCT term, entity_id FROM pairs WHERE term <> '' AND entity_id IS NOT NULL),
        known AS (
          SELECT term, count(*) AS n_records,
            '(?:^|[^\p{{L}}\p{{N}}_])' || regexp_escape(regexp_replace(term, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')) || '(?:$|[^\p{{L}}\p{{N}}_])' AS rx
          FROM listed GROUP BY term)"""

ORACLE_SQL = {
    "markup_cases": _values([(f"{i:02d}", *x[1:]) for i, x in enumerate(_MARKED)], "id, text, residue"),
    "encode_cases": _values([(i, x[1]) for i, x in enumerate(_ENCODED)], "doc_id, ids"),
    "p3_roundtrip": """WITH cur AS (SELECT id, type, body FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)
        SELECT id, md5(body) AS body, true AS within, true AS repeats FROM cur WHERE id IS NOT NULL AND body IS NOT NULL""",
    "p8_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents",
    "p3_found": """WITH cur AS (
          SELECT id, type, body FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)
        SELECT id FROM cur LEFT JOIN (SELECT * FROM size_limits WHERE type <> '*') s ON s.type = cur.type
        WHERE length(body) > coalesce(s.max_chars, (SELECT max_chars FROM size_limits WHERE type = '*'))""",
    "p4_found": f"""WITH {_COUNTS}
        SELECT entity_id, term FROM listed JOIN known USING (term) JOIN texts ON texts.id = entity_id
        WHERE n_records BETWEEN 2 AND 12 AND len(regexp_extract_all(t, rx)) >= 3""",
    "p4_scores": rf"""WITH {_COUNTS},
        cells AS (SELECT id, term, len(regexp_extract_all(t, rx)) AS n FROM texts JOIN known ON contains(s, term)),
        cols AS (SELECT term, sum(n)::BIGINT AS column_n FROM cells GROUP BY term),
        margins AS (SELECT id, len(regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+')) AS row_n FROM texts),
        numbers AS (
          SELECT entity_id, term, n_records, coalesce(n, 0) AS n, coalesce(column_n, 0) AS c, row_n AS r, (SELECT sum(row_n)::DOUBLE FROM margins) AS z
          FROM listed JOIN known USING (term) JOIN margins ON margins.id = entity_id LEFT JOIN cols USING (term)
          LEFT JOIN cells ON cells.id = entity_id AND cells.term = listed.term),
        spread AS (SELECT *, r * c / z AS e, (r * c / z) * (1 - r / z) * (1 - c / z) AS v FROM numbers)
        SELECT entity_id, term, n_records, n AS n_in_body, c AS n_in_all, round(CASE WHEN v > 0 THEN (n - e) / sqrt(v) ELSE 0.0 END, 9) AS score FROM spread""",
    "p5_found": f"WITH {_TERMS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p5_frequency": f"WITH {_TERMS} SELECT term, n_rows, n_records, mark FROM marked",
    "p9_found": f"WITH {_GRAMS} SELECT doc_id, item_id FROM found",
    "p9_items": f"WITH {_GRAMS} SELECT item_id, count(*) AS n_documents FROM found GROUP BY item_id",
    "p10_found": f"""WITH {_WINDOWS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b
        FROM shared a JOIN shared b ON a.h = b.h WHERE a.doc_id < b.doc_id""",
    "p10_share": f"""WITH {_WINDOWS},
        steps AS (SELECT doc_id, i, lead(i, 1, i + 300) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM shared),
        covered AS (SELECT doc_id, sum(least(nxt - i, 300))::BIGINT AS n FROM steps GROUP BY doc_id)
        SELECT d.doc_id, length(text) AS n_chars, coalesce(c.n, 0) AS shared_chars,
          round(CASE WHEN length(text) = 0 THEN 0.0 ELSE coalesce(c.n, 0) / length(text) END, 9) AS share
        FROM documents d LEFT JOIN covered c ON c.doc_id = d.doc_id""",
}
