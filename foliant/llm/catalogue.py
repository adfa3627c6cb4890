"""The training-data queries, with their production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import boilerplate, language, languages_sql, leakage, lookalike, mixing, neardup, records
from foliant.plans.skew import union_all
from foliant.sources.tables import table

# Kinds of extracted records: table, id, compared columns, and columns that list alternates.
RECORDS = {
    "register": ("registers", "reg_id", ["doc_id", "name", "address", "width_bits", "description", "fields"], {}),
    "bitfield": ("bit_fields", "field_id", ["doc_id", "register_name", "name", "bit_range", "access", "reset_value", "description"], {}),
    "pin": ("pins", "pin_id", ["doc_id", "pin_name", "signal_name", "direction", "description"], {"signal_name": "[/|;,]"}),
}


def _records(spark: SparkSession, folder: str) -> records.Collapsed:
    parts = [
        records.digested(table(spark, folder, name), record, columns, exact={"doc_id"}, delimited=delimited).withColumn("kind", F.lit(kind))
        for kind, (name, record, columns, delimited) in RECORDS.items()
    ]
    return records.Collapsed(union_all(parts), ["kind"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).copies().filter("record_id <> first_id").select("kind", "first_id", F.col("record_id").alias("copy_id"))


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record, with the number of its copies."""
    return _records(spark, folder).firsts()


def _pictures(spark: SparkSession, folder: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(table(spark, folder, "images"), "image_id", "image_sha256", "perceptual_hash")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pictures(spark, folder).pairs().select(F.col("a").alias("image_id_a"), F.col("b").alias("image_id_b"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each picture: its group and the number of pictures it is linked to."""
    return _pictures(spark, folder).groups().withColumnRenamed("item", "image_id")


def _lines(spark: SparkSession, folder: str) -> boilerplate.RepeatedLines:
    return boilerplate.RepeatedLines(table(spark, folder, "chunks"), "seq", "doc_id", "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).occurrences().select(F.col("item").alias("seq"), "line_no")


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk's text without the repeated lines."""
    return _lines(spark, folder).cleaned().withColumnRenamed("item", "seq")


def p4_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The longest repeated blocks."""
    return _lines(spark, folder).blocks().withColumnRenamed("item", "seq")


_TEXTS = {"chunk": ("chunks", "seq", "text"), "image": ("images", "image_id", "extracted_text")}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [lookalike.look_alike_pairs(table(spark, folder, name), item, text).select(F.lit(origin).alias("origin"), F.col("a").alias("id_a"), F.col("b").alias("id_b")) for origin, (name, item, text) in _TEXTS.items()]
    return union_all(parts)


def p5_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its one consistent form."""
    return union_all([lookalike.consistent(table(spark, folder, name), item, text).withColumn("origin", F.lit(origin)) for origin, (name, item, text) in _TEXTS.items()])


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).filter("distance = 0").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Also passages with one or two edited words, and how many windows agree."""
    return _leaks(spark, folder)


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture, how often each is used, and its tokens in one use."""
    return _mixture(spark, folder).selection()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixture(spark, folder).shares()


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source's cap and share are kept."""
    return _mixture(spark, folder).checks()


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(table(spark, folder, "documents"), "doc_id", "text", "lang")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _languages(spark, folder)
    return rows.filter("(line_no = 0 AND NOT label_ok) OR (line_no > 0 AND mixed)").select("doc_id", "line_no", "lang")


def p8_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of each document, and of each line of a mixed one."""
    return _languages(spark, folder).filter("line_no = 0 OR mixed").select("doc_id", "line_no", "lang", "confidence")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_records, p2_found, p2_groups, p4_found, p4_clean, p4_blocks, p5_found, p5_consistent, p6_found, p6_leaks, p7_selection, p7_shares, p7_checks, p8_found, p8_languages]
    return {f.__name__: f for f in own}


_NORM = r"upper(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def _n(c: str) -> str:
    return _NORM.format(c)


def _groups_sql() -> str:
    field = "CASE WHEN f IS NULL THEN '~' ELSE concat_ws(',', " + ", ".join(f"coalesce('t' || {_n('f.' + x)}, '~')" for x in ("name", "bit_range", "access", "reset_value", "description")) + ") END"
    fields = f"CAST(list_sort(list_distinct(list_transform(fields, lambda f: {field}))) AS VARCHAR)"
    signals = f"CAST(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(signal_name, '[/|;,]'), lambda s: {_n('s')}), lambda s: s <> ''))) AS VARCHAR)"
    reg = f"SELECT DISTINCT 'register' AS kind, reg_id AS id, doc_id AS c0, {_n('name')} AS c1, {_n('address')} AS c2, CAST(width_bits AS VARCHAR) AS c3, {_n('description')} AS c4, {fields} AS c5, CAST(NULL AS VARCHAR) AS c6 FROM registers"
    bit = "SELECT DISTINCT 'bitfield', field_id, doc_id, " + ", ".join(_n(x) for x in ("register_name", "name", "bit_range", "access", "reset_value", "description")) + " FROM bit_fields"
    pin = f"SELECT DISTINCT 'pin', pin_id, doc_id, {_n('pin_name')}, {signals}, {_n('direction')}, {_n('description')}, NULL, NULL FROM pins"
    return f"WITH r AS ({reg} UNION ALL {bit} UNION ALL {pin}), g AS (SELECT *, min(id) OVER w AS first_id, count(*) OVER w AS copies FROM r WINDOW w AS (PARTITION BY kind, c0, c1, c2, c3, c4, c5, c6))"


def _looks_sql() -> str:
    """Every text with its skeleton, character by character; marks are taken in the order they stand in."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table_ = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in lookalike.skeletons_of_characters().items())
    return rf"""m(ch, sk) AS (VALUES {table_}),
        t AS (SELECT DISTINCT 'chunk' AS origin, seq AS id, text FROM chunks UNION SELECT DISTINCT 'image', image_id, extracted_text FROM images),
        c AS (SELECT origin, id, text, unnest(string_split(text, '')) AS ch, unnest(range(len(string_split(text, '')))) AS pos FROM t WHERE regexp_matches(text, '[^\x00-\x08\x0A-\x7F]')),
        s AS (SELECT origin, id, text, string_agg(coalesce(sk, ch), '' ORDER BY pos) AS look FROM c LEFT JOIN m USING (ch) GROUP BY ALL
            UNION ALL SELECT origin, id, text, text FROM t WHERE NOT regexp_matches(text, '[^\x00-\x08\x0A-\x7F]'))"""


def oracle_sql() -> dict[str, str]:
    latin, cyrillic = ("".join(map(chr, lookalike.cyrillic_letters())), "".join(lookalike.cyrillic_letters().values()))
    pictures = """i AS (SELECT DISTINCT image_id, lower(image_sha256) AS sha, CASE WHEN regexp_full_match(perceptual_hash, '[0-9a-fA-F]{16}') THEN CAST('0x' || perceptual_hash AS UBIGINT) END AS h FROM images),
            p AS (SELECT DISTINCT a.image_id AS a, b.image_id AS b FROM i a JOIN i b ON a.image_id <> b.image_id WHERE (a.sha = b.sha AND a.sha <> '') OR bit_count(xor(a.h, b.h)) <= 3)"""
    line = r"upper(trim(regexp_replace(regexp_replace(line, '[\s\p{Z}]+', ' ', 'g'), '\p{Nd}+', '0', 'g')))"
    return {
        "p1_found": _groups_sql() + " SELECT DISTINCT kind, first_id, id AS copy_id FROM g WHERE id <> first_id",
        "p1_records": _groups_sql() + " SELECT DISTINCT kind, first_id, copies FROM g WHERE id = first_id",
        "p2_found": f"WITH {pictures} SELECT a AS image_id_a, b AS image_id_b FROM p WHERE a < b",
        "p2_groups": f"""WITH RECURSIVE {pictures}, r AS (SELECT DISTINCT image_id AS v, image_id AS w FROM i WHERE image_id IS NOT NULL UNION SELECT r.v, p.b FROM r JOIN p ON p.a = r.w)
            SELECT v AS image_id, min(w) AS group_id, (SELECT count(*) FROM p WHERE p.a = r.v) AS links FROM r GROUP BY v""",
        "p4_found": rf"""
            WITH c AS (SELECT DISTINCT seq, doc_id, text FROM chunks WHERE text IS NOT NULL AND doc_id IS NOT NULL),
            l AS (SELECT seq, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM c),
            n AS (SELECT seq, doc_id, line_no, {line} AS line FROM l),
            k AS (SELECT doc_id, line FROM n WHERE line <> '' GROUP BY doc_id, line HAVING count(DISTINCT seq) >= 8)
            SELECT DISTINCT seq, line_no FROM n JOIN k USING (doc_id, line)""",
        "p4_clean": rf"""
            WITH c AS (SELECT DISTINCT seq, doc_id, text FROM chunks WHERE seq IS NOT NULL),
            l AS (SELECT seq, doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM c WHERE text IS NOT NULL),
            n AS (SELECT seq, doc_id, line_no, raw, {line.replace('line,', 'raw,', 1)} AS line FROM l),
            k AS (SELECT doc_id, line, 1 AS gone FROM n WHERE line <> '' AND doc_id IS NOT NULL GROUP BY doc_id, line HAVING count(DISTINCT seq) >= 8),
            t AS (SELECT seq, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (gone IS NULL), '') AS text, count(gone) AS removed FROM n LEFT JOIN k USING (doc_id, line) GROUP BY seq)
            SELECT c.seq, CASE WHEN c.text IS NOT NULL THEN coalesce(t.text, '') END AS text, coalesce(removed, 0) AS removed FROM c LEFT JOIN t USING (seq)""",
        "p4_blocks": rf"""
            WITH c AS (SELECT DISTINCT seq, doc_id, text FROM chunks WHERE text IS NOT NULL AND doc_id IS NOT NULL AND seq IS NOT NULL),
            l AS (SELECT seq, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM c),
            n AS (SELECT seq, doc_id, line_no, {line} AS line FROM l),
            a AS (SELECT seq, doc_id, list(line ORDER BY line_no) AS ls, list(line_no ORDER BY line_no) AS nos FROM n WHERE line <> '' GROUP BY seq, doc_id),
            s AS (SELECT *, unnest(range(1, len(ls) + 1)) AS pos FROM a),
            b AS (SELECT seq, doc_id, nos[pos] AS line_no, pos, unnest(range(1, len(ls) - pos + 2)) AS lines, ls FROM s),
            g AS (SELECT seq, doc_id, line_no, pos, lines, array_to_string(list_slice(ls, pos, pos + lines - 1), chr(10)) AS block FROM b),
            k AS (SELECT doc_id, block, count(DISTINCT seq) AS documents FROM g GROUP BY ALL HAVING documents >= 8),
            m AS (SELECT seq, line_no, pos, max(lines) AS lines, arg_max(documents, lines) AS documents FROM g JOIN k USING (doc_id, block) GROUP BY ALL),
            w AS (SELECT *, max(pos + lines) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM m)
            SELECT seq, line_no, CAST(lines AS INT) AS lines, documents FROM w WHERE covered IS NULL OR covered < pos + lines""",
        "p5_found": f"WITH {_looks_sql()} SELECT DISTINCT a.origin, a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.origin = b.origin AND a.look = b.look AND a.text <> b.text AND a.id < b.id",
        "p5_consistent": rf"""WITH {_looks_sql()},
            w AS (SELECT origin, id, nfc_normalize(array_to_string(list_transform(regexp_extract_all(look, '[\p{{L}}]+|[^\p{{L}}]+'), lambda x: CASE WHEN regexp_matches(x, '[\x{{0400}}-\x{{04FF}}]') THEN translate(x, '{latin}', '{cyrillic}') ELSE x END), '')) AS text FROM s)
            SELECT origin, id AS item, text FROM w UNION SELECT origin, id, NULL FROM t WHERE text IS NULL""",
        "p7_checks": """
            WITH w AS (SELECT source, sum(weight) AS weight, min(max_repeats) AS max_repeats FROM mix_targets WHERE source IS NOT NULL AND weight > 0 AND max_repeats > 0 GROUP BY source),
            d AS (SELECT source, count(DISTINCT doc_id) AS documents, max(length(text)) > 0 AS has_text FROM documents GROUP BY source)
            SELECT source, round(weight / sum(weight) OVER (), 6) AS weight, max_repeats, coalesce(documents, 0) AS documents, true AS cap_kept, coalesce(has_text, false) AS share_kept FROM w LEFT JOIN d USING (source)""",
        "p8_found": languages_sql.sql(),
        "p6_found": r"""
            WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
            i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
            dw AS (SELECT id, array_to_string(list_slice(w, k, k + 11), ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
            iw AS (SELECT id, array_to_string(list_slice(w, k, k + 11), ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
            SELECT DISTINCT dw.id AS doc_id, iw.id AS item_id FROM dw JOIN iw USING (s)""",
        "p6_leaks": r"""
            WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
            i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
            v AS (SELECT word, chr(CAST(19968 + row_number() OVER (ORDER BY word) AS INT)) AS c FROM (SELECT DISTINCT unnest(w) AS word FROM i)),
            ds AS (SELECT id, string_agg(coalesce(c, '.'), '' ORDER BY pos) AS s FROM (SELECT id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) LEFT JOIN v USING (word) GROUP BY id),
            si AS (SELECT id, string_agg(c, '' ORDER BY pos) AS s FROM (SELECT id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM i) JOIN v USING (word) GROUP BY id),
            dg AS (SELECT id, s, p, substr(s, p, 4) AS g FROM (SELECT id, s, unnest(range(1, length(s) - 2)) AS p FROM ds)),
            ig AS (SELECT id, s, p, substr(s, p, 4) AS g FROM (SELECT id, s, unnest(range(1, length(s) - 2)) AS p FROM si)),
            m AS (SELECT dg.id AS doc_id, ig.id AS item_id, dg.s AS ds, ig.s AS si, dg.p AS dp, ig.p AS ip FROM dg JOIN ig USING (g)),
            w AS (SELECT DISTINCT doc_id, item_id, ds, si, dp - o - h AS a, ip - o AS b FROM m, (SELECT unnest([0, 4, 8]) AS o), (SELECT unnest([-2, -1, 0, 1, 2]) AS h)),
            z AS (SELECT doc_id, item_id, string_split(substr(ds, a, 12), '') AS x, string_split(substr(si, b, 12), '') AS y FROM w WHERE a >= 1 AND b >= 1 AND a + 11 <= length(ds) AND b + 11 <= length(si)),
            t AS (SELECT doc_id, item_id, array_to_string(list_transform(x, lambda c: chr(CAST(97 + coalesce(list_position(y, c), 0) AS INT))), '') AS x, array_to_string(list_transform(y, lambda c: chr(CAST(97 + list_position(y, c) AS INT))), '') AS y FROM z),
            l AS (SELECT doc_id, item_id, levenshtein(x, y) AS distance FROM t),
            n AS (SELECT doc_id, item_id, distance, count(*) AS windows FROM l WHERE distance <= 2 GROUP BY ALL)
            SELECT doc_id, item_id, CAST(distance AS INT) AS distance, windows FROM n QUALIFY distance = min(distance) OVER (PARTITION BY doc_id, item_id)""",
    }
