"""Functions of strings, numbers, arrays, maps and records, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphlake.functions import text as T
from glyphlake.queries.book import Book, Columns, table

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle
PK_SQL = "CAST(p_partkey AS VARCHAR)"
NAME_SQL = f"(p_name || ' ' || {PK_SQL})"
DOC = "CAST(p_partkey AS BIGINT) AS doc_id"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def on_documents(name: str, sql: str, columns: Columns) -> None:
    BOOK.column(name, "documents", lambda: {"doc_id": F.col("doc_id"), **columns()}, f"SELECT doc_id, {sql} FROM documents")


def on_parts(name: str, sql: str, columns: Columns) -> None:
    BOOK.column(name, "part", lambda: {"doc_id": key(), **columns()}, f"SELECT {DOC}, {sql} FROM part")


def text() -> Column:
    return F.col("text")


def key() -> Column:
    return F.col("p_partkey").cast("long")


def pk() -> Column:
    return F.col("p_partkey").cast("string")


def name() -> Column:
    return F.concat_ws(" ", "p_name", pk())


def blanks() -> Column:
    return (F.col("p_partkey") % 4).cast("int")


def words() -> Column:
    return F.split(F.concat("p_name", F.lit(" of "), "p_type"), " ")


_TAIL = "(coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN '?!..' WHEN 1 THEN ' ,;' ELSE '' END)"
on_documents("str03_trim_punctuation", f"md5(regexp_replace({_TAIL}, '[.,;:!?]+$', '')) AS digest", lambda: dict(digest=F.md5(T.trim_punctuation(F.expr(_TAIL)))))
on_documents("str04_ascii_lower", f"md5(translate(text, '{UP}', '{LOW}')) AS digest, translate(text, '{UP}', '{LOW}') = translate(lang, '{UP}', '{LOW}') AS same", lambda: dict(digest=F.md5(T.ascii_lower(text())), same=T.same_ignoring_case(text(), F.col("lang"))))
on_parts("str05_unicode_lower", f"'äöü ' || lower({NAME_SQL}) AS folded", lambda: dict(folded=F.lower(F.concat(F.lit("ÄÖÜ "), name()))))
on_parts("str06_collapse", f"'a b c ' || {PK_SQL} AS text", lambda: dict(text=T.collapse(F.concat(F.lit("  a \t\n b c  "), pk(), F.lit(" \n")))))
on_parts("str07_first_word", "'rust' AS language", lambda: dict(language=T.first_word(F.concat(F.lit("rust"), F.element_at(F.array(F.lit(","), F.lit(" "), F.lit("\t")), (F.col("p_partkey") % 3 + 1).cast("int")), name()))))
on_parts("str08_counts_at_ends", "CAST(p_partkey % 4 AS INTEGER) AS trailing, CAST(1 + p_partkey % 4 AS INTEGER) AS hashes, CAST(p_partkey % 4 AS INTEGER) AS leading",
         lambda: dict(trailing=T.count_at_end(F.concat(name(), F.repeat(F.lit("\t"), blanks())), r"[ \t]"), hashes=T.count_at_start(F.concat(F.repeat(F.lit("#"), blanks() + 1), F.lit(" x")), "#"), leading=T.count_at_start(F.concat(F.repeat(F.lit(" "), blanks()), F.lit("x")), " ")))
on_parts("str09_trailing_newlines", "CAST(p_partkey % 4 AS INTEGER) AS n", lambda: dict(n=T.trailing_newlines(F.concat(name(), F.repeat(F.lit("\n"), blanks()), F.lit(" \t")))))
on_documents("str10_replace_all", r"md5(replace(regexp_replace(text, '([a-z])e', '<\1>', 'g'), 'the', 'THE')) AS digest", lambda: dict(digest=F.md5(F.replace(F.regexp_replace(text(), "([a-z])e", "<$1>"), F.lit("the"), F.lit("THE")))))
on_parts("str11_byte_slices", f"substring({PK_SQL}, 1, 1) AS piece, 195 AS lead, FALSE AS inside, TRUE AS at_start", lambda: dict(piece=T.bytes_of(F.concat(F.lit("é"), pk()), F.lit(2), F.lit(3)), lead=T.byte_at(F.lit("é"), F.lit(0)), inside=T.is_char_boundary(F.concat(F.lit("é"), pk()), F.lit(1)), at_start=T.is_char_boundary(F.concat(F.lit("é"), pk()), F.lit(2))))
on_parts("str12_range_replace", f"'é[' || {PK_SQL} || ']c' AS text", lambda: dict(text=T.replace_range(F.lit("ébc"), F.lit(2), F.lit(3), F.concat(F.lit("["), pk(), F.lit("]")))))
on_parts("str14_pad", f"rpad({PK_SQL}, 8, ' ') AS r, lpad({PK_SQL}, 8, '.') AS l, repeat(' ', CAST((9 - length({PK_SQL})) // 2 AS BIGINT)) || {PK_SQL} || repeat(' ', CAST(9 - length({PK_SQL}) - (9 - length({PK_SQL})) // 2 AS BIGINT)) AS c, repeat('-', CAST(length({PK_SQL}) AS BIGINT)) AS bar",
         lambda: dict(r=F.rpad(pk(), 8, " "), l=F.lpad(pk(), 8, "."), c=T.centred(pk(), F.lit(9)), bar=F.repeat(F.lit("-"), F.length(pk()))))
on_documents("str15_codepoints", "CAST(length(text) AS BIGINT) AS n, CAST(strlen(text) AS BIGINT) AS bytes", lambda: dict(n=F.length(text()).cast("long"), bytes=F.octet_length(text()).cast("long")))
on_documents("str16_json_escape", "md5(CAST(to_json(text) AS VARCHAR)) AS digest", lambda: dict(digest=F.md5(T.json_string(text()))))
on_documents("str17_one_line", "md5(replace(text, chr(10), chr(92) || 'n')) AS digest", lambda: dict(digest=F.md5(T.one_line(text()))))
on_parts("str18_rule_url", f"'https://lint.example/rules/' || replace(p_name, ' ', '-') || '.html' AS url", lambda: dict(url=T.rule_url("https://lint.example/", F.replace("p_name", F.lit(" "), F.lit("-")))))
on_parts("str19_markers", f"'<!-- lint: allow ' || replace(p_name, ' ', '-') || ' -->' AS marker, CASE WHEN p_partkey % 2 = 0 THEN 'advisory' ELSE 'warning' END AS severity", lambda: dict(marker=T.suppress_marker(F.replace("p_name", F.lit(" "), F.lit("-"))), severity=T.severity(F.col("p_partkey") % 2 == 0)))
on_parts("str21_line_ranges", f"CAST(p_partkey AS INTEGER) AS line, 2 AS col, CAST(p_partkey + 3 AS INTEGER) AS end_line, 4 AS end_col, p_partkey % 5 <> 0 AS valid", lambda: dict(**{
    n: F.coalesce(T.line_range(F.when(F.col("p_partkey") % 5 == 0, F.concat(pk(), F.lit(":2"))).otherwise(F.concat(pk(), F.lit(":2-"), (F.col("p_partkey") + 3).cast("string"), F.lit(":4"))))[n], d)
    for n, d in (("line", F.col("p_partkey").cast("int")), ("col", F.lit(2)), ("end_line", (F.col("p_partkey") + 3).cast("int")), ("end_col", F.lit(4)))
}, valid=T.line_range(F.when(F.col("p_partkey") % 5 == 0, F.concat(pk(), F.lit(":2"))).otherwise(F.concat(pk(), F.lit(":2-3:4")))).isNotNull()))


def suffix() -> Column:
    return F.element_at(F.array(*map(F.lit, ("s of", "'s", "sx", "ing"))), (F.col("p_partkey") % 4 + 1).cast("int"))


on_parts("str22_plain_suffix", "p_partkey % 4 < 2 AS plain", lambda: dict(plain=T.is_plain_suffix(suffix())))
on_parts("str23_href", f"'/a%20b/' || {PK_SQL} || '?x=1&amp;y=%C3%A9&#x27;' AS href", lambda: dict(href=T.percent_encode(F.concat(F.lit("/a b/"), pk(), F.lit("?x=1&y=é'")))))

_A, _B = "CAST(p_partkey % 50 AS INTEGER)", "CAST(p_size AS INTEGER)"
on_parts("num01_saturating", f"greatest({_A} - {_B}, 0) AS less, least({_A} + {_B}, 60) AS more, least(greatest({_A}, 10), 20) AS clamped, least({_A}, {_B}) AS low, greatest({_A}, {_B}) AS high",
         lambda: dict(less=T.saturating_sub(F.expr(_A), F.expr(_B)), more=F.least(F.expr(f"{_A} + {_B}"), F.lit(60)), clamped=T.clamped(F.expr(_A), 10, 20), low=F.least(F.expr(_A), F.expr(_B)), high=F.greatest(F.expr(_A), F.expr(_B))))
on_parts("num02_parse_marker", "CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE CAST(p_partkey AS BIGINT) END AS n", lambda: dict(n=F.coalesce(T.marker_number(F.when(F.col("p_partkey") % 3 == 0, F.lit("x.")).otherwise(F.concat(pk(), F.lit(")")))), F.lit(-1))))
on_parts("num03_bit_masks", "(p_partkey & 5) = 5 AS has_both, CAST(p_partkey | 8 AS BIGINT) AS with_eight, (p_partkey & 6) <> 0 AS has_any", lambda: dict(has_both=T.has_all(F.col("p_partkey"), 5), with_eight=F.col("p_partkey").bitwiseOR(F.lit(8)).cast("long"), has_any=F.col("p_partkey").bitwiseAND(F.lit(6)) != 0))
on_parts("num04_parity", "p_partkey % 2 = 1 AS odd, CAST(p_size // 2 AS INTEGER) AS half", lambda: dict(odd=F.col("p_partkey") % 2 == 1, half=F.expr("cast(p_size div 2 as int)")))

on_parts("arr01_array_shapes", "string_split(p_name || ' of ' || p_type, ' ')[2] AS second, list_reverse(string_split(p_name || ' of ' || p_type, ' '))[1] AS last, array_to_string(string_split(p_name || ' of ' || p_type, ' ')[1:len(string_split(p_name || ' of ' || p_type, ' '))-1], ' ') AS front, CAST(len(string_split(p_name || ' of ' || p_type, ' ')) - 1 AS INTEGER) AS pairs, string_split(p_name || ' of ' || p_type, ' ')[1] || '>' || string_split(p_name || ' of ' || p_type, ' ')[2] AS first_pair",
         lambda: dict(second=F.slice(words(), F.lit(2), F.size(words()))[0], last=F.reverse(words())[0], front=F.array_join(F.slice(words(), F.lit(1), F.size(words()) - 1), " "), pairs=F.size(T.windows(words())), first_pair=F.concat_ws(">", T.windows(words())[0]["a"], T.windows(words())[0]["b"])))
on_parts("arr02_quantifiers", "list_contains(string_split(p_name || ' of ' || p_type, ' '), 'of') AS any_of, len(list_filter(string_split(p_name || ' of ' || p_type, ' '), lambda w: length(w) < 3)) = 0 AS all_long, CAST(coalesce(list_position(string_split(p_name || ' of ' || p_type, ' '), 'of'), 0) AS BIGINT) AS at, coalesce(list_filter(string_split(p_name || ' of ' || p_type, ' '), lambda w: length(w) > 5)[1], '') AS first_long",
         lambda: dict(any_of=F.exists(words(), lambda w: w == "of"), all_long=F.forall(words(), lambda w: F.length(w) >= 3), at=F.array_position(words(), F.lit("of")).cast("long"), first_long=F.coalesce(F.try_element_at(F.filter(words(), lambda w: F.length(w) > 5), F.lit(1)), F.lit(""))))
on_parts("arr03_partition_point", "CAST(CASE WHEN p_partkey % 100 < 3 THEN 0 WHEN p_partkey % 100 < 17 THEN 1 WHEN p_partkey % 100 < 40 THEN 2 WHEN p_partkey % 100 < 41 THEN 3 WHEN p_partkey % 100 < 90 THEN 4 ELSE 5 END AS INTEGER) AS at", lambda: dict(at=T.partition_point(F.array(*[F.lit(x) for x in (3, 17, 40, 41, 90)]), (F.col("p_partkey") % 100).cast("int"))))


@BOOK.add("map01_map_steps", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'kept' ELSE 'new' END AS a, p_name AS b, FALSE AS has_c, 2 AS size FROM part")
def map01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert if absent, get, remove: on a map column."""
    start = F.create_map(F.lit("c"), F.lit("gone"), F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b"), F.when(F.col("p_partkey") % 2 == 0, "kept").otherwise(F.col("p_name")))
    m = T.removed(T.inserted(T.inserted(start, "a", F.lit("new")), "b", F.col("p_name")), "c")
    rows = table(spark, sf_dir, "part").select(key().alias("doc_id"), m.alias("m"))
    return rows.select("doc_id", F.element_at("m", "a").alias("a"), F.element_at("m", "b").alias("b"), F.map_contains_key("m", "c").alias("has_c"), F.size("m").alias("size"))


@BOOK.add("jsn01_records", """SELECT CAST(p_partkey AS BIGINT) AS doc_id, '{"rule":{"name":"r","ord":' || CAST(p_partkey AS VARCHAR) || '},"tags":["a","' || p_brand || '"]' || CASE WHEN p_partkey % 2 = 0 THEN ',"fix":{"safe":true}' ELSE '' END || '}' AS value FROM part""")
def jsn01(spark: SparkSession, sf_dir: str) -> DataFrame:
    fix = F.when(F.col("p_partkey") % 2 == 0, F.struct(F.lit(True).alias("safe")))
    record = F.struct(F.struct(F.lit("r").alias("name"), F.col("p_partkey").cast("long").alias("ord")).alias("rule"), F.array(F.lit("a"), "p_brand").alias("tags"), fix.alias("fix"))
    return table(spark, sf_dir, "part").select(key().alias("doc_id"), F.to_json(record).alias("value"))
