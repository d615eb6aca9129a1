"""Queries on parsed documents, listings of files, replies and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload
from ..functions import text as T
from ..operators import bank, cells, documents, locating, logs, protocol
from .registry import query, table
from .texts import TOKENS

c, lit = F.col, F.lit


def text(x):
    return c(x).cast("string") if isinstance(x, str) else x.cast("string")


# ---- pages and files ---------------------------------------------------------------------------


@query("""WITH p AS (SELECT page_id AS n, page_id % 7 AS k, page_id // 5 AS g, ['january', 'april', 'october'][1 + page_id % 3] AS m, 1940 + page_id % 50 AS y FROM pages),
d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n) - 1 AS pos, count(*) OVER (PARTITION BY g) AS members,
 CASE k WHEN 0 THEN 'https://x.org/files/' || m || '-' || y || '-' || n || '?page=' || n % 9 WHEN 1 THEN 'https://x.org/doc?id=1&pagenum=' || n WHEN 2 THEN 'doc' || n || '?page_id=%20' || n % 5 || '+' WHEN 3 THEN 'no page in this one ' || n WHEN 4 THEN 'page=' || n WHEN 5 THEN 'https://x.org/d' || n || '?page=x&pagenum=3#page=9' ELSE 'July-1970?page=1' END AS doc,
 CASE k WHEN 0 THEN n % 9 WHEN 1 THEN n WHEN 2 THEN n % 5 WHEN 4 THEN n WHEN 5 THEN 3 WHEN 6 THEN 1 END AS page,
 CASE k WHEN 0 THEN 'treasury_bulletin_' || y || '_' || ['01', '04', '10'][1 + n % 3] || '.txt' WHEN 6 THEN 'treasury_bulletin_1970_07.txt' END AS monthly FROM p),
f AS (SELECT *, g % 4 AS files FROM d),
r AS (SELECT g, pos, coalesce(monthly, CASE WHEN pos < files THEN 'f' || pos WHEN files = 1 THEN 'f0' END) AS file, page, doc AS source_doc FROM f WHERE files > 0)
SELECT g, min(pos)::INT AS pos, file, page::INT AS page, source_doc FROM r WHERE file IS NOT NULL AND page IS NOT NULL GROUP BY g, file, page, source_doc""")
def page_references(spark, sf):
    """References that name a month, a page in a field, or nothing; files by month, by place, or the only one."""
    n = c("page_id")
    k, month = n % 7, F.element_at(F.array(lit("january"), lit("april"), lit("october")), (n % 3 + 1).cast("int"))
    doc = (
        F.when(k == 0, F.concat(lit("https://x.org/files/"), month, lit("-"), text(1940 + n % 50), lit("-"), text(n), lit("?page="), text(n % 9)))
        .when(k == 1, F.concat(lit("https://x.org/doc?id=1&pagenum="), text(n)))
        .when(k == 2, F.concat(lit("doc"), text(n), lit("?page_id=%20"), text(n % 5), lit("+")))
        .when(k == 3, F.concat(lit("no page in this one "), text(n)))
        .when(k == 4, F.concat(lit("page="), text(n)))
        .when(k == 5, F.concat(lit("https://x.org/d"), text(n), lit("?page=x&pagenum=3#page=9")))
        .otherwise("July-1970?page=1")
    )
    g = F.floor(n / 5).alias("g")
    held = table(spark, sf, "pages").groupBy(g).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", doc.alias("d")))), lambda s: s["d"]).alias("source_docs"))
    files = F.slice(F.array(*(lit(f"f{i}") for i in range(3))), 1, (c("g") % 4).cast("int"))
    return documents.page_references(held.withColumn("source_files", files), "g")


@query("""WITH n AS (SELECT r_regionkey, r_name, '<td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>' AS h, '| ' || r_name || ' | ' || n_nationkey || ' | ' || n_name || ' |' AS m, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_regionkey, '| Region | Nation\\|&x | Nation\\|&x |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| Region | Key | Name |' || chr(10) || string_agg(m, chr(10) ORDER BY n_nationkey) AS markdown FROM n GROUP BY 1""")
def table_markdown(spark, sf):
    """A table of nations whose region spans its rows and whose head spans columns."""
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"))
    row = F.concat(lit("<td>"), text("n_nationkey"), lit("</td><td>\n "), c("n_name"), lit("</td></tr>"))
    held = j.groupBy("r_regionkey", "r_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("h")))), lambda s: s["h"]).alias("rows"))
    head = '<TABLE><tr><th rowspan="2">Region</th><th colspan="2">Nation|&amp;x</th></tr><tr><td>Key</td><td>Name</td></tr><tr><td></td></tr>'
    first = F.concat(lit('<tr><td rowspan="'), text(F.size("rows")), lit('">'), c("r_name"), lit("</td>"), F.array_join("rows", "<tr>"))
    return held.select("r_regionkey", documents.as_markdown(F.concat(lit(head), first, lit("</table>"))).alias("markdown"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a & b ' || p_name WHEN 1 THEN p_name || chr(10) || chr(10) || 'y' WHEN 2 THEN '' ELSE 'no row ' || p_name END AS text FROM part""")
def element_text(spark, sf):
    k = c("p_partkey") % 4
    content = F.when(k == 0, F.concat(lit(" a &amp; b "), "p_name")).when(k == 1, F.concat("p_name", lit("\r\n\r\n\r\n\r\ny"))).when(k == 3, F.concat(lit("<table><caption>no row</caption> "), "p_name", lit("</table>")))
    return table(spark, sf, "part").select("p_partkey", documents.as_markdown(content).alias("text"))


@query("""WITH a AS (SELECT page_id AS n, page_id % 5 AS k, CASE page_id % 5 WHEN 0 THEN '/r/docs/' || page_id || '.json' WHEN 1 THEN 'x/../1/./' || page_id || '.json' WHEN 2 THEN 'any/where/' || page_id || '.json' WHEN 3 THEN '/etc/' || page_id || '.json' ELSE '../../etc/' || page_id || '.json' END AS asked FROM pages)
SELECT n AS page_id, asked FROM a WHERE n % 2 = 0 AND n % 3 <> 0 AND ((k = 0) OR (k = 1 AND n % 7 = 0) OR k = 2)""")
def path_allow(spark, sf):
    """Paths by themselves, below a root, by base name, and outside; files are absent or not allowed."""
    n = c("page_id")
    k, name = n % 5, F.concat(text(n), lit(".json"))
    asked = F.when(k == 0, F.concat(lit("/r/docs/"), name)).when(k == 1, F.concat(lit("x/../1/./"), name)).when(k == 2, F.concat(lit("any/where/"), name)).when(k == 3, F.concat(lit("/etc/"), name)).otherwise(F.concat(lit("../../etc/"), name))
    p = table(spark, sf, "pages").select("page_id", asked.alias("asked"))
    flat = p.where("page_id % 3 <> 0 AND page_id % 5 IN (0, 2)").select(F.concat(lit("/r/docs/"), name).alias("path"))
    deep = p.where("page_id % 3 <> 0 AND page_id % 7 = 0").select(F.concat(lit("/r/docs/1/"), name).alias("path"))
    other = p.select(F.concat(lit("/etc/"), name).alias("path"))
    files = flat.unionByName(deep.where(~c("path").isin([]))).unionByName(other)
    allow = p.where("page_id % 2 = 0").select(F.explode(F.array(F.concat(lit("/r/docs/"), name), F.concat(lit("/r/./docs/1/"), name), F.concat(lit("/etc/"), name))).alias("path"))
    return documents.allowed(p, ["/r/docs"], files, allow)


@query("""WITH w AS (SELECT c_custkey AS pos, '/d' || c_custkey % 20 AS p, c_custkey % 20 AS k FROM customer), r AS (SELECT pos, CASE WHEN k % 4 = 0 THEN p || '/transformed' WHEN k % 3 = 0 THEN p END AS path FROM w)
SELECT min(pos) AS pos, path FROM r WHERE path IS NOT NULL GROUP BY path""")
def document_roots(spark, sf):
    w = table(spark, sf, "customer").select(c("c_custkey").alias("pos"), F.concat(lit("/d"), text(c("c_custkey") % 20)).alias("path"))
    k = spark.range(20)
    folders = k.where("id % 3 = 0").select(F.concat(lit("/d"), text("id")).alias("path")).unionByName(k.where("id % 4 = 0").select(F.concat(lit("/d"), text("id"), lit("/transformed")).alias("path")))
    return documents.document_roots(w, folders)


@query("""SELECT 'in/f' || p_partkey || CASE p_partkey % 2 WHEN 0 THEN '.txt' ELSE '.json' END AS file, CASE WHEN p_partkey % 3 = 0 THEN '/r0/x/jsons/f' WHEN p_partkey % 5 = 0 THEN '/r0/treasury_bulletins_parsed/jsons/f' ELSE '/r1/jsons/f' END || p_partkey || '.json' AS path
FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0""")
def parsed_files(spark, sf):
    n = c("p_partkey")
    name = F.concat(lit("f"), text(n), lit(".json"))
    p = table(spark, sf, "part")
    wanted = p.select(F.concat(lit("in/f"), text(n), F.when(n % 2 == 0, ".txt").otherwise(".json")).alias("file"))
    at = lambda m, folder: p.where(n % m == 0).select(F.concat(lit(folder), name).alias("path"))
    files = at(7, "/r1/jsons/").unionByName(at(5, "/r0/treasury_bulletins_parsed/jsons/")).unionByName(at(3, "/r0/x/jsons/"))
    return documents.parsed_files(wanted, spark.createDataFrame([(0, "/r0/x"), (1, "/r1")], "pos int, path string"), files)


LISTING_SQL = """l AS (SELECT DISTINCT l_orderkey AS folder, CASE l_linenumber WHEN 1 THEN 'z.json' WHEN 2 THEN 'a.jsonl' WHEN 3 THEN 'data.json' WHEN 4 THEN 'sample_data.jsonl' WHEN 5 THEN 'dataset.json' ELSE 'notes.txt' END AS name FROM lineitem WHERE (l_partkey + l_linenumber) % 3 = 0)"""


@query(f"""WITH {LISTING_SQL}, r AS (SELECT *, CASE name WHEN 'dataset.json' THEN 1 WHEN 'data.json' THEN 2 WHEN 'sample_data.jsonl' THEN 4 WHEN 'notes.txt' THEN NULL ELSE 5 END AS rank FROM l)
SELECT folder, arg_min(name, rank * 100 + ascii(name)) AS name FROM r WHERE rank IS NOT NULL GROUP BY folder""")
def dataset_files(spark, sf):
    k = c("l_linenumber")
    name = F.when(k == 1, "z.json").when(k == 2, "a.jsonl").when(k == 3, "data.json").when(k == 4, "sample_data.jsonl").when(k == 5, "dataset.json").otherwise("notes.txt")
    return locating.dataset_files(table(spark, sf, "lineitem").where("(l_partkey + l_linenumber) % 3 = 0").select(c("l_orderkey").alias("folder"), name.alias("name")).distinct())


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS folder, CASE l_linenumber WHEN 1 THEN '1_in_input.xlsx' WHEN 2 THEN '2_in_input.xlsx' WHEN 3 THEN 'q_init.xlsx' WHEN 4 THEN 'initial.xlsx' WHEN 5 THEN 'Answer.xlsx' WHEN 6 THEN 'book.xlsx' ELSE 'input.xlsx' END AS name, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 7 THEN 4 WHEN 6 THEN 5 END AS rank FROM lineitem WHERE (l_partkey + l_linenumber) % 3 = 0)
SELECT folder, name FROM l WHERE rank IS NOT NULL QUALIFY rank = min(rank) OVER (PARTITION BY folder)""")
def case_files(spark, sf):
    k = c("l_linenumber")
    name = F.when(k == 1, "1_in_input.xlsx").when(k == 2, "2_in_input.xlsx").when(k == 3, "q_init.xlsx").when(k == 4, "initial.xlsx").when(k == 5, "Answer.xlsx").when(k == 6, "book.xlsx").otherwise("input.xlsx")
    return locating.case_files(table(spark, sf, "lineitem").where("(l_partkey + l_linenumber) % 3 = 0").select(c("l_orderkey").alias("folder"), name.alias("name")).distinct(), locating.RUNNER_INPUTS)


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS split, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS pos FROM orders),
u AS (SELECT *, row_number() OVER (ORDER BY CASE split WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, pos) - 1 AS place FROM o WHERE split IN ('P', 'O', 'F'))
SELECT o_orderkey, split, pos, place FROM u WHERE place >= 10 AND place < 600""")
def split_union(spark, sf):
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select("o_orderkey", c("o_orderstatus").alias("split"))
    pos = (F.row_number().over(Window.partitionBy("split").orderBy("o_orderkey")) - 1).cast("long")
    return locating.sliced_splits(o.withColumn("pos", pos), ["P", "O", "F"], 10, 600)


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT 'c' || o_custkey AS path, pos::INT AS pos, o_orderkey AS k FROM o WHERE o_custkey % 4 <> 3""")
def record_lists(spark, sf):
    """Record files that are a list, or have it under one of two names after a value that is no list."""
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(lit('{"k": '), text(k), lit(', "n": {"a": [1]}}'))), ", ").alias("r"))
    k, some = c("o_custkey") % 4, F.concat(lit("["), "r", lit("]"))
    body = F.when(k == 0, some).when(k == 1, F.concat(lit('{"records": 5, "data": '), some, lit("}"))).when(k == 2, F.concat(lit('{"items": '), some, lit("}"))).otherwise('{"other": [{"k": 1}]}')
    found = logs.listed_rows(rows.select(F.concat(lit("c"), text("o_custkey")).alias("path"), body.alias("text")))
    return found.select("path", "pos", F.get_json_object("row", "$.k").cast("long").alias("k"))


# ---- cells -------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 6 AS k, l_orderkey % 999 AS n, l_suppkey % 2 AS d, l_returnflag AS f, l_linestatus AS s, date_diff('day', DATE '1899-12-30', l_shipdate::DATE) AS days, l_partkey % 3 AS h FROM lineitem),
r AS (SELECT *, n * 25 // 2 AS q FROM l)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN d = CASE WHEN n % 2 = 1 THEN q % 2 ELSE 0 END WHEN 1 THEN f = s WHEN 2 THEN d = 0 WHEN 3 THEN false WHEN 4 THEN d = CASE h WHEN 0 THEN 0 WHEN 1 THEN days % 2 ELSE 1 END ELSE d = 0 END AS same FROM r""")
def cell_compare(spark, sf):
    """Numbers halfway between two cents, texts, empty cells, numbers and texts, dates by half days, times."""
    k, n, d = (c("l_orderkey") + c("l_linenumber")) % 6, c("l_orderkey") % 999, c("l_suppkey") % 2
    cents = F.floor(n * 25 / 2) + d
    hour = F.element_at(F.array(lit("05"), lit("12"), lit("19")), (c("l_partkey") % 3 + 1).cast("int"))
    serial = F.datediff(c("l_shipdate").cast("date"), lit("1899-12-30").cast("date"))
    none = cells.cell("text", lit(None))
    a = F.when(k == 0, cells.cell("number", n / 8.0)).when(k == 1, cells.cell("text", c("l_returnflag"))).when(k == 2, none).when(k == 3, cells.cell("number", n)).when(k == 4, cells.cell("datetime", F.concat(c("l_shipdate").cast("date").cast("string"), lit(" "), hour, lit(":00:00")))).otherwise(cells.cell("time", lit("08:15:00")))
    b = F.when(k == 0, cells.cell("text", F.concat(lit(" "), (cents / 100.0).cast("decimal(12,2)").cast("string")))).when(k == 1, cells.cell("text", c("l_linestatus"))).when(k == 2, cells.cell("text", F.when(d == 0, "").otherwise("x"))).when(k == 3, cells.cell("text", lit("n/a"))).when(k == 4, cells.cell("number", serial + d)).otherwise(cells.cell("text", F.when(d == 0, "08:15").otherwise("08:16")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cells.same_cell(a, b).alias("same"))


# ---- replies and prompts -----------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 1, 2, 3, 4) THEN doc_id END AS k, CASE WHEN doc_id % 7 IN (0, 1, 2) THEN doc_id END AS strict FROM documents""")
def json_recovery(spark, sf):
    """Replies that are an object, fenced, after a thought, within words, or none."""
    k, obj = c("doc_id") % 7, F.concat(lit('{"k": '), text("doc_id"), lit(', "s": "a } \\" {"}'))
    reply = (
        F.when(k == 0, obj).when(k == 1, F.concat(lit("```json\n"), obj, lit("\n```"))).when(k == 2, F.concat(lit('<think>{"k": 0}</think> '), obj))
        .when(k == 3, F.concat(lit("Here:\n```\n"), obj, lit("\n```\nand [more]"))).when(k == 4, F.concat(lit("it is "), obj, lit(" I think {}")))
        .when(k == 5, "no object at all").otherwise("{ broken } and {\"k\": 1}")
    )
    held = table(spark, sf, "documents").select("doc_id", payload.json_object(reply).alias("o"), payload.strict_json_object(reply).alias("s"))
    return held.select("doc_id", *(F.get_json_object(x, "$.k").cast("long").alias(y) for x, y in (("o", "k"), ("s", "strict"))))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS updates, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 3 END AS new_cards, CASE doc_id % 4 WHEN 0 THEN 'u' WHEN 1 THEN 'n' WHEN 2 THEN 'self' ELSE 'c' END || doc_id AS name FROM documents""")
def payload_shapes(spark, sf):
    k, n = c("doc_id") % 4, text("doc_id")
    one = lambda p: F.concat(lit(f'{{"name": "{p}'), n, lit('"}'))
    body = (
        F.when(k == 0, F.concat(lit('{"updates": ['), one("u"), lit("]}"))).when(k == 1, F.concat(lit('{"updates": [{}, {}], "new_cards": ['), one("n"), lit("]}")))
        .when(k == 2, one("self")).otherwise(F.concat(lit('{"cards": ['), one("c"), lit(', {"a": [1]}, {}]}')))
    )
    p = table(spark, sf, "documents").select("doc_id", payload.patch_payload(body).alias("p"))
    first = F.coalesce(F.get_json_object(F.try_element_at("p.new_cards", lit(1)), "$.name"), F.get_json_object(F.try_element_at("p.updates", lit(1)), "$.name"))
    return p.select("doc_id", F.size("p.updates").alias("updates"), F.size("p.new_cards").alias("new_cards"), first.alias("name"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Look at the trajectory cluster ' || conv_id || ' and one trajectory cluster.' WHEN 1 THEN 'A trajectory cluster; This trajectory cluster' ELSE 'none here' END AS template FROM conversations""")
def template_wording(spark, sf):
    k = c("turn") % 3
    t = F.when(k == 0, F.concat(lit("Look at the trajectory "), text("conv_id"), lit(" and one trajectory."))).when(k == 1, "A single trajectory; This trajectory").otherwise("none here")
    return table(spark, sf, "conversations").select("conv_id", "turn", payload.for_groups(t).alias("template"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || chr(10) || chr(10) || 'Task type: ' || c_mktsegment WHEN 1 THEN 'Task type: ' || c_mktsegment ELSE c_name END AS query FROM customer""")
def retrieval_query(spark, sf):
    k = c("c_custkey") % 3
    return table(spark, sf, "customer").select("c_custkey", payload.retrieval_query(F.when(k != 1, F.concat(lit(" "), "c_name", lit("\n"))), F.when(k != 2, c("c_mktsegment"))).alias("query"))


@query(f"""WITH t AS (SELECT doc_id, text, len({TOKENS}) AS n, array_to_string({TOKENS}[1:30], ' ') AS head FROM documents)
SELECT doc_id, length(text)::BIGINT AS original_chars, length(head)::BIGINT AS truncated_chars, n::BIGINT AS token_count, 30 AS max_input_tokens FROM t WHERE n > 30""")
def truncation_report(spark, sf):
    """Inputs over the token limit, cut, and the report of them."""
    d = table(spark, sf, "documents").select("doc_id", c("text").alias("original"), payload.prepared_for_embedding(c("text"), 30).alias("prepared"))
    return protocol.truncation_report(d, "doc_id", 30)


@query("""SELECT c_custkey, 'name: ' || c_name || chr(10) || 'trigger: t' || c_nationkey || chr(10) || 'content: ' || c_mktsegment AS embedding_text, '### ' || c_name || chr(10) || chr(10) || 'Trigger: t' || c_nationkey || chr(10) || chr(10) || 'Guidance:' || chr(10) || c_mktsegment AS prompt_text,
sha256('{"content": "' || c_mktsegment || '", "name": "' || c_name || '", "trigger": "t' || c_nationkey || '"}') AS sha256, '# ' || c_name || chr(10) || chr(10) || '## Trigger' || chr(10) || 't' || c_nationkey || chr(10) || chr(10) || '## Content' || chr(10) || c_mktsegment || chr(10) AS card FROM customer""")
def card_render(spark, sf):
    cards = table(spark, sf, "customer").select("c_custkey", F.concat(lit(" "), "c_name").alias("name"), F.concat(lit("t"), text("c_nationkey")).alias("trigger"), F.concat("c_mktsegment", lit("\n")).alias("content"))
    return bank.rendered(cards).select("c_custkey", "embedding_text", "prompt_text", "sha256", payload.card_text(c("name"), c("trigger"), c("content")).alias("card"))


@query()
def model_tokens(spark, sf):
    """Tokens of documents by an installed tokenizer file, and the texts cut to 40 tokens at both ends."""
    import public_tokenizers

    at = public_tokenizers.path("byte_bpe_50k.json")
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", payload.model_cut(c("text"), 40, at, "head_tail").alias("m")).select("doc_id", "m.tokens", "m.cut")


@query()
def hashed_vectors(spark, sf):
    """Signed bags of words of the benchmark's items, by the hash that a build uses."""
    return table(spark, sf, "benchmark").select("item_id", payload.hashed_vector(c("text"), 64).alias("vector"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN page_id WHEN 1 THEN 7 ELSE nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '')::BIGINT END::INT AS page, CASE page_id % 3 WHEN 1 THEN 'treasury_bulletin_1999_02.txt' END AS file FROM pages")
def page_numbers(spark, sf):
    k = c("page_id") % 3
    url = F.when(k == 0, F.concat(lit("https://x.org/a?b=1&page="), text("page_id"))).when(k == 1, "https://x.org/FEBRUARY-1999-3?page=7").otherwise(c("url"))
    return table(spark, sf, "pages").select("page_id", documents.page_number(url).alias("page"), documents.monthly_file(url).alias("file"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '')::INT AS page FROM pages")
def url_page_refs(spark, sf):
    return table(spark, sf, "pages").select("page_id", documents.host(c("url")).alias("host"), documents.page_number(c("url")).alias("page"))
