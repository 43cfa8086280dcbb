"""Layout and text repair on pages that are composed from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qforge.operators import layout as L
from qforge.operators import repair_text as R
from qforge.operators import vocabulary as V
from qforge.plans.tables import table
from qforge.storage import settled

SQL: dict[str, str] = {}


def _tsv(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages of OCR output: a word row for each line item, by the supplier's parity in the left or the right column."""
    x = F.when(F.col("l_suppkey") % 2 == 0, 0).otherwise(600)
    row = F.format_string("5\t1\t%d\t1\t1\t1\t%d\t%d\t%d\t10\t%d\tw%d", "l_linenumber", x, F.col("l_linenumber") * 20, F.lit(300), F.when(F.col("l_tax") > 0.07, -1).otherwise(90), "l_partkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("t")).alias("r")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("p"))
    return rows.select("l_orderkey", F.concat(F.lit("level\tpage_num\n"), F.array_join(F.transform("p", lambda r: r["t"]), "\n")).alias("tsv"))


def parse_tsv(spark: SparkSession, d: str) -> DataFrame:
    return L.word_boxes(_tsv(spark, d), "l_orderkey")


_BOX = "(SELECT l_orderkey, '1:' || l_linenumber || ':1:1' AS line_id, CASE WHEN l_suppkey % 2 = 0 THEN 0.0::double ELSE 600.0::double END AS \"left\", (l_linenumber * 20)::double AS top, 'w' || l_partkey AS text FROM lineitem WHERE NOT l_tax > 0.07)"
SQL["parse_tsv"] = f'SELECT l_orderkey, line_id, "left", top, "left" + 300.0::double AS "right", top + 10.0::double AS bottom, text FROM {_BOX}'


def column_major(spark: SparkSession, d: str) -> DataFrame:
    return L.column_major(L.word_boxes(_tsv(spark, d), "l_orderkey"), "l_orderkey")


_LINES = f"""ln AS (SELECT l_orderkey, line_id, min("left") AS l, max("left" + 300) AS r, min(top) AS t, max(top + 10) AS b, count(*) AS words, string_agg(text, ' ' ORDER BY "left", text) AS text FROM {_BOX} GROUP BY l_orderkey, line_id)"""
SQL["column_major"] = f"""WITH {_LINES}, sd AS (SELECT *, CASE WHEN l < mid THEN 0 ELSE 1 END AS side FROM (SELECT *, (min(l) OVER (PARTITION BY l_orderkey) + max(r) OVER (PARTITION BY l_orderkey)) / 2 AS mid FROM ln)),
 bo AS (SELECT *, sum(CASE WHEN side = 0 THEN words ELSE 0 END) OVER (PARTITION BY l_orderkey) AS lw, sum(words) OVER (PARTITION BY l_orderkey) AS w FROM sd)
SELECT l_orderkey, string_agg(text, chr(10) ORDER BY CASE WHEN lw >= 3 AND w - lw >= 3 THEN side ELSE 0 END, t, l, text) AS text FROM bo GROUP BY l_orderkey"""


def banded_order(spark: SparkSession, d: str) -> DataFrame:
    return L.banded(L.word_boxes(_tsv(spark, d), "l_orderkey"), "l_orderkey")


def column_split(spark: SparkSession, d: str) -> DataFrame:
    return L.column_split(L.word_boxes(_tsv(spark, d), "l_orderkey"), "l_orderkey", least_lines=2)


SQL["column_split"] = f"""WITH {_LINES}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY t, l) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS m, lead(t) OVER (PARTITION BY l_orderkey ORDER BY t, l) AS nxt FROM ln),
 k AS (SELECT *, (min(l) OVER (PARTITION BY l_orderkey) + max(r) OVER (PARTITION BY l_orderkey)) / 2 AS mid FROM o WHERE m >= 2 AND NOT (rn = 1 AND nxt - b > 2 * (b - t))),
 g AS (SELECT l_orderkey, count(*) FILTER (WHERE r < mid) AS a, count(*) FILTER (WHERE l > mid) AS b, count(*) AS n, max(r) FILTER (WHERE r < mid) AS x, min(l) FILTER (WHERE l > mid) AS y FROM k GROUP BY l_orderkey)
SELECT DISTINCT l_orderkey, CASE WHEN a >= ceil(n * 0.25) AND b >= ceil(n * 0.25) AND a + b = n AND y - x >= 10 THEN floor((x + y) / 2 + 0.5)::bigint END AS split FROM {_BOX} LEFT JOIN g USING (l_orderkey)"""


def layout_columns(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages of two columns of text: order key and priority on the left, customer and status on the right."""
    rows = table(spark, d, "orders").withColumn("page", F.floor(F.col("o_orderkey") / 20))
    line = F.concat(F.rpad(F.concat_ws(" ", F.lit("order"), "o_orderkey", "o_orderpriority"), 40, " "), F.lpad(F.concat_ws(" ", F.lit("customer number"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), "o_orderstatus"), 40, " "))
    pages = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return L.ordered_pages(pages, "page", "text")


_PAGE = "(SELECT o_orderkey // 20 AS page, count(*) AS n, string_agg('order ' || o_orderkey || ' ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS l, string_agg('customer number ' || lpad(o_custkey::varchar, 9, '0') || ' ' || o_orderstatus, chr(10) ORDER BY o_orderkey) AS r FROM orders GROUP BY 1)"
SQL["layout_columns"] = f"SELECT page, l || chr(10) || r AS text, true AS two_columns FROM {_PAGE} WHERE n >= 6"


def layout_totals(spark: SparkSession, d: str) -> DataFrame:
    return L.totals(layout_columns(spark, d))


SQL["layout_totals"] = f"SELECT count(*) AS pages, count(*) FILTER (WHERE n >= 6) AS two_column_pages FROM {_PAGE}"


def text_repair(spark: SparkSession, d: str) -> DataFrame:
    """Documents repaired against their own vocabulary; the source src0 is trusted."""
    docs = table(spark, d, "documents")
    words = settled(V.vocabulary(docs, F.col("text"), F.col("source") == "src0"), "vocabulary")
    return R.repaired(docs, "doc_id", "text", words)


QUERIES = {f.__name__: f for f in (parse_tsv, column_major, banded_order, column_split, layout_columns, layout_totals, text_repair)}
