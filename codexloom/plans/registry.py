"""The list of queries, and views of the driver's tables that Spark and the oracle read from the same text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: name: SQL over the driver's tables (their names in braces) that both engines read. Rows take turns in their forms by key.
FIXTURES: dict[str, str] = {
    # documents with a number of every kind, without one, and with titles that end in a year
    "docs": """SELECT p_partkey AS doc_id, p_partkey AS ord, p_partkey % 8 AS way, num, yr, p_name AS name, p_size % 2 = 0 AS longer, kind AS loai_van_ban,
        CASE p_partkey % 8 WHEN 0 THEN shown || '/' || yr || '/NĐ-CP' WHEN 1 THEN shown || '/' || yr || '/TT-BTC' WHEN 2 THEN shown || '/' || yr || '/QH14'
          WHEN 3 THEN shown || '/' || yr || '/TTLT-NHNN-BTC' WHEN 5 THEN 'Không số' WHEN 6 THEN 'số ' || shown || '/' || yr WHEN 7 THEN shown || '/' || yr || '/QH13' END AS so_ky_hieu,
        kind || ' ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' năm ' ELSE ' ' END || yr AS title
      FROM (SELECT p_partkey, p_name, p_size, num, CASE WHEN p_size % 3 = 0 THEN lpad(num, 3, '0') ELSE num END AS shown, CAST(2000 + p_size % 20 AS STRING) AS yr,
          CASE p_partkey % 8 WHEN 0 THEN 'Nghị định' WHEN 1 THEN 'Thông tư' WHEN 3 THEN 'Thông tư liên tịch' WHEN 6 THEN 'Quyết định' WHEN 7 THEN 'Bộ luật' ELSE 'Luật' END AS kind
        FROM (SELECT p_partkey, p_name, p_size, CAST(p_partkey * 7 % 400 + 1 AS STRING) AS num FROM {part}) AS a) AS b""",
    # keys of references: some known, some a sign or two away, some of unknown kinds, some missing
    "keys": """SELECT o_orderkey AS ref_id, CASE o_orderkey % 6 WHEN 0 THEN 'ND' WHEN 1 THEN 'TT' WHEN 2 THEN 'LT' WHEN 3 THEN 'XX' WHEN 4 THEN 'TTLT' END
        || '-' || lpad(CAST(o_custkey * 3 % 420 + 1 AS STRING), 3, '0') || '-' || CAST(2000 + o_orderkey % 23 AS STRING) AS key FROM {orders}""",
    "edges": """SELECT o_custkey AS src, o_orderkey % 700 AS dst, o_orderkey AS ord, CASE o_orderkey % 9 WHEN 0 THEN 'Văn bản căn cứ' WHEN 1 THEN 'SUA_DOI' WHEN 2 THEN 'Văn bản sửa đổi' WHEN 3 THEN 'CAN_CU'
        WHEN 4 THEN 'LIEN_QUAN' WHEN 5 THEN 'Lạ' WHEN 6 THEN 'THAY_THE' WHEN 7 THEN 'Văn bản HD, QĐ chi tiết' ELSE 'Văn bản quy định hết hiệu lực 1 phần' END AS label FROM {orders}""",
    "articles": """SELECT 'doc_' || p_partkey || '_dieu_1' AS uid, p_partkey AS doc_id, p_size % 4 AS form,
        CASE p_size % 4 WHEN 0 THEN 'Không khoản' WHEN 1 THEN '1. Riêng' WHEN 2 THEN concat('1. A', chr(10), '2. B') ELSE concat('Điều 1. Phạm vi', chr(10), '1. Một', chr(10), '2. Hai') END AS text FROM {part}""",
    "amend": "SELECT 'doc_' || ps || '_dieu_1' AS target_uid, CASE ps % 4 WHEN 0 THEN 'Sửa đổi' WHEN 1 THEN 'Bãi bỏ' WHEN 2 THEN 'Bổ sung' ELSE 'hết hiệu lực' END AS action FROM (SELECT p_partkey AS ps FROM {part} WHERE p_partkey % 3 = 0) AS a",
    "status": """SELECT p_partkey AS doc_id, CASE p_partkey % 6 WHEN 2 THEN 'Hết hiệu lực toàn bộ' WHEN 3 THEN 'Hết hiệu lực một phần' WHEN 4 THEN 'lạ' WHEN 5 THEN 'Ngưng hiệu lực' ELSE 'Còn hiệu lực' END AS status FROM {part} WHERE p_partkey % 5 > 0""",
    "clauses": """SELECT o_orderkey AS clause_id, o_orderkey % 6 AS form, CASE o_orderkey % 6 WHEN 1 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS n_violations,
        CASE o_orderkey % 6 WHEN 0 THEN 'Bên B phải trả lương tối thiểu và bảo hiểm' WHEN 1 THEN 'Phạt 30% giá trị hợp đồng' WHEN 2 THEN 'Thuê nhà và căn hộ dài hạn' WHEN 3 THEN 'Thông tin mật phải được giữ kín'
          WHEN 4 THEN 'Giao hàng đúng hạn' ELSE 'Đơn phương chấm dứt hợp đồng lao động' END || ', mục ' || o_orderkey AS text FROM {orders}""",
    "subqueries": """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'TOPIC' WHEN 1 THEN 'LOOKUP' WHEN 2 THEN 'VALIDITY' WHEN 3 THEN 'COMPARISON' WHEN 4 THEN 'SEARCH' WHEN 5 THEN 'SCENARIO' WHEN 6 THEN 'CHECKLIST' ELSE 'NUMERIC' END AS intent,
        CASE o_custkey % 6 WHEN 0 THEN 'topic' WHEN 1 THEN 'lookup' WHEN 2 THEN 'direct_lookup' WHEN 3 THEN 'xem hiệu lực' WHEN 4 THEN 'comparison' ELSE 'vector_search' END AS strategy,
        CASE o_orderkey % 3 WHEN 0 THEN 'thuê đất' WHEN 1 THEN 'Điều ' || o_orderkey || ' Luật Doanh nghiệp' ELSE 'luật doanh nghiệp' END AS query FROM {orders}""",
}
TABLES = ("part", "orders")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    own = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in FIXTURES[name]}
    return spark.sql(FIXTURES[name], **own)


def fixture_sql(name: str) -> str:
    return "(" + FIXTURES[name].format(**{t: t for t in TABLES}) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register f(spark, sf_dir) under its name; {fx_NAME} in the SQL stands for a view of FIXTURES."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            text = sql
            for n in FIXTURES:
                text = text.replace("{fx_" + n + "}", fixture_sql(n))
            ORACLE[key] = text
        return f

    return register
