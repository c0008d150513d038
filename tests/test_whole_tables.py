import pyarrow.compute as pc
import pyarrow.parquet as pq

from tablewright.plans import governance_queries, relational_queries

SF = "/root/testdata/sf0.001"


def lineitem(column):
    return pq.read_table(f"{SF}/lineitem.parquet")[column]


def test_item_queries_read_every_row(spark):
    q = relational_queries.QUERIES
    assert q["x31_product_row"](spark, SF).count() == len(lineitem("l_orderkey"))
    assert q["a02_row_counts"](spark, SF).count() == pc.count_distinct(lineitem("l_orderkey")).as_py()
    filled = 1 - pc.sum(pc.equal(pc.subtract(lineitem("l_suppkey"), pc.multiply(pc.divide(lineitem("l_suppkey"), 7), 7)), 0)).as_py() / len(lineitem("l_suppkey"))
    assert abs(q["a01_fill_rates"](spark, SF).first().img - filled) < 1e-9


def test_reasoning_reads_every_row(spark):
    q = governance_queries.QUERIES
    assert q["r09_item_rules"](spark, SF).count() == len(lineitem("l_orderkey"))
    assert q["r13_summary"](spark, SF).count() == pc.count_distinct(lineitem("l_orderkey")).as_py()
