import duckdb
import pandas as pd
from pyspark.sql import functions as F

from blockloom.functions import scalar
from blockloom.plans import catalog


def test_sizes_round_as_printf(spark):
    """Exact halves go to the even digit; numbers beyond a double's 53 bits round as their double does."""
    numbers = [0, 1023, 1024, 1152, 1408, 1664, 917632, 1029, 2**20 - 1, 2**40 + 2**31, 2**53 + 1, 2**63 - 513, 2**63 - 1]
    numbers += [k**3 for k in range(1, 15001)]
    con = duckdb.connect()
    con.register("customer", pd.DataFrame({"c_custkey": numbers}))
    sql = catalog.oracle_sql()["size_format"].replace("c_custkey * c_custkey * c_custkey AS n", "c_custkey AS n")
    want = dict(con.sql(sql).fetchall())
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert {r.n: r.text for r in rows.select("n", scalar.format_size(F.col("n")).alias("text")).collect()} == want
    assert want[1152] == "1.12 KiB"
