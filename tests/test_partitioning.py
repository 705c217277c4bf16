
import pytest

import __spark_entry__ as E
from oracle_check import rows_of

SF = "/root/testdata/sf0.001"
NAMES = ["first_seen_vocab", "batch_assignment", "split_parts", "bfs_reach", "claim_sentences", "early_stop"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_any_partition_count(spark, name):
    q = E.queries()[name]
    results = []
    for n in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows_of(q(spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
