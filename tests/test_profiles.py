"""Profiles (T11) on built rows: order of equal lines, nulls, and what travels for a line."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from talentlake.functions import text as T
from talentlake.plans.q_text import v_profiles


def _tables(spark):
    return SimpleNamespace(
        orders=spark.createDataFrame([(7, 1, "O", "1-URGENT", "2024-03-05")], "o_orderkey long, o_custkey long, o_orderstatus string, "
                                     "o_orderpriority string, o_orderdate string").withColumn("o_orderdate", F.to_date("o_orderdate")),
        customer=spark.createDataFrame([(1, "Ada", 3, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        nation=spark.createDataFrame([(3, "PERU")], "n_nationkey int, n_name string"),
        part=spark.createDataFrame([(10, "bolt", "SMALL TIN", "Brand#1"), (11, "nut", None, "Brand#0")],
                                   "p_partkey long, p_name string, p_type string, p_brand string"),
        lineitem=spark.createDataFrame([(7, 4, 11, 1, 25.0, None), (7, 1, 10, 1, 13.0, "R"), (7, 1, 10, 1, 13.0, "A"), (7, 1, 10, 1, 13.0, "N")],
                                       "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"))


def test_equal_lines_go_by_proficiency_and_nulls_are_left_out(spark):
    row = v_profiles(_tables(spark)).select(T.render_cv(F.col("cv")).alias("cv"), T.render_job(F.col("job")).alias("job")).first()
    assert row.cv == ("## Candidate: Ada\n\n**Total Experience:** 14 years\n\n**Skills:**\n- bolt - 3 years\n- bolt (expert) - 3 years\n"
                      "- bolt (proficient) - 3 years\n- nut - 5 years\n\n**Work Experience:**\n\n### 1-URGENT at PERU (2024-03 - Present)\n"
                      "  - SMALL TIN\n  Technologies: Brand#0, Brand#1\n\n**Certifications:** Brand#0, Brand#1\n")
    assert "**Nice-to-Have:**\n- nut\n" in row.job and "- bolt [small tin]\n- bolt [small tin]\n- bolt [small tin]\n" in row.job


def test_lines_travel_once_and_sort_by_generated_code(spark):
    plan = v_profiles(_tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan
    collected = plan[plan.index("collect_list("):].split("AS _lines")[0]
    assert "lower(" not in collected and "expert" not in collected
