"""The SQL functions against the Column expressions of the same names."""

import pytest
from pyspark.sql import functions as F

from streetlens.functions import sql
from streetlens.functions.box import SIDES, Box, size_bucket

PAIRS = [(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0), (-5.0, 2.0, 20.0, 99.0, 990.0, 0.0, 1010.0, 30.0), (3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0), (9.0, 9.0, 1.0, 1.0, 0.0, 0.0, 50.0, 50.0), (2050.0, 0.0, 2060.0, 120.0, 50.0, 0.0, 60.0, 90.0)]


def same():
    A, B = Box.of("a_"), Box.of("b_")
    return {
        "box_width(a)": A.width, "box_height(a)": A.height, "box_area(a)": A.area, "box_intersection(a, b)": A.intersection(B), "box_iou(a, b)": A.iou(B), "box_iomin(a, b)": A.iomin(B), "box_union(a, b)": A.union(B),
        "box_translate(a, 3, -2.5)": A.translate(F.lit(3.0), F.lit(-2.5)), "box_expand(a, 0.1D)": A.expand(0.1), "box_clip(a, 15, 20)": A.clip(15.0, 20.0), "box_normalize(a, 1000)": A.normalize(F.lit(1000.0)), "box_unwrap(a, b, 1000)": A.unwrap_towards(B, F.lit(1000.0)),
        "box_wrapped_iou(a, b, 1000)": A.wrapped_iou(B, F.lit(1000.0)), "box_size(a)": size_bucket(A.height),
    }


@pytest.fixture(scope="module")
def pairs(spark):
    sql.register(spark)
    table = spark.createDataFrame(PAIRS, ", ".join(f"{p}_{s} double" for p in "ab" for s in SIDES))
    return table.selectExpr("*", *(f"box_of({', '.join(f'{p}_{s}' for s in SIDES)}) AS {p}" for p in "ab"))


@pytest.mark.parametrize("name", sorted(set(sql.FUNCTIONS) - {"box_of"}))
def test_function(pairs, name):
    call, want = next((c, w) for c, w in same().items() if c.startswith(f"{name}("))
    want = F.struct(*want.named()) if isinstance(want, Box) else want
    rows = pairs.select(F.expr(call).alias("found"), want.alias("want")).collect()
    assert len(rows) == len(PAIRS) and all(r.found == r.want for r in rows)


def test_calls_are_inlined(spark, pairs):
    plan = pairs.selectExpr("box_wrapped_iou(a, b, 1000) AS v").groupBy().agg(F.sum("v"))._jdf.queryExecution().toString()
    assert "SQLFunctionExpression" not in plan.split("== Optimized Logical Plan ==")[1]


def test_null_boxes(spark, pairs):
    row = spark.sql("SELECT box_width(NULL) AS w, box_iou(NULL, box_of(0, 0, 1, 1)) AS i").first()
    assert (row.w, row.i) == (0.0, 0.0)
