"""Short forms shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagespark.fixtures.tables import LINE, PAGE, Tables, big, tag_of  # noqa: F401

P = "doc_id, page_no"
SIDES_SQL = 'l AS "left", t AS "top", r AS "right", b AS "bottom"'


def area(p: str = "") -> str:
    return f"(greatest(0, {p}r-{p}l+1) * greatest(0, {p}b-{p}t+1))"


def inter(a: str, b: str) -> str:
    return (f"(greatest(0, least({a}r,{b}r)-greatest({a}l,{b}l)+1) * "
            f"greatest(0, least({a}b,{b}b)-greatest({a}t,{b}t)+1))")


def iou_1d(s1: str, e1: str, s2: str, e2: str) -> str:
    shared = f"greatest(0, least({e1},{e2})-greatest({s1},{s2})+1)"
    return (f"({shared}::double / (CASE WHEN {shared} > 0 THEN greatest({e1},{e2})-least({s1},{s2})+1 "
            f"ELSE ({e1})-({s1})+({e2})-({s2})+2 END)::double)")


def v_iou(a: str, b: str) -> str:
    return iou_1d(a + "t", a + "b", b + "t", b + "b")


def r6(column: Column) -> Column:
    return F.round(column.cast("double"), 6)


def total(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def envelope_aggs() -> list[Column]:
    return [F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"),
            F.max("bottom").alias("bottom")]
