"""Logical image-analysis tables derived from the given parquet tables.

``Tables`` builds them as DataFrames; ``LOGICAL_SQL`` holds the same definitions for the SQL check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.operators.running import row_numbers, split_row_numbers

LOGICAL_SQL: dict[str, str] = {
    "images": """
select o_orderkey as image_id, cast(640+64*(o_custkey%6) as int) as width, cast(480+32*(o_orderkey%5) as int) as height,
  concat('/data/d',cast(o_custkey%10 as varchar),'/img_',cast(o_orderkey%1000 as varchar),
         case when o_orderkey%7=0 then '.PNG' when o_orderkey%11=0 then '.gif' else '.jpg' end) as path,
  case o_custkey%3 when 0 then 'file' when 1 then 'directory' else 'glob' end as source_type
from orders""",
    "detections": """
select l_orderkey as image_id,
  cast(row_number() over (partition by l_orderkey
       order by l_linenumber,l_partkey,l_suppkey,l_shipdate,l_extendedprice) as int) as det_id,
  cast(case when l_returnflag='A' then 0 when l_returnflag='N' then 1
            when l_linestatus='O' then 2 else 3 end as int) as class_id,
  cast(60+(l_orderkey*13)%300+(l_partkey%41) as double) as x1,
  cast(40+(l_orderkey*7)%200+(l_suppkey%37) as double) as y1,
  cast(60+(l_orderkey*13)%300+(l_partkey%41)+30+2*l_quantity as double) as x2,
  cast(40+(l_orderkey*7)%200+(l_suppkey%37)+24+3*l_quantity as double) as y2,
  cast((l_partkey*31+l_suppkey*17+l_linenumber*7)%1000 as double)/1000 as confidence,
  cast(l_partkey%629 as double)/100-3.14 as angle
from lineitem""",
    "candidate": """
select image_id, det_id, class_id,
  x1+(det_id*5)%9-4 as x1, y1+(det_id*3)%7-3 as y1, x2+(det_id*2)%5-2 as x2, y2+(det_id*4)%11-5 as y2,
  cast(cast(round(confidence*1000) as int)*7%1000 as double)/1000 as confidence
from detections where (image_id+det_id)%6<>0""",
    "parts": """
select l_orderkey as image_id, cast(1+(l_partkey+l_linenumber*2)%15 as int) as part_id,
  cast(min(50+(l_partkey*7)%400) as double) as x, cast(min(40+(l_suppkey*11+l_partkey)%300) as double) as y,
  cast(max(case when l_linestatus='O' then 1 else 0 end) as int) as visible
from lineitem group by 1,2""",
    "grid_cells": """
select vec_id as image_id, cast(pos//8 as int) as gy, cast(pos%8 as int) as gx, cast(v as double) as v
from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding,1)-1 as pos from embeddings)""",
    "model_outputs": """
select image_id, cast(gy*8+gx as int) as pos, v as base, round(v*127)/127 as quant from grid_cells""",
    "logits": """
select image_id, cast((gy*8+gx)//4 as int) as query_id, cast((gy*8+gx)%4 as int) as class_id, 8*v as logit from grid_cells""",
    "mask_pixels": """
select image_id, gy as y, gx as x, cast(case when v>0 then 1 else 0 end as int) as m from grid_cells""",
    "metric_log": """
select p_brand as run_id, cast(p_size as int) as epoch, p_type as class, round(avg(p_retailprice)/3000,6) as value
from part group by 1,2,3""",
    "run_events": """
select event_id, ts, user_id as run_id, event_type as kind,
  concat('/data/img_',cast(event_id%200 as varchar),'.jpg') as path, value as ms from events""",
    "timings": """
select event_type as series, cast(row_number() over (partition by event_type order by ts,event_id)-1 as int) as run_no,
  value as ms from events""",
    "mos": """
select doc_id as image_id, cast(n_chars%101 as double) as pred, cast((n_chars*7+doc_id)%101 as double) as label,
  doc_id%5=0 as is_valid from documents""",
}


_BOX_COLUMNS = (
    "cast(case when l_returnflag='A' then 0 when l_returnflag='N' then 1 "
    "when l_linestatus='O' then 2 else 3 end as int) as class_id",
    "cast(60+(l_orderkey*13)%300+(l_partkey%41) as double) as x1",
    "cast(40+(l_orderkey*7)%200+(l_suppkey%37) as double) as y1",
    "cast(60+(l_orderkey*13)%300+(l_partkey%41)+30+2*l_quantity as double) as x2",
    "cast(40+(l_orderkey*7)%200+(l_suppkey%37)+24+3*l_quantity as double) as y2",
    "cast((l_partkey*31+l_suppkey*17+l_linenumber*7)%1000 as double)/1000 as confidence",
    "cast(l_partkey%629 as double)/100-3.14D as angle",
)


class Tables:
    """The given tables and the logical tables over them, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def images(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as image_id",
            "cast(640+64*(o_custkey%6) as int) as width",
            "cast(480+32*(o_orderkey%5) as int) as height",
            "concat('/data/d',cast(o_custkey%10 as string),'/img_',cast(o_orderkey%1000 as string),"
            "case when o_orderkey%7=0 then '.PNG' when o_orderkey%11=0 then '.gif' else '.jpg' end) as path",
            "case o_custkey%3 when 0 then 'file' when 1 then 'directory' else 'glob' end as source_type",
        )

    @cached_property
    def detections(self) -> DataFrame:
        numbered = split_row_numbers(
            self.raw("lineitem"),
            ["l_orderkey"],
            [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 256)],
            [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")],
            "det_id",
        )
        return numbered.selectExpr("l_orderkey as image_id", "cast(det_id as int) as det_id", *_BOX_COLUMNS)

    @cached_property
    def boxes(self) -> DataFrame:
        """The detections without their number, for queries that only count or join them."""
        return self.raw("lineitem").selectExpr("l_orderkey as image_id", *_BOX_COLUMNS)

    @cached_property
    def candidate(self) -> DataFrame:
        return self.detections.filter("(image_id+det_id)%6<>0").selectExpr(
            "image_id", "det_id", "class_id",
            "x1+(det_id*5)%9-4 as x1", "y1+(det_id*3)%7-3 as y1", "x2+(det_id*2)%5-2 as x2", "y2+(det_id*4)%11-5 as y2",
            "cast(cast(round(confidence*1000) as int)*7%1000 as double)/1000 as confidence",
        )

    @cached_property
    def parts(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .selectExpr(
                "l_orderkey as image_id", "cast(1+(l_partkey+l_linenumber*2)%15 as int) as part_id",
                "50+(l_partkey*7)%400 as x", "40+(l_suppkey*11+l_partkey)%300 as y",
                "case when l_linestatus='O' then 1 else 0 end as visible",
            )
            .groupBy("image_id", "part_id")
            .agg(
                F.min("x").cast("double").alias("x"), F.min("y").cast("double").alias("y"),
                F.max("visible").cast("int").alias("visible"),
            )
        )

    @cached_property
    def grids(self) -> DataFrame:
        """One row per image: the 8x8 grid at rest as a flat row-major array."""
        return self.raw("embeddings").selectExpr("vec_id as image_id", "cast(embedding as array<double>) as cells")

    @cached_property
    def grid_cells(self) -> DataFrame:
        return self.raw("embeddings").selectExpr("vec_id as image_id", "posexplode(embedding) as (pos, v)").selectExpr(
            "image_id", "cast(pos div 8 as int) as gy", "cast(pos%8 as int) as gx", "cast(v as double) as v"
        )

    @cached_property
    def model_outputs(self) -> DataFrame:
        return self.grid_cells.selectExpr(
            "image_id", "cast(gy*8+gx as int) as pos", "v as base", "round(v*127)/127 as quant"
        )

    @cached_property
    def logits(self) -> DataFrame:
        return self.grid_cells.selectExpr(
            "image_id", "cast((gy*8+gx) div 4 as int) as query_id", "cast((gy*8+gx)%4 as int) as class_id", "8*v as logit"
        )

    @cached_property
    def masks(self) -> DataFrame:
        """One row per image: the binary mask at rest."""
        return self.grids.selectExpr("image_id", "8 as width", "8 as height", "transform(cells, v -> if(v>0,1,0)) as mask")

    @cached_property
    def metric_log(self) -> DataFrame:
        return (
            self.raw("part")
            .groupBy(F.col("p_brand").alias("run_id"), F.col("p_size").cast("int").alias("epoch"), F.col("p_type").alias("class"))
            .agg(F.round(F.avg("p_retailprice") / 3000, 6).alias("value"))
        )

    @cached_property
    def run_events(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id", "ts", "user_id as run_id", "event_type as kind",
            "concat('/data/img_',cast(event_id%200 as string),'.jpg') as path", "value as ms",
        )

    @cached_property
    def timings(self) -> DataFrame:
        events = self.raw("events").selectExpr("event_type as series", "ts", "event_id", "value as ms")
        numbered = row_numbers(
            events, ["series"], [F.date_trunc("hour", "ts")], [F.col("ts"), F.col("event_id")], "run_no"
        )
        return numbered.select("series", (F.col("run_no") - 1).cast("int").alias("run_no"), "ms")

    @cached_property
    def mos(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id as image_id", "cast(n_chars%101 as double) as pred",
            "cast((n_chars*7+doc_id)%101 as double) as label", "doc_id%5=0 as is_valid",
        )
