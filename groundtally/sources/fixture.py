"""Input views derived from the driver's tables: pixels, patches, annotations, scored items.

Each is a plain transformation of whole tables, so the work of every query grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtally.functions import dims
from groundtally.functions import fixed_values as V


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals a narrow scan out by key before it is multiplied, to as many partitions as the session works on at once.

    The number is named, because adaptive execution would join partitions by the few bytes they hold now.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """One row per pixel: (patch_id, row, col, code); a patch is one nation's copy of the part grid."""
    part = spread(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("patch_id"))
    row = F.floor(F.col("p_partkey") / 40).cast("int")
    col = (F.col("p_partkey") % 40).cast("int")
    cell = (
        part.select(row.alias("row"), col.alias("col"), "p_partkey", "p_size")
        .join(F.broadcast(nation))  # every nation has its copy of the grid
    )
    idx = F.when(F.col("p_partkey") % 97 == 0, F.lit(V.UNCLASSIFIED_ID)).otherwise(
        ((F.floor(F.col("row") / 5) * 3 + F.floor(F.col("col") / 8) * 5 + F.col("patch_id") * 7
          + F.when(F.col("p_size") % 10 == 0, 1).otherwise(0)) % 44).cast("int")
    )
    codes = dims.literal_array([r[0] for r in dims.class_rows()])
    return cell.withColumn("idx", idx).select(
        "patch_id", "row", "col",
        F.when(F.col("idx") < 0, F.lit(V.UNCLASSIFIED_CODE))
        .otherwise(F.element_at(codes, F.col("idx") + 1)).cast("int").alias("code"),
    )


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """Geography: (patch_id, tile, row, col, country, lat, lon), with repeat acquisitions."""
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    pos = F.col("c_custkey") % 120
    row, col = F.floor(pos / 12).cast("int"), (pos % 12).cast("int")
    tile = F.concat(F.lit("T"), (10 + F.col("c_nationkey")).cast("string"), F.lit("ABC"))
    return cust.select(
        F.concat(F.lit("S2A_"), F.col("c_custkey").cast("string"), F.lit("_"), tile, F.lit("_"),
                 row.cast("string"), F.lit("_"), col.cast("string")).alias("patch_id"),
        tile.alias("tile"), row.alias("row"), col.alias("col"),
        F.col("c_mktsegment").alias("country"),
        (F.lit(36.0) + F.col("c_nationkey") + row.cast("double") / 80).alias("lat"),
        (F.lit(-8.0) + F.col("c_nationkey") + col.cast("double") / 60).alias("lon"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored items: (patch_id, task, abstained, correct, reason)."""
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus", "l_tax", "l_discount", "l_linenumber")
    out = F.col("l_tax") < 0.01
    return li.select(
        F.col("l_suppkey").alias("patch_id"),
        F.concat_ws("|", "l_returnflag", "l_linestatus").alias("task"),
        out.alias("abstained"),
        (~out & (F.col("l_discount") < 0.05)).alias("correct"),
        F.when(out, F.concat(F.lit("reason "), F.col("l_linenumber").cast("string")))
        .otherwise(F.lit("")).alias("reason"),
    )


# One SELECT builds the annotation view in every SQL dialect; `{cls}` is the list of class names.
ANNOTATION_SELECT = r"""
SELECT o_orderkey AS id,
  CONCAT('S1_', CAST(o_custkey % 25 AS STRING)) AS s1_name,
  CAST(o_custkey % 25 AS INT) AS patch_id,
  CASE o_orderkey % 24
    WHEN 0 THEN CASE o_custkey % 7 WHEN 0 THEN CONCAT('Is any part of the scene covered by ', LOWER(a.name), '?')
                WHEN 1 THEN CONCAT('Are there distinct parcels of ', LOWER(a.name), '?')
                ELSE CONCAT('Is there any ', LOWER(a.name), ' in the image?') END
    WHEN 1 THEN CONCAT('Does ', LOWER(a.name), ' cover at least ', n10, '% of the image?')
    WHEN 2 THEN CONCAT('Are there exactly ', cnt, ' connected regions of ', LOWER(a.name), '?')
    WHEN 3 THEN CONCAT('Is any ', LOWER(a.name), ' and ', LOWER(b.name), ' side by side in the image?')
    WHEN 4 THEN CONCAT('Is more than ', m2, ' m2 of the patch covered by ', LOWER(a.name), '?')
    WHEN 5 THEN CONCAT('Does ', LOWER(a.name), ' occupy between ', n10, '% and ', n30, '% of the patch?')
    WHEN 6 THEN CONCAT('Does the image show other classes besides ', LOWER(a.name), '?')
    WHEN 7 THEN CONCAT('Are there at least ', cntw, ' separate patches of ', LOWER(a.name), '?')
    WHEN 8 THEN CONCAT('Is there only a single continuous region of ', LOWER(a.name), '?')
    WHEN 9 THEN CONCAT('Does the image contain multiple distinct areas of ', LOWER(a.name), '?')
    WHEN 10 THEN CONCAT('Which class appears in the image? a) ', a.name, ', b) ', b.name, ', c) ', d.name, ', d) ', e.name, '.')
    WHEN 11 THEN CONCAT('How many connected regions of ', LOWER(a.name), ' are there? a) ', cnt, ', b) ', cnt2, ', c) ', cnt4, ', d) ', cnt7)
    WHEN 12 THEN CONCAT('How much of the image does ', LOWER(a.name), ' cover? ', ranges)
    WHEN 13 THEN CONCAT('Which classes share a boundary? a) ', a.name, ' and ', b.name, ', b) ', a.name, ' and ', d.name, ', c) ', b.name, ' and ', e.name, ', d) ', d.name, ' and ', e.name, '.')
    WHEN 14 THEN CONCAT('Where is the ', LOWER(a.name), ' located compared to the ', LOWER(b.name), '? ', dirs)
    WHEN 15 THEN CONCAT('Relative to the ', LOWER(a.name), ', where does the ', LOWER(b.name), ' appear in the scene? ', dirs)
    WHEN 16 THEN 'Which country was this image taken in? a) Portugal, b) Finland, c) Austria, d) Serbia'
    WHEN 17 THEN 'In which season was the image captured? a) Spring, b) Summer, c) Autumn, d) Winter'
    WHEN 18 THEN 'Which climate zone does the image belong to? a) Mediterranean, b) Boreal, c) Continental, d) Oceanic'
    WHEN 19 THEN CONCAT('Describe the land cover of the scene, mentioning the time of year', punct)
    WHEN 20 THEN CONCAT('Give the bounding box of the <ref>', qual, ' patch of ', LOWER(a.name), '</ref>.')
    WHEN 21 THEN CONCAT('What is the box of the region at <point>(', px, ' ', py, ')</point>?')
    WHEN 22 THEN CASE o_custkey % 4 WHEN 0 THEN 'Is there any lava in the image?' WHEN 1 THEN 'Hello there'
                 WHEN 2 THEN CONCAT('Is the region of ', LOWER(a.name), ' next to water?')
                 ELSE CONCAT('Is it ', LOWER(a.name), '?') END
    ELSE CASE o_custkey % 3 WHEN 0 THEN CONCAT('Is ', n10, '% of the image ', LOWER(a.name), '?')
         ELSE CONCAT('Does ', LOWER(a.name), ' cover more than ', n10, '% of the image?') END
  END AS input,
  CASE WHEN o_orderkey % 24 IN (10, 11, 12, 13, 14, 15, 16, 17, 18) THEN SUBSTR('abcd', 1 + CAST(price % 4 AS INT), 1)
       WHEN o_orderkey % 24 = 19 THEN CONCAT('The scene shows ', LOWER(a.name), ' next to ', LOWER(b.name), ' during the ', LOWER(season), ' in ', country, '.')
       WHEN o_orderkey % 24 IN (20, 21) THEN '(0.10, 0.10), (0.40, 0.50)'
       WHEN price % 2 = 0 THEN 'yes' ELSE 'no' END AS output,
  CASE WHEN o_orderkey % 24 IN (10, 11, 12, 13, 14, 15, 16, 17, 18) THEN 'mcq'
       WHEN o_orderkey % 24 = 19 THEN 'captioning' WHEN o_orderkey % 24 IN (20, 21) THEN 'bounding box'
       ELSE 'binary' END AS type,
  CASE WHEN o_orderkey % 24 IN (0, 10, 22) THEN 'presence' WHEN o_orderkey % 24 IN (1, 4, 5, 6, 12, 23) THEN 'area'
       WHEN o_orderkey % 24 IN (2, 7, 8, 9, 11) THEN 'count' WHEN o_orderkey % 24 IN (3, 13) THEN 'adjacency'
       WHEN o_orderkey % 24 IN (14, 15) THEN 'relative pos' WHEN o_orderkey % 24 = 16 THEN 'country'
       WHEN o_orderkey % 24 = 17 THEN 'season' WHEN o_orderkey % 24 = 18 THEN 'climate zone'
       WHEN o_orderkey % 24 = 19 THEN 'None' WHEN o_orderkey % 24 = 20 THEN 'reference' ELSE 'point' END AS category,
  CASE o_orderpriority WHEN '5-LOW' THEN 'bench' WHEN '1-URGENT' THEN 'validation' ELSE 'train' END AS split,
  CAST(36 AS DOUBLE) + o_custkey % 25 AS latitude,
  CAST(-8 AS DOUBLE) + o_custkey % 25 AS longitude,
  country, season, climate_zone
FROM (SELECT *,
    CAST(FLOOR(o_totalprice) AS BIGINT) AS price,
    CAST(10 * (o_orderkey % 11) AS STRING) AS n10,
    CAST(10 * (o_orderkey % 11) + 20 AS STRING) AS n30,
    CAST(144000 * (o_orderkey % 4) AS STRING) AS m2,
    CAST(1 + o_orderkey % 5 AS STRING) AS cnt,
    CAST(3 + o_orderkey % 5 AS STRING) AS cnt2,
    CAST(5 + o_orderkey % 5 AS STRING) AS cnt4,
    CAST(8 + o_orderkey % 5 AS STRING) AS cnt7,
    CASE o_orderkey % 5 WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 2 THEN 'three' WHEN 3 THEN 'four' ELSE 'five' END AS cntw,
    CASE o_custkey % 3 WHEN 0 THEN 'a) 0 to 10%, b) 10 to 30%, c) 30 to 60%, d) 60 to 100%'
         WHEN 1 THEN 'a) 0 to 72,000 m2, b) 72,000 to 144,000 m2, c) 200,000 to 432,000 m2, d) 432,000 to 1,440,000 m2'
         ELSE 'a) 1 to 2%, b) 3 to 5%, c) 10%, d) 20 to 40%' END AS ranges,
    CASE o_custkey % 3 WHEN 0 THEN 'a) to the left, b) top right, c) bottom, d) bottom-right'
         WHEN 1 THEN 'a) top, b) bottom-left, c) right, d) somewhere'
         ELSE 'a) above, b) below, c) north-west, d) east' END AS dirs,
    CASE o_custkey % 2 WHEN 0 THEN '.' ELSE ', please!' END AS punct,
    CASE o_custkey % 2 WHEN 0 THEN 'largest' ELSE 'smallest' END AS qual,
    CONCAT('0.', CAST(1 + o_custkey % 9 AS STRING)) AS px,
    CONCAT('0.', CAST(o_custkey % 10 AS STRING), '5') AS py,
    CASE o_custkey % 5 WHEN 0 THEN 'Portugal' WHEN 1 THEN 'Finland' WHEN 2 THEN 'Austria' WHEN 3 THEN 'Serbia' ELSE 'Ireland' END AS country,
    CASE o_orderkey % 4 WHEN 0 THEN 'Spring' WHEN 1 THEN 'Summer' WHEN 2 THEN 'Autumn' ELSE 'Winter' END AS season,
    CASE o_custkey % 3 WHEN 0 THEN 'Mediterranean' WHEN 1 THEN 'Boreal' ELSE 'Continental' END AS climate_zone
  FROM {orders}) o
JOIN {cls} a ON a.k = o.o_orderkey % 19
JOIN {cls} b ON b.k = (o.o_orderkey + 1 + o.o_custkey % 18) % 19
JOIN {cls} d ON d.k = (o.o_orderkey + 1 + (o.o_custkey + 4) % 18) % 19
JOIN {cls} e ON e.k = (o.o_orderkey + 1 + (o.o_custkey + 9) % 18) % 19
"""


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Questions over the patches: the 13 columns of the annotation table, one row per order."""
    cls = dims.literal_table(spark, list(enumerate(dims.C19_NAMES)), "k bigint, name string")
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    orders = spread(table(spark, sf, "orders").select(*columns), "o_orderkey")
    return spark.sql(ANNOTATION_SELECT, orders=orders, cls=F.broadcast(cls))


def open_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """The annotation view without the sealed split."""
    return annotations(spark, sf).filter(F.col("split").isin(*V.OPEN_SPLITS))
