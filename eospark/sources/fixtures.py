"""Example tables for the registered queries, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eospark.functions.arrays import u
from eospark.operators.global_order import group_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_cls(spark: SparkSession, d: str) -> DataFrame:
    """Ten-class scores: id, label, logits, weight, mask, strata, head."""
    logits = F.array(*[10 * F.get("embedding", F.lit(i)).cast("double") + (F.col("label") == i).cast("double") for i in range(10)])
    i = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        i.alias("id"), "label", logits.alias("logits"), ((i % 4) / 2.0).alias("weight"), (i % 17 != 0).alias("mask"),
        (i % 4).cast("int").alias("strata"), (i % 3).cast("int").alias("head"),
    )


def pixels_of(df: DataFrame, t: int, h: int, w: int, n: int) -> DataFrame:
    """An embedding as t x h x w pixels of n class scores: id, t, y, x, label, logits, weight."""
    at = lambda p, c: F.get("embedding", F.lit(p * n + c)).cast("double")
    cells = [
        F.struct(F.lit(k).alias("t"), F.lit(y).alias("y"), F.lit(x).alias("x"), F.array(*[at((k * h + y) * w + x, c) for c in range(n)]).alias("logits"))
        for k in range(t) for y in range(h) for x in range(w)
    ]
    rows = df.select(F.col("vec_id").alias("id"), F.col("label").alias("l"), F.inline(F.array(*cells)))
    label = ((F.col("l") + F.col("t") + F.col("y") + F.col("x")) % n).cast("int")
    return rows.select("id", "t", "y", "x", label.alias("label"), "logits", ((F.col("id") + F.col("y") + F.col("x")) % 3).cast("double").alias("weight"))


def rasters_of(df: DataFrame, t: int, h: int, w: int, n: int) -> DataFrame:
    """The same as arrays in the row: id, labels and logits, an entry a pixel, steps first."""
    logits = F.transform(F.sequence(F.lit(0), F.lit(t * h * w - 1)), lambda p: F.transform(F.slice("embedding", p * n + 1, n), lambda x: x.cast("double")))
    p = F.sequence(F.lit(0), F.lit(t * h * w - 1))
    labels = F.transform(p, lambda p: ((F.col("label") + F.floor(p / (h * w)) + F.floor(p / w) % h + p % w) % n).cast("int"))
    return df.select(F.col("vec_id").alias("id"), labels.alias("labels"), logits.alias("logits"))


def scored_px(spark: SparkSession, d: str) -> DataFrame:
    return pixels_of(table(spark, d, "embeddings"), 1, 4, 4, 4).drop("t")


def scored_t(spark: SparkSession, d: str) -> DataFrame:
    return pixels_of(table(spark, d, "embeddings"), 4, 2, 2, 4)


def scored_multilabel(spark: SparkSession, d: str) -> DataFrame:
    """Two labels: id, labels, predictions, weight, mask."""
    i = F.col("doc_id")
    pred = [0.6 * u(i, f"p{k}") + 0.4 * F.col(c) for k, c in enumerate(("quality", "toxic"))]
    return table(spark, d, "labels").select(
        i.alias("id"), F.array("quality", "toxic").alias("labels"), F.array(*pred).alias("predictions"),
        (i % 3).cast("double").alias("weight"), (i % 17 != 0).alias("mask"),
    )


def scored_bin(spark: SparkSession, d: str) -> DataFrame:
    """id, label (0 or 1), score with ties, weight."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    score = F.least(F.lit(1.0), F.col("n_chars") / 20000.0)
    return table(spark, d, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), score.alias("score"), (F.col("doc_id") % 3).cast("double").alias("weight")
    )


def scored_reg(spark: SparkSession, d: str) -> DataFrame:
    """label, pred, weight, key1, key2; values in thousands."""
    price = F.col("l_extendedprice") / 1000
    return table(spark, d, "lineitem").select(
        price.alias("label"), (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("pred"),
        (F.col("l_linenumber") % 2).cast("double").alias("weight"), F.col("l_quantity").alias("key1"), F.col("l_discount").alias("key2"),
    )


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 rasters in long form: id, y, x, value."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("p", "v"))
    return rows.select("id", F.expr("cast(p div 8 as int)").alias("y"), (F.col("p") % 8).alias("x"), F.col("v").cast("double").alias("value"))


def arrays(spark: SparkSession, d: str) -> DataFrame:
    """Rasters as arrays, row-major with channels last: id, label, data (64 numbers)."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("data"))


def bands(spark: SparkSession, d: str) -> DataFrame:
    """4 x 4 pixels of four bands in long form: id, y, x, band, value, valid."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("p", "v"))
    return rows.select(
        "id", F.expr("cast(p div 16 as int)").alias("y"), F.expr("cast((p div 4) % 4 as int)").alias("x"), (F.col("p") % 4).alias("band"),
        F.col("v").cast("double").alias("value"), ((F.col("id") + F.col("p")) % 11 != 0).alias("valid"),
    )


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Paired views: batch_id, pair, view, v."""
    return table(spark, d, "embeddings").select(
        F.expr("vec_id div 128").alias("batch_id"), F.expr("vec_id div 2").alias("pair"), (F.col("vec_id") % 2).cast("int").alias("view"),
        F.transform("embedding", lambda x: x.cast("double")).alias("v"),
    )


def metric_log(spark: SparkSession, d: str) -> DataFrame:
    """run, step, metric, value: events in the order of their ids. A run's log may span many partitions."""
    e = table(spark, d, "events").select((F.col("user_id") % 5).cast("int").alias("run"), F.col("event_type").alias("metric"), "event_id", "value")
    return group_index(e, ["run", "metric"], ["event_id"], "step").select("run", (F.col("step") + 1).alias("step"), "metric", "value")


#: The same tables in DuckDB SQL, each as a common table expression.
SQL = {
    "scored_cls": "scored_cls AS (SELECT vec_id AS id, label, [10*embedding[i]::DOUBLE + (CASE WHEN label = i-1 THEN 1.0 ELSE 0.0 END)::DOUBLE FOR i IN range(1,11)] AS logits, ((vec_id%4)/2.0)::DOUBLE AS weight, vec_id%17 <> 0 AS mask, (vec_id%4)::INT AS strata, (vec_id%3)::INT AS head FROM embeddings)",
    "scored_px": "scored_px AS (SELECT vec_id AS id, (p//4)::INT AS y, (p%4)::INT AS x, ((label + p//4 + p%4)%4)::INT AS label, [embedding[p*4+c]::DOUBLE FOR c IN range(1,5)] AS logits, ((vec_id + p//4 + p%4)%3)::DOUBLE AS weight FROM embeddings, range(16) r(p))",
    "scored_t": "scored_t AS (SELECT vec_id AS id, (p//4)::INT AS t, (p//2%2)::INT AS y, (p%2)::INT AS x, ((label + p//4 + p//2%2 + p%2)%4)::INT AS label, [embedding[p*4+c]::DOUBLE FOR c IN range(1,5)] AS logits, ((vec_id + p//2%2 + p%2)%3)::DOUBLE AS weight FROM embeddings, range(16) r(p))",
    "scored_multilabel": "scored_multilabel AS (SELECT doc_id AS id, [quality, toxic] AS labels, [0.6::DOUBLE*u(doc_id,'p0') + 0.4::DOUBLE*quality, 0.6::DOUBLE*u(doc_id,'p1') + 0.4::DOUBLE*toxic] AS predictions, (doc_id%3)::DOUBLE AS weight, doc_id%17 <> 0 AS mask FROM labels)",
    "scored_bin": "scored_bin AS (SELECT doc_id AS id, quality AS label, least(1.0::DOUBLE, n_chars/20000.0::DOUBLE) AS score, (doc_id%3)::DOUBLE AS weight FROM labels JOIN documents USING (doc_id))",
    "scored_reg": "scored_reg AS (SELECT l_extendedprice/1000 AS label, l_extendedprice/1000*(1-l_discount)*(1+l_tax) AS pred, (l_linenumber%2)::DOUBLE AS weight, l_quantity AS key1, l_discount AS key2 FROM lineitem)",
    "tiles": "tiles AS (SELECT vec_id AS id, (p//8)::INT AS y, (p%8)::INT AS x, embedding[p+1]::DOUBLE AS value FROM embeddings, range(64) r(p))",
    "arrays": "arrays AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS data FROM embeddings)",
    "bands": "bands AS (SELECT vec_id AS id, (p//16)::INT AS y, (p//4%4)::INT AS x, (p%4)::INT AS band, embedding[p+1]::DOUBLE AS value, (vec_id+p)%11 <> 0 AS valid FROM embeddings, range(64) r(p))",
    "pairs": "pairs AS (SELECT vec_id//128 AS batch_id, vec_id//2 AS pair, (vec_id%2)::INT AS view, embedding::DOUBLE[] AS v FROM embeddings)",
    "metric_log": "metric_log AS (SELECT (user_id%5)::INT AS run, row_number() OVER (PARTITION BY user_id%5, event_type ORDER BY event_id) AS step, event_type AS metric, value FROM events)",
}


def sql_u(key: str, salt: str) -> str:
    """``u`` in DuckDB; ``salt`` is an SQL expression."""
    return f"(('0x'||substr(md5(({key})::VARCHAR||':'||{salt}),1,8))::BIGINT/4294967296.0::DOUBLE)"


def with_tables(names: str, body: str) -> str:
    """``body`` after the named tables; ``more AS (...)`` may follow in ``body`` after a comma."""
    import re

    ctes = ", ".join(SQL[n] for n in names.split())
    text = f"WITH {ctes}{body if body.lstrip().startswith(',') else ' ' + body}"
    return re.sub(r"\bu\((\w+), ?('\w+'|\w+)\)", lambda m: sql_u(m[1], m[2]), text)
