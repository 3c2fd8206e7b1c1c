"""A synthetic star schema with optional skew of its foreign keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costplan.functions import zipf_index
from costplan.sources.tables import _fs


# Foreign keys of the star, in the order in which the workload joins the tables they name.
FOREIGN_KEYS = """
store_sales.ss_sold_date_sk = date_dim.d_date_sk
store_sales.ss_item_sk = item.i_item_sk
store_sales.ss_store_sk = store.s_store_sk
store_sales.ss_cdemo_sk = customer_demographics.cd_demo_sk
store_sales.ss_sold_time_sk = time_dim.t_time_sk
store_sales.ss_customer_sk = customer.c_customer_sk
customer.c_current_addr_sk = customer_address.ca_address_sk
store_sales.ss_hdemo_sk = household_demographics.hd_demo_sk
store_sales.ss_promo_sk = promotion.p_promo_sk
"""


def sizes(scale: float = 1.0) -> dict[str, int]:
    """Rows of each table at a scale; the calendar-like ones don't grow. The numbers are fixed values."""
    grow = lambda n: max(1, int(n * scale))
    return {
        "store_sales": grow(200_000), "date_dim": 73_049, "item": grow(18_000), "store": max(12, grow(12)), "customer_demographics": 19_208, "time_dim": 86_400, "customer": grow(100_000),
        "customer_address": grow(50_000), "household_demographics": 7_200, "promotion": max(300, grow(300)),
    }


def _choice(key: Column, values: tuple, salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.hash(key, F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def star(spark: SparkSession, scale: float = 1.0, zipf: float = 0.0, seed: int = 42) -> dict[str, DataFrame]:
    """All ten tables; dimensions follow from hashes of their keys, facts from rand(seed)."""
    n = sizes(scale)
    ids = lambda t, c: spark.range(n[t]).withColumnRenamed("id", c)
    k = F.col
    dims = {
        "date_dim": ids("date_dim", "d_date_sk").select("d_date_sk", (F.lit(1900) + F.floor(k("d_date_sk") / 365)).cast("int").alias("d_year"), (F.floor(F.pmod(k("d_date_sk"), F.lit(365)) / 31) + 1).cast("int").alias("d_moy")),
        "item": ids("item", "i_item_sk").select("i_item_sk", _choice(k("i_item_sk"), ("Books", "Music", "Home", "Sports", "Shoes"), 1).alias("i_category"), (F.pmod(F.hash("i_item_sk"), F.lit(10_000)) / 100).alias("i_current_price")),
        "store": ids("store", "s_store_sk").select("s_store_sk", _choice(k("s_store_sk"), ("CA", "TX", "NY", "WA"), 2).alias("s_state")),
        "customer_demographics": ids("customer_demographics", "cd_demo_sk").select("cd_demo_sk", _choice(k("cd_demo_sk"), ("M", "F"), 3).alias("cd_gender")),
        "time_dim": ids("time_dim", "t_time_sk").select("t_time_sk", F.floor(k("t_time_sk") / 3600).cast("int").alias("t_hour")),
        "customer": ids("customer", "c_customer_sk").select("c_customer_sk", F.pmod(F.abs(F.hash("c_customer_sk")), F.lit(n["customer_address"])).cast("long").alias("c_current_addr_sk")),
        "customer_address": ids("customer_address", "ca_address_sk").select("ca_address_sk", _choice(k("ca_address_sk"), ("CA", "TX", "NY", "WA", "IL"), 4).alias("ca_state")),
        "household_demographics": ids("household_demographics", "hd_demo_sk").select("hd_demo_sk", F.pmod(k("hd_demo_sk"), F.lit(10)).cast("int").alias("hd_dep_count")),
        "promotion": ids("promotion", "p_promo_sk").select("p_promo_sk", _choice(k("p_promo_sk"), ("Y", "N"), 5).alias("p_channel_tv")),
    }
    keys = [re.fullmatch(r"store_sales\.(\w+) = (\w+)\.\w+", line) for line in FOREIGN_KEYS.split("\n")]
    keys = [m.groups() for m in keys if m]
    facts = ids("store_sales", "ss_ticket_number").select("ss_ticket_number", *[zipf_index(F.rand(seed + i), n[t], zipf).alias(c) for i, (c, t) in enumerate(keys)], F.round(F.rand(seed + 99) * 1000, 2).alias("ss_ext_sales_price"))
    return {"store_sales": facts, **dims}


def generate(spark: SparkSession, out: str, scale: float = 1.0, zipf: float = 0.0, seed: int = 42) -> dict[str, int]:
    """Writes the star as Parquet under out and returns the rows of each table."""
    for name, df in star(spark, scale, zipf, seed).items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return sizes(scale)


def ensure(spark: SparkSession, out: str, scale: float = 1.0, zipf: float = 0.0, seed: int = 42) -> bool:
    """Generates unless a marker file of the same parameters is there; returns whether it did."""
    fs, marker = _fs(spark, f"{out}/_generated_{scale:g}_{zipf:g}_{seed}")
    if fs.exists(marker):
        return False
    generate(spark, out, scale, zipf, seed)
    fs.create(marker).close()
    return True
